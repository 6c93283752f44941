"""Text scorer interface: a scorer gets a batch of texts per Arrow batch, on executors."""
from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Scorer = Callable[[pd.Series], pd.DataFrame]

# The default tone words.
POSITIVE = ("beat", "beats", "gain", "gains", "growth", "profit", "record", "strong", "surge", "upgrade")
NEGATIVE = ("cut", "cuts", "decline", "downgrade", "fall", "loss", "miss", "misses", "weak", "warning")


def lexicon(positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE) -> Callable[[], Scorer]:
    """Factory of a scorer: (pos - neg) / (pos + neg) over lower-case words, 0 without hits."""

    def make() -> Scorer:
        pos, neg, word = frozenset(positive), frozenset(negative), re.compile("[a-z]+")

        def score(texts: pd.Series) -> pd.DataFrame:
            hits = [[(w in pos) - (w in neg) for w in word.findall(t.lower()) if w in pos or w in neg] for t in texts.fillna("")]
            tone = pd.Series([sum(h) / len(h) if h else 0.0 for h in hits], index=texts.index, dtype=float)
            label = pd.Series(["positive" if x > 0 else "negative" if x < 0 else "neutral" for x in tone], index=texts.index, dtype=object)
            return pd.DataFrame({"label": label, "score": tone.abs(), "numeric": tone})

        return score

    return make


def score_texts(df: DataFrame, text: Column | str, make: Callable[[], Scorer], scored_at: Column, out: str = "sentiment") -> DataFrame:
    """Add a struct (label, score, numeric) and ``sentiment_scored_at``; the scorer is built once per task."""

    @F.pandas_udf("label string, score double, numeric double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = make()
        for texts in batches:
            yield scorer(texts)

    c = F.col(text) if isinstance(text, str) else text
    return df.withColumn(out, run(c)).withColumn("sentiment_scored_at", scored_at)
