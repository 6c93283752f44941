"""Toxicity by a convolutional text classifier over hashed word embeddings, trained in numpy."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_fold, fresh, words_of

WIDTHS = (1, 2, 3)
STEP = 200_000  # tokens held at once; longer texts run in overlapping steps


def word_buckets(text: str | None, buckets: int) -> np.ndarray:
    words = words_of(text or "")
    return (np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) & np.uint64(buckets - 1)).astype(np.int64)


@dataclass
class TextCnn:
    """Embedding rows of the buckets seen often enough (row 0 stays zero for all others), filters of several widths with
    max pooling over the whole text, and a logistic layer.  ``thresholds`` by language, ``None`` for any other."""

    buckets: int = 1 << 18
    rows: np.ndarray | None = None  # bucket -> embedding row
    emb: np.ndarray | None = None
    filters: list = field(default_factory=list)
    bias: list = field(default_factory=list)
    out: np.ndarray | None = None
    shift: float = 0.0
    rate: float = 0.0
    thresholds: dict = field(default_factory=dict)
    _tables: list | None = None

    def __getstate__(self):
        return {**self.__dict__, "_tables": None}

    def pooled(self, x: np.ndarray) -> tuple[list, list]:
        """Per width: maxima of its filters over all positions, and where they are.  ``x``: embedding rows of the words."""
        if self._tables is None:  # a filter over hashed words is a sum of one table lookup per offset
            self._tables = [[self.emb @ f[k] for k in range(w)] for w, f in zip(WIDTHS, self.filters)]
        x = np.concatenate([x, np.zeros(max(WIDTHS), np.int64)])  # an empty text still has one window
        tops, ats = [], []
        for w, tables in zip(WIDTHS, self._tables):
            best = at = None
            for s in range(0, max(1, len(x) - w + 1), STEP):
                seg = x[s:s + STEP + w - 1]
                n = len(seg) - w + 1
                z = tables[0][seg[:n]]
                for k in range(1, w):
                    z = z + tables[k][seg[k:n + k]]
                i = z.argmax(0)
                m = z[i, np.arange(z.shape[1])]
                if best is None:
                    best, at = m, i + s
                else:
                    at = np.where(m > best, i + s, at)
                    best = np.maximum(m, best)
            tops.append(best)
            ats.append(at)
        return tops, ats

    def logit(self, x: np.ndarray) -> float:
        tops, _ = self.pooled(x)
        h = np.maximum(np.concatenate([t + b for t, b in zip(tops, self.bias)]), 0)
        return float(h @ self.out[:-1] + self.out[-1])

    def score(self, text: str | None) -> float:
        return self.rate if self.emb is None else self.score_words(word_buckets(text, self.buckets))

    def score_words(self, words: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(self.rows[words]) + self.shift, -30, 30))))

    def threshold(self, lang: str | None) -> float:
        return self.thresholds.get(lang, self.thresholds.get(None, 0.5))


def train(words: list, labels: np.ndarray, langs: list, rate: float, buckets: int = 1 << 18, dim: int = 8, filters: int = 8, min_docs: int = 3, epochs: int = 6, seed: int = 5) -> TextCnn:
    """Fit on whole texts, given as the buckets of their words.  A fifth, by position of a seeded shuffle, is left out to set the thresholds.

    The first embedding coordinate starts as the shrunken log-odds of a word's document frequencies, the others near zero.
    Gradients reach only the windows that max pooling picked.  The sample may hold another share of label 1 than all labels
    do; the logit is shifted so that scores are probabilities at ``rate``, the share among all training labels.
    """
    model = TextCnn(buckets=buckets, rate=rate)
    labels = np.asarray(labels, np.float64)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(labels))
    held, fit = order[: len(order) // 5], order[len(order) // 5:]
    if not len(fit) or labels[fit].min() == labels[fit].max():
        model.thresholds = {None: 0.5}
        return model
    yes, no = np.zeros(buckets), np.zeros(buckets)
    for i in fit:
        (yes if labels[i] else no)[np.unique(words[i])] += 1
    seen = np.flatnonzero(yes + no >= min_docs)
    model.rows = np.zeros(buckets, np.int32)
    model.rows[seen] = np.arange(1, len(seen) + 1)
    p = labels[fit].mean()
    prior = 4.0
    odds = np.log((yes[seen] + prior * p) / (no[seen] + prior * (1 - p))) - np.log(p / (1 - p))
    emb = np.concatenate([np.zeros((1, dim)), rng.normal(0, 0.02, (len(seen), dim))])
    emb[1:, 0] = odds
    model.emb = emb.astype(np.float32)
    model.filters = [rng.normal(0, 0.2, (w, dim, filters)).astype(np.float32) for w in WIDTHS]
    for w, f in zip(WIDTHS, model.filters):
        f[w // 2, 0] += 0.7  # every filter starts by looking for the word whose odds are highest
    model.bias = [np.full(filters, -0.3, np.float32) for _ in WIDTHS]
    model.out = np.concatenate([np.full(len(WIDTHS) * filters, 0.15), [-1.0]])
    params = [model.emb, *model.filters, *model.bias, model.out]
    squares = [np.full(a.shape, 1e-6) for a in params]
    docs = [model.rows[x] for x in words]

    def move(k: int, g: np.ndarray, rate_: float, at=slice(None)) -> None:
        squares[k][at] += g * g
        params[k][at] -= (rate_ * g / np.sqrt(squares[k][at])).astype(params[k].dtype)

    nf, nw = filters, len(WIDTHS)
    for epoch in range(epochs):
        lr = 0.05 / (1 + epoch)
        for i in rng.permutation(fit):
            model._tables = None if i % 16 == 0 or model._tables is None else model._tables
            tops, ats = model.pooled(docs[i])
            h0 = np.concatenate([t + b for t, b in zip(tops, model.bias)])
            h = np.maximum(h0, 0)
            err = 1 / (1 + np.exp(-np.clip(h @ model.out[:-1] + model.out[-1], -30, 30))) - labels[i]
            if abs(err) < 0.02:
                continue
            back = err * model.out[:-1] * (h0 > 0)
            move(1 + 2 * nw, np.append(err * h, err), lr)
            x = np.concatenate([docs[i], np.zeros(max(WIDTHS), np.int64)])
            for v, w in enumerate(WIDTHS):
                g = back[v * nf:(v + 1) * nf]
                live = np.flatnonzero(g)
                if not len(live):
                    continue
                move(1 + nw + v, g, lr)
                for k in range(w):
                    at = x[ats[v][live] + k]
                    grad_f = np.zeros((dim, nf))
                    grad_f[:, live] = model.emb[at].T * g[live]
                    grad_e = model.filters[v][k][:, live].T * g[live, None]
                    move(1 + v, grad_f, lr, k)
                    some, where = np.unique(at, return_inverse=True)
                    total = np.zeros((len(some), dim))
                    np.add.at(total, where, grad_e)
                    total[some == 0] = 0
                    move(0, total, lr, some)
    model._tables = None
    if 0 < rate < 1:
        model.shift = float(np.log(rate / (1 - rate)) - np.log(p / (1 - p)))
    weight = np.where(labels == 1, rate / labels.mean(), (1 - rate) / max(1e-9, 1 - labels.mean()))
    scores = np.array([model.score_words(words[i]) for i in held])
    model.thresholds = calibrated(scores, labels[held], weight[held], [langs[i] for i in held])
    return model


def calibrated(scores: np.ndarray, labels: np.ndarray, weight: np.ndarray, langs: list, least: int = 50) -> dict:
    """Threshold of the best weighted F1 for every language with ``least`` labels of either kind; ``None``: over all."""

    def best(at: np.ndarray) -> float:
        s, y, w = scores[at], labels[at], weight[at]
        order = np.argsort(-s, kind="stable")
        tp, all_ = np.cumsum((y * w)[order]), np.cumsum(w[order])
        f1 = 2 * tp / (all_ + (y * w).sum())
        last = np.append(s[order][1:] != s[order][:-1], True)
        k = int(np.argmax(np.where(last, f1, -1)))
        below = s[order][k + 1] if k + 1 < len(order) else 0.0
        return float((s[order][k] + below) / 2)

    out = {None: best(np.arange(len(scores))) if labels.sum() else 0.5}
    langs = np.array([x if x is not None else "" for x in langs], dtype=object)
    for lang in sorted(set(langs)):
        at = np.flatnonzero(langs == lang)
        if min(labels[at].sum(), len(at) - labels[at].sum()) >= least:
            out[lang] = best(at)
    return out


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic",
    mod: int = 4, held_fold: int = 2, max_positive: int = 3_000, max_negative: int = 6_000, buckets: int = 1 << 18, **options,
) -> TextCnn:
    """Fit on a bounded sample of the labelled rows outside the held-out fold: ``max_positive`` and ``max_negative`` documents
    at most, the smallest by hash of their id, whole texts.  Tasks turn texts into word buckets; the driver gets four bytes a
    word of the sample and no text.  The share of label 1 is counted over all those labels.

    A document with both labels counts as 1; null labels and null ids are not used.  Without both labels the model gives
    every text the share of label 1 (0 without labels).
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (crc_fold(id_col, mod) != held_fold))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    counts = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("yes")).first()
    rate = counts["yes"] / counts["n"] if counts["n"] else 0.0
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64(F.lit(11), "id")).limit(n) for y, n in ((1, max_positive), (0, max_negative))]

    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([word_buckets(t, buckets).astype(np.int32).tobytes() for t in texts], dtype=object)

    sample = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
        .join(F.broadcast(picked[0].unionAll(picked[1])), "id").groupBy("id", "y").agg(F.min(F.struct("text", "lang")).alias("d"))
        .select("id", "y", "d.lang", F.pandas_udf(packed, "binary")("d.text").alias("words")).toPandas().sort_values("id", ignore_index=True)
    )
    words = [np.frombuffer(w, np.int32) for w in sample["words"]]
    return train(words, sample["y"].to_numpy(), sample["lang"].tolist(), rate, buckets=buckets, **options)


def scored(docs: DataFrame, model: TextCnn, text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and, with ``lang_col``, ``rejected`` by that language's threshold.

    Whole texts, any length; null and empty texts have the score of a text without words.  Columns of these names are
    replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted = sent.value
        for texts in batches:
            yield pd.Series([fitted.score(t) for t in texts], dtype="float64")

    kept = [c for c in docs.columns if c.lower() not in ("score", "rejected") or c in (text_col, lang_col)]
    out = docs.select(*kept, F.pandas_udf(score, "double")(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("score"))
    if lang_col is None:
        return out
    (limit,) = fresh(out, "_limit")
    limits = F.create_map(*[F.lit(x) for pair in model.thresholds.items() if pair[0] is not None for x in pair]) if len(model.thresholds) > 1 else None
    by_lang = F.coalesce(limits[F.coalesce(F.col(lang_col), F.lit(""))], F.lit(model.threshold(None))) if limits is not None else F.lit(model.threshold(None))
    return out.withColumn(limit, by_lang).withColumn("rejected", F.col("score") >= F.col(limit)).drop(limit)
