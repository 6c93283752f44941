"""Quality rules by line labelling: a linear-chain conditional random field marks every line as content or boilerplate.

The field has two states, weights for line features (shape, symbols, repetition, place, hashed words) and weights for the
steps between neighbouring lines.  It is trained in numpy; Viterbi decoding marks the lines of every text, and the share of
words in content lines decides whether the text is kept.
"""
from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_fold, fresh

SPACES = " \t\n\r\x0b\f"
SYMBOLS = "#*$%&|<>"  # fixed values: the symbols of the base rule
WINDOW = 3  # words
SHAPE = 32  # features before the hashed words
BUCKETS = 1 << 15
BOILERPLATE, CONTENT = 0, 1


def repeated(words: list[bytes]) -> np.ndarray:
    """For each word whether a window of three words around it is found twice or more in the text."""
    n = len(words)
    marks = np.zeros(n, bool)
    if n <= WINDOW:
        return marks
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    _, pairs = np.unique(ids[:-2] * len(number) + ids[1:-1], return_inverse=True)
    _, at, count = np.unique(pairs * np.int64(len(number)) + ids[2:], return_inverse=True, return_counts=True)
    found = count[at] > 1
    for k in range(WINDOW):
        marks[k:n - WINDOW + 1 + k] |= found
    return marks


def _level(x: float, *cuts: float) -> int:
    return sum(x >= c for c in cuts)


@dataclass
class Lines:
    """The lines of a text that have words (``at``: their numbers from 0), with features and the counts of the base rules."""

    at: list[int]
    words: list[int]
    features: list[np.ndarray]
    keys: list[bytes]
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    @classmethod
    def of(cls, text: str | None) -> Lines:
        text = text or ""
        lines = text.split("\n")
        split = [line.encode("utf-8", "surrogatepass").split() for line in lines]
        words = [w for line in split for w in line]
        marks = repeated(words)
        upto = np.concatenate([[0], np.cumsum(marks)])
        seen: set[str] = set()
        at, sizes, features, keys, dups, pos = [], [], [], [], 0, 0
        total = Counter(line for line, w in zip(lines, split) if w)
        for i, (line, line_words) in enumerate(zip(lines, split)):
            n = len(line_words)
            if not n:
                continue
            again = line in seen
            dups += again
            seen.add(line)
            repeats = int(upto[pos + n] - upto[pos]) / n
            pos += n
            at.append(i)
            sizes.append(n)
            keys.append(b" ".join(line_words).lower())
            features.append(cls._features(line, line_words, repeats, again, total[line] > 1, not at[:-1]))
        return cls(at, sizes, features, keys, len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dups, int(marks.sum()))

    @staticmethod
    def _features(line: str, words: list[bytes], repeats: float, again: bool, elsewhere: bool, first: bool) -> np.ndarray:
        n, chars = len(words), len(line)
        symbols = sum(map(line.count, SYMBOLS)) / n
        distinct = len(set(words)) / n
        last = words[-1][-1:]
        on = [
            0, 1 + _level(n, 4, 8, 16, 32), 6 + _level(symbols, 1e-9, 0.1, 0.4), 10 + _level(distinct, 0.3, 0.6, 0.9), 14 + _level(repeats, 1e-9, 0.2, 0.6),
            18 + _level(chars / n, 4, 6, 9), 22 + (last in b".!?"), 24 + line[:1].isupper(), 26 + again, 28 + elsewhere, 30 + first,
        ]
        hashed = {xxhash.xxh32_intdigest(w.lower()) & (BUCKETS - 1) for w in words}
        return np.array([*on, *(SHAPE + h for h in sorted(hashed))], np.int32)


@dataclass
class LineField:
    """Weights of a linear chain over two states.  ``weights``: features x 2; a line's hashed words share a weight of 1."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros((SHAPE + BUCKETS, 2)))
    steps: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))  # from, to
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))

    SHAPES = 11  # active shape features of a line

    @classmethod
    def values(cls, features: np.ndarray) -> np.ndarray:
        out = np.ones(len(features))
        out[cls.SHAPES:] = 1 / max(1, len(features) - cls.SHAPES)
        return out

    def scores(self, lines: list[np.ndarray]) -> np.ndarray:
        """Lines x states."""
        if not lines:
            return np.zeros((0, 2))
        flat = np.concatenate(lines)
        ends = np.cumsum([0, *map(len, lines)])[:-1]
        return np.add.reduceat(self.weights[flat] * np.concatenate([self.values(f) for f in lines])[:, None], ends)

    def decode(self, lines: list[np.ndarray]) -> list[int]:
        """States of the best path; of equal paths content wins, from the last line backwards."""
        emit = self.scores(lines).tolist()
        if not emit:
            return []
        (bb, bc), (cb, cc) = self.steps.tolist()
        b, c = self.start[0] + emit[0][0], self.start[1] + emit[0][1]
        back = []
        for eb, ec in emit[1:]:
            back.append((int(c + cb >= b + bb), int(c + cc >= b + bc)))
            b, c = max(b + bb, c + cb) + eb, max(b + bc, c + cc) + ec
        state = int(c >= b)
        path = [state]
        for pair in reversed(back):
            state = pair[state]
            path.append(state)
        return path[::-1]

    def marginals(self, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Probabilities of states (lines x 2) and of steps (lines - 1 x 2 x 2), and the log of the sum over all paths."""
        n = len(emit)
        ahead, behind = np.empty((n, 2)), np.zeros((n, 2))
        ahead[0] = self.start + emit[0]
        for i in range(1, n):
            ahead[i] = np.logaddexp(ahead[i - 1, 0] + self.steps[0], ahead[i - 1, 1] + self.steps[1]) + emit[i]
        for i in range(n - 2, -1, -1):
            to = behind[i + 1] + emit[i + 1]
            behind[i] = np.logaddexp(self.steps[:, 0] + to[0], self.steps[:, 1] + to[1])
        log_z = float(np.logaddexp(*ahead[-1]))
        steps = np.exp(ahead[:-1, :, None] + self.steps + (emit + behind)[1:, None, :] - log_z)
        return np.exp(ahead + behind - log_z), steps, log_z

    def fit(self, texts: list[list[np.ndarray]], states: list[np.ndarray], rounds: int = 8, rate: float = 0.3, decay: float = 1e-4, seed: int = 7) -> LineField:
        """Climb the log-likelihood of the given states, text by text in a seeded order, steps scaled by past gradients."""
        params = [self.weights, self.steps, self.start]
        squares = [np.full(p.shape, 1e-3) for p in params]
        rng = np.random.default_rng(seed)
        for _ in range(rounds):
            for i in rng.permutation(len(texts)):
                if not texts[i]:
                    continue
                y = np.asarray(states[i])
                state, step, _ = self.marginals(self.scores(texts[i]))
                wanted = np.zeros_like(state)
                wanted[np.arange(len(y)), y] = 1
                off = wanted - state
                stepped = -step.sum(0)
                np.add.at(stepped, (y[:-1], y[1:]), 1)
                flat = np.concatenate(texts[i])
                per = np.repeat(off, [len(f) for f in texts[i]], axis=0) * np.concatenate([self.values(f) for f in texts[i]])[:, None]
                at, where = np.unique(flat, return_inverse=True)
                summed = np.zeros((len(at), 2))
                np.add.at(summed, where, per)
                for k, (where_, g) in enumerate(((at, summed), (slice(None), stepped), (slice(None), off[0]))):
                    g = g - decay * params[k][where_]
                    squares[k][where_] += g * g
                    params[k][where_] += rate * g / np.sqrt(squares[k][where_])
        return self


def marked_lines(texts: list[list[bytes]], good: list[bool], least: int = 5) -> list[np.ndarray]:
    """States to learn from: all lines of a bad text are boilerplate; so is a line of a good one that stands in ``least`` texts or
    more after as many different lines, in half of its places at least (copies of a text repeat the line before as well)."""
    places, befores = Counter(), defaultdict(set)
    for lines in texts:
        for before, line in zip([b"", *lines], lines):
            places[line] += 1
            befores[line].add(before)
    stock = {line for line, b in befores.items() if len(b) >= max(least, places[line] / 2)}
    return [np.array([int(g and line not in stock) for line in lines], np.int64) for lines, g in zip(texts, good)]


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", mod: int = 1, held_fold: int = 1,
    max_good: int = 2_000, max_bad: int = 1_000, max_chars: int = 20_000, **options,
) -> LineField:
    """Fit on a bounded sample: ``max_good`` and ``max_bad`` labelled documents at most, the smallest by hash of their id, whole
    texts of up to ``max_chars`` code points, in no fold ``held_fold`` of crc32(id) modulo ``mod`` (none by default).

    Lines are turned to feature numbers and digests in the tasks; only these reach the driver.  A document with both labels counts as bad;
    null labels, ids and texts are not used, of rows with one id the smallest text is.  Without both labels the field marks all
    lines as content.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (crc_fold(id_col, mod) != held_fold))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("y"))
    short = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") <= max_chars)
    texts = short.join(known, "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    picked = [texts.where(F.col("y") == y).orderBy(F.xxhash64(F.lit(13), "id"), "id").limit(n) for y, n in ((1, max_good), (0, max_bad))]

    def featured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lines = [Lines.of(t) for t in frame["text"]]
            yield pd.DataFrame({
                "id": frame["id"].astype(str), "y": frame["y"], "features": [[f.tolist() for f in x.features] for x in lines],
                "keys": [[xxhash.xxh64_digest(k) for k in x.keys] for x in lines],
            })

    rows = picked[0].unionAll(picked[1]).mapInPandas(featured, "id string, y int, features array<array<int>>, keys array<binary>").collect()
    rows.sort(key=lambda r: (r["id"], r["y"]))
    crf, good = LineField(), [r["y"] == 1 for r in rows]
    if not any(good) or all(good):
        return crf
    states = marked_lines([[bytes(k) for k in r["keys"]] for r in rows], good)
    return crf.fit([[np.array(f, np.int32) for f in r["features"]] for r in rows], states, **options)


def line_quality(docs: DataFrame, crf: LineField, text_col: str = "text", least_words: int = 50, most_repeated: int = 50, least_content: float = 0.5) -> DataFrame:
    """``docs`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``, ``content_lines`` (numbers
    of the lines marked as content, from 0), ``content_share`` (of all words) and ``kept``; columns of these names are replaced.

    ``base_failed``: fewer than ``least_words`` words, or more than ``most_repeated`` per cent of them in repeated windows.  Kept are
    texts that have not failed with a content share of ``least_content`` or more.  Null and empty texts have no words and fail;
    repeated rows are judged alike, an empty table gives no rows; whole texts of any length.
    """
    sent = docs.sparkSession.sparkContext.broadcast(crf)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for texts in batches:
            out = []
            for text in texts:
                lines = Lines.of(text)
                states = model.decode(lines.features)
                content = sum(n for n, s in zip(lines.words, states) if s == CONTENT)
                out.append((*(getattr(lines, c) for c in counts), [a for a, s in zip(lines.at, states) if s == CONTENT], content))
            yield pd.DataFrame(out, columns=[*counts, "content_lines", "content"])

    made = {*counts, "base_failed", "content_lines", "content_share", "kept"}
    (column,) = fresh(docs, "_judged")
    judged = docs.withColumn(column, F.pandas_udf(judge, ", ".join(f"{c} long" for c in counts) + ", content_lines array<int>, content long")(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    at = F.col(column)
    failed = (at["n_words"] < least_words) | (100 * at["n_repeat_words"] > most_repeated * at["n_words"])
    share = F.when(at["n_words"] > 0, at["content"] / at["n_words"]).otherwise(F.lit(0.0))
    return judged.select(
        *[F.col(c) for c in docs.columns if c.lower() not in made], *[at[c].alias(c) for c in counts], failed.alias("base_failed"),
        at["content_lines"].alias("content_lines"), share.alias("content_share"), (~failed & (share >= least_content)).alias("kept"),
    )
