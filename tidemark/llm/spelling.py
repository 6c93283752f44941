"""Spelling variants: generated edits of every word, probed against broadcast Bloom filters; positives join the vocabulary.

Two words are near if they differ by one inserted, deleted or replaced code point.  Every near pair is generated once: the
longer word deletes (the first of equal neighbours), of two words of one length the one with the smaller code point
replaces it.  A word's hash is a polynomial in its code points, so the hash of an edit costs a few operations on arrays and
no string is built before a filter says yes.  Filters are sharded by length and by a hash of the edited word; a round
broadcasts as many shards as ``max_bytes`` holds, and further rounds serve the others.  What a filter lets through by
mistake finds no partner in the exact join.
"""
from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import blocks_for, written

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd: every edit is a multiplication away
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BITS_PER_WORD, LEAST_BLOCKS = 16, 1024
ONE = np.uint64(1)
# Latin letters of the corpus words; all else separates.  A-Z become a-z, no other letter changes.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def latin_runs(text: str) -> list[bytes]:
    """Maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` in Latin-1, A-Z lower-cased."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def corpus_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 31, least_chars: int = 7, least_n: int = 2, flush: int = 200_000) -> DataFrame:
    """``word``, ``n``: the words of all whole texts and how often they occur.

    Of a run whose crc32 of ``<id>:<run>`` in UTF-8 is divisible by ``every``, one code point is deleted, the one at that
    number modulo the run's length.  Results shorter than ``least_chars`` or found fewer than ``least_n`` times are left
    out.  A null text has no words, a null id counts as empty; repeated rows count again; an empty table gives no rows.  Texts
    of any length: a task holds the counts of ``flush`` distinct words and one batch.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, k in Counter(r for r in latin_runs(text or "") if len(r) >= least_chars).items():
                    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                    if h % every == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1:]
                        if len(run) < least_chars:
                            continue
                    seen[run] += k
                if len(seen) >= flush:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def codes_of(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), length).astype(np.uint64)


def _powers(length: int) -> np.ndarray:
    return np.concatenate([[ONE], np.cumprod(np.full(max(length - 1, 0), BASE, np.uint64), dtype=np.uint64)])[:length]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads a polynomial hash over all 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashes_of(words: list[str], length: int) -> np.ndarray:
    return mixed(((codes_of(words, length) + ONE) * _powers(length)).sum(1, dtype=np.uint64))


def _within(h: np.ndarray, n: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return _within(h * BASE, parts)


class Blocked:
    """Bloom filter whose four bits of a key lie in one 64-bit block."""

    def __init__(self, blocks: np.ndarray):
        self.blocks = blocks

    @classmethod
    def of(cls, hashes: np.ndarray) -> Blocked:
        blocks = np.zeros(max(LEAST_BLOCKS, len(hashes) * BITS_PER_WORD // 64), np.uint64)
        np.bitwise_or.at(blocks, _within(hashes, len(blocks)), cls._low(hashes) | cls._high(hashes))
        return cls(blocks)

    @staticmethod
    def _low(h: np.ndarray) -> np.ndarray:
        return (ONE << (h & np.uint64(63))) | (ONE << ((h >> np.uint64(6)) & np.uint64(63)))

    @staticmethod
    def _high(h: np.ndarray) -> np.ndarray:
        return (ONE << ((h >> np.uint64(12)) & np.uint64(63))) | (ONE << ((h >> np.uint64(18)) & np.uint64(63)))

    def probe(self, h: np.ndarray) -> np.ndarray:
        """Positions of the hashes that may be in the filter."""
        block = self.blocks[_within(h, len(self.blocks))]
        low = self._low(h)
        at = np.flatnonzero((block & low) == low)
        high = self._high(h[at])
        return at[(block[at] & high) == high]


class Shards:
    """Filters by (length, part); how many parts each length has in all, here or in another round."""

    def __init__(self, filters: dict[tuple[int, int], Blocked], parts: dict[int, int]):
        self.filters, self.parts = filters, parts
        self.lengths = {length for length, _ in filters}

    def probe(self, h: np.ndarray, length: int) -> np.ndarray:
        n = self.parts[length]
        if n == 1:
            return self.filters[length, 0].probe(h)
        part, found = part_of(h, n), []
        for (of, p), bloom in self.filters.items():
            if of == length:
                at = np.flatnonzero(part == p)
                found.append(at[bloom.probe(h[at])])
        return np.concatenate(found) if found else np.empty(0, np.int64)


def likely_edits(words: list[str], length: int, alphabet: np.ndarray, shards: Shards) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(positions of the words, edited words) that the filters let through; ``words`` all have ``length`` code points."""
    codes, powers = codes_of(words, length), _powers(length)
    terms = (codes + ONE) * powers
    upto = np.cumsum(terms, axis=1, dtype=np.uint64)
    whole = upto[:, -1:]
    if length - 1 in shards.lengths:
        first = np.ones(codes.shape, bool)
        first[:, 1:] = codes[:, 1:] != codes[:, :-1]
        row, col = np.nonzero(first)
        edited = mixed((upto - terms + (whole - upto) * INVERSE)[row, col])
        at = shards.probe(edited, length - 1)
        if len(at):
            yield row[at], [words[r][:c] + words[r][c + 1:] for r, c in zip(row[at].tolist(), col[at].tolist())]
    if length in shards.lengths:
        without = whole - terms
        for letter in alphabet.tolist():
            cell = np.flatnonzero(codes < letter)
            edited = mixed((without + np.uint64(letter + 1) * powers).ravel()[cell])
            cell = cell[shards.probe(edited, length)]
            if len(cell):
                row, col = cell // length, cell % length
                yield row, [words[r][:c] + chr(letter) + words[r][c + 1:] for r, c in zip(row.tolist(), col.tolist())]


def _filters(vocabulary: DataFrame, parts: dict[int, int]) -> DataFrame:
    """``length``, ``part``, ``bits``; only 64-bit hashes of the words are shuffled."""

    def keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for length, words in frame.groupby("length")["word"]:
                h = hashes_of(words.tolist(), length)
                yield pd.DataFrame({"length": np.int32(length), "part": part_of(h, parts[length]).astype(np.int32), "h": h.view(np.int64)})

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        bits = Blocked.of(frame["h"].to_numpy().view(np.uint64)).blocks.tobytes()
        return pd.DataFrame({"length": [key[0]], "part": [key[1]], "bits": [bits]})

    hashed = vocabulary.select("word", "length").mapInPandas(keys, "length int, part int, h long")
    return hashed.groupBy("length", "part").applyInPandas(build, "length int, part int, bits binary")


def gathered(frames: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Frames of ``rows`` rows or more, but for the last: work on arrays needs words of one length by the thousand."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        held.append(frame)
        if sum(map(len, held)) >= rows:
            yield pd.concat(held)
            held = []
    if held:
        yield pd.concat(held)


def near_pairs(vocabulary: DataFrame, part_words: int = 1 << 18, max_bytes: int = 64 << 20, cells: int = 1 << 15) -> DataFrame:
    """Every near pair of ``vocabulary`` (``word`` unique, ``n``, ``length``) once: ``word``, ``n``, ``other``, ``other_n``.

    ``part_words`` bounds what one filter is built of, ``max_bytes`` what one round broadcasts, ``cells`` the words
    that a task gathers and the code points that it edits at once.
    """
    spark = vocabulary.sparkSession
    sizes = {r["length"]: r["count"] for r in vocabulary.groupBy("length").count().collect()}  # one row per word length
    alphabet = np.array(sorted(
        ord(r["c"]) for r in vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where(F.col("c") != "").distinct().collect()
    ), np.int64)  # at most all code points
    parts = {length: blocks_for(n, part_words) for length, n in sizes.items()}
    filters = written(_filters(vocabulary, parts), "bloom")
    rounds: list[list[tuple[int, int]]] = []
    room = 0
    for length in sorted(parts):
        cost = 8 * max(LEAST_BLOCKS, 2 * sizes[length] * BITS_PER_WORD // 64 // parts[length])  # twice the mean
        for part in range(parts[length]):
            if not rounds or room + cost > max_bytes:
                rounds.append([])
                room = 0
            rounds[-1].append((length, part))
            room += cost
    found = None
    for wanted in rounds:
        lengths = sorted({length for length, _ in wanted})
        one_of = F.struct("length", "part").isin([F.struct(F.lit(a).alias("length"), F.lit(b).alias("part")) for a, b in wanted]) if len(rounds) > 1 else F.lit(True)
        rows = filters.where(one_of).collect()
        sent = spark.sparkContext.broadcast(Shards({(r["length"], r["part"]): Blocked(np.frombuffer(r["bits"], np.uint64)) for r in rows}, parts))

        def edits(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for frame in gathered(frames, cells):
                for length, group in frame.groupby("length"):
                    words, n = group["word"].tolist(), group["n"].to_numpy()
                    step = max(1, cells // length)
                    for s in range(0, len(words), step):
                        some, counts = words[s:s + step], n[s:s + step]
                        for row, edited in likely_edits(some, length, alphabet, sent.value):
                            yield pd.DataFrame({"word": [some[r] for r in row.tolist()], "n": counts[row], "other": edited})

        near = F.col("length").isin(sorted({x for length in lengths for x in (length, length + 1)}))
        got = vocabulary.select("word", "n", "length").where(near).mapInPandas(edits, "word string, n long, other string")
        if len(rounds) > 1:
            got = written(got, "edits")  # before the next round's filters are sent
            sent.unpersist()
        found = got if found is None else found.unionAll(got)
    if found is None:
        found = spark.createDataFrame([], "word string, n long, other string")
    exact = vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    return found.join(exact, "other").select("word", "n", "other", "other_n")


def spelling_groups(counts: DataFrame, ratio: int = 10, **options) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of every row of ``counts`` (``word``, ``n``).

    A word's form is its near word of the largest ``n`` (ties: the smallest in code-point order) if that ``n`` is at least
    ``ratio`` (2 or more) times the word's own, else null.  ``root`` follows forms to the last; as ``n`` grows by ``ratio`` with
    every step, a chain has at most log2(largest ``n``) of them and pointer doubling ends after a handful of joins.  Null and empty
    words are left out, repeated words are added up, other columns are ignored; an empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, or forms could run in a circle")
    vocabulary = written(
        counts.where(F.length("word") > 0).groupBy("word").agg(F.sum("n").cast("long").alias("n")).select("word", "n", F.length("word").cast("int").alias("length")), "words"
    )
    pairs = near_pairs(vocabulary, **options)
    both = pairs.select(F.explode(F.array(
        F.struct("word", F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")).alias("at")),
        F.struct(F.col("other").alias("word"), F.struct((-F.col("n")).alias("n"), F.col("word").alias("word")).alias("at")),
    )).alias("x")).select("x.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("at").alias("best"))
    formed = vocabulary.join(best, "word", "left")
    takes = -F.col("best.n") >= ratio * F.col("n")
    formed = written(formed.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(takes, F.col("best.word")).alias("form"), F.when(takes, -F.col("best.n")).alias("form_n"),
    ), "forms")
    up = formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        nearer = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = written(up.join(nearer, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if up.where("moved").isEmpty():
            break
        up = up.select("word", "root")
    return formed.join(up.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
