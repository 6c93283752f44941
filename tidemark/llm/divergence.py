"""Source divergence audit: term counts of every source against every other, recounted in dense slots of perfect hashes.

The first pass counts in how many documents of its language a term occurs and keeps the frequent ones, exactly.  Each shard
of a language's kept terms gets a minimal perfect hash with the terms themselves in slot order.  The second pass looks the
terms of every document up in the broadcast shards, verifies the stored term and adds to a dense array of its group; a round
broadcasts as many shards as ``max_bytes`` holds, and further rounds read the documents again for the others.  Shares are
then compared page of slots by page, so that neither a language nor a source is ever one task.
"""
from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import blocks_for, written

SCALE_STEPS, STEP = 3, 1_000  # shares are in units of 1/1000**3
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Matches of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` in UTF-8, A-Z lower-cased: ASCII letters and all beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERMS).split()


def digests(terms: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, terms), np.uint64, len(terms))


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of distinct terms by cascading bitmaps, and the terms in slot order.

    A level keeps the keys that are alone in their bit and hands the others down; a key's slot is the rank of its bit over
    all levels.  Keys left after the last level (equal 64-bit digests, say) have the last slots, found by comparison.
    """

    LEVELS = 24

    def __init__(self, levels: list[np.ndarray], ends: np.ndarray, body: bytes, rest: dict[bytes, int]):
        self.levels, self.ends, self.body, self.rest = levels, ends, body, rest
        self.ranks, total = [], 0
        for bits in levels:
            ones = np.bitwise_count(bits).astype(np.int64)
            self.ranks.append(total + np.cumsum(ones) - ones)
            total += int(ones.sum())

    def __len__(self) -> int:
        return len(self.ends) - 1

    @staticmethod
    def _at(h: np.ndarray, level: int, bits: int) -> np.ndarray:
        h = (h ^ np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return (((h >> np.uint64(32)) * np.uint64(bits)) >> np.uint64(32)).astype(np.int64)

    @classmethod
    def build(cls, terms: list[bytes]) -> PerfectHash:
        h, left, levels = digests(terms), np.arange(len(terms)), []
        while len(left) and len(levels) < cls.LEVELS:
            bits = 64 * blocks_for(2 * len(left), 64)
            at = cls._at(h[left], len(levels), bits)
            alone = np.bincount(at, minlength=bits)[at] == 1
            words = np.zeros(bits // 64, np.uint64)
            np.bitwise_or.at(words, at[alone] >> 6, np.uint64(1) << (at[alone] & 63).astype(np.uint64))
            levels.append(words)
            left = left[~alone]
        found = cls(levels, np.zeros(1, np.int64), b"", {})
        slots = found._ranked(h)
        slots[left] = len(terms) - len(left) + np.arange(len(left))
        ordered = [b""] * len(terms)
        for term, slot in zip(terms, slots.tolist()):
            ordered[slot] = term
        return cls(levels, np.cumsum([0, *map(len, ordered)]), b"".join(ordered), {terms[i]: int(slots[i]) for i in left.tolist()})

    def _ranked(self, h: np.ndarray) -> np.ndarray:
        """Slot of each digest if it is of a member, else any slot or -1."""
        slots, left = np.full(len(h), -1, np.int64), np.arange(len(h))
        for k, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            at = self._at(h[left], k, 64 * len(bits))
            word, bit = bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            slots[left[hit]] = (ranks[at >> 6] + below)[hit]
            left = left[~hit]
        return slots

    def slots(self, terms: list[bytes], h: np.ndarray | None = None) -> np.ndarray:
        """Each term's slot, -1 for a term that is not stored: the string in the slot decides."""
        slots = self._ranked(digests(terms) if h is None else h)
        ends, body = self.ends, self.body
        start, stop = ends[slots].tolist(), ends[slots + 1].tolist()
        return np.array([
            self.rest.get(t, -1) if s < 0 else s if body[a:b] == t else self.rest.get(t, -1) for t, s, a, b in zip(terms, slots.tolist(), start, stop)
        ], np.int64)

    def stored(self) -> list[bytes]:
        ends = self.ends.tolist()
        return [self.body[a:b] for a, b in zip(ends, ends[1:])]


def scaled(counts: np.ndarray, totals) -> np.ndarray:
    """floor(1000**3 * counts / totals), exactly and without overflow up to totals of 9e15, for counts of at most totals."""
    out, left = np.zeros(np.broadcast(counts, totals).shape, np.int64), counts
    for _ in range(SCALE_STEPS):
        left = left * STEP
        out = out * STEP + left // totals
        left = left % totals
    return out


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def pair_sums(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Sums over all slots of distance(share in s, share in t), for all sources s, t; ``counts`` is sources x slots.

    Work follows the counts that are not zero: slots where neither source has the term add the same value each.
    """
    p, used = 1 + scaled(counts + 1, totals[:, None]), counts > 0
    bare = 1 + scaled(np.ones(len(totals), np.int64), totals)
    out = np.empty((len(totals), len(totals)), np.int64)
    both = used.astype(np.int64) @ used.T.astype(np.int64)
    n = used.sum(1)
    unused = counts.shape[1] - (n[:, None] + n[None, :] - both)
    out[:] = unused * distance(bare[:, None], bare[None, :])
    for s in range(len(totals)):
        mine = np.flatnonzero(used[s])
        out[s] += distance(p[s, mine][None, :], p[:, mine]).sum(1)
        out[:, s] += np.where(used[:, mine], 0, distance(bare[:, None], p[s, mine][None, :])).sum(1)
    return out


def kept_terms(docs: DataFrame, least_docs: int = 3, flush: int = 200_000) -> DataFrame:
    """``lang``, ``term``: terms in at least ``least_docs`` rows of their language.  ``docs``: ``lang``, ``text``, no nulls in ``lang``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, terms in seen.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(terms)), pa.array(list(terms), pa.binary()), pa.array(list(terms.values()), pa.int64())], ["lang", "term", "n"]
                )

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[lang].update(set(terms_of(text)))
            if sum(map(len, seen.values())) >= flush:
                yield from out()
                seen.clear()
        yield from out()

    counted = docs.select("lang", "text").mapInArrow(count, "lang string, term binary, n long")
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least_docs).select("lang", "term")


def perfect_hashes(terms: DataFrame, shards: dict[str, int], page: int) -> DataFrame:
    """One row a shard: ``lang``, ``shard``, ``bytes``, ``hash`` (pickled), and its terms in ``pages`` of slots."""
    import pickle

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, some in frame.groupby("lang")["term"]:
                yield pd.DataFrame({"lang": lang, "shard": shard_of(digests(some.tolist()), shards[lang]), "term": some.to_numpy()})

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        made = PerfectHash.build(sorted(frame["term"].tolist()))
        body, stored = pickle.dumps(made), made.stored()
        return pd.DataFrame({"lang": [key[0]], "shard": [key[1]], "bytes": [len(body)], "hash": [body], "pages": [[stored[s:s + page] for s in range(0, len(stored), page)]]})

    return terms.mapInPandas(number, "lang string, shard long, term binary").groupBy("lang", "shard").applyInPandas(
        build, "lang string, shard long, bytes long, hash binary, pages array<array<binary>>"
    )


def recounted(docs: DataFrame, hashes: DataFrame, shards: dict[str, int], page: int, max_bytes: int, flush_slots: int) -> DataFrame:
    """``lang``, ``shard``, ``page``, ``source``, ``slots``, ``counts``: what the second pass adds up, a task at a time."""
    import pickle

    spark = docs.sparkSession
    sizes = hashes.select("lang", "shard", "bytes").orderBy("lang", "shard").collect()  # one short row a shard
    rounds: list[list] = []
    room = 0
    for r in sizes:
        if not rounds or room + r["bytes"] > max_bytes:
            rounds.append([])
            room = 0
        rounds[-1].append((r["lang"], r["shard"]))
        room += r["bytes"]
    schema = "lang string, shard long, page long, source string, slots array<int>, counts array<long>"
    found = None
    for wanted in rounds:
        one_of = F.struct("lang", "shard").isin([F.struct(F.lit(a).alias("lang"), F.lit(b).cast("long").alias("shard")) for a, b in wanted]) if len(rounds) > 1 else F.lit(True)
        sent = spark.sparkContext.broadcast({(r["lang"], r["shard"]): bytes(r["hash"]) for r in hashes.where(one_of).select("lang", "shard", "hash").collect()})

        def recount(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            tables = {key: pickle.loads(body) for key, body in sent.value.items()}
            dense: dict[tuple, np.ndarray] = {}

            def out() -> pa.RecordBatch:
                rows = []
                for (lang, shard, source), counts in dense.items():
                    for start in range(0, len(counts), page):
                        at = np.flatnonzero(counts[start:start + page])
                        if len(at):
                            rows.append((lang, shard, start // page, source, at.astype(np.int32), counts[start + at]))
                dense.clear()
                columns = list(zip(*rows)) or [()] * 6
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()))
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "shard", "page", "source", "slots", "counts"])

            def add(lang: str, source: str, counts: Counter) -> Iterator[pa.RecordBatch]:
                terms = list(counts)
                h, n = digests(terms), np.fromiter(counts.values(), np.int64, len(terms))
                of = shard_of(h, shards[lang])
                for shard in np.unique(of).tolist():
                    table = tables.get((lang, shard))
                    if table is None:  # another round's
                        continue
                    at = np.flatnonzero(of == shard)
                    slots = table.slots([terms[i] for i in at.tolist()], h[at])
                    key = (lang, shard, source)
                    if key not in dense:
                        if sum(map(len, dense.values())) + len(table) > flush_slots and dense:
                            yield out()
                        dense[key] = np.zeros(len(table), np.int64)
                    dense[key][slots[slots >= 0]] += n[at][slots >= 0]  # distinct terms have distinct slots

            for batch in batches:
                groups: dict[tuple, Counter] = defaultdict(Counter)
                for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    if lang in shards:
                        groups[lang, source].update(terms_of(text))
                for (lang, source), counts in groups.items():
                    yield from add(lang, source, counts)
            if dense:
                yield out()

        got = docs.select("lang", "source", "text").mapInArrow(recount, schema)
        if len(rounds) > 1:
            got = written(got, "recount")
            sent.unpersist()
        found = got if found is None else found.unionAll(got)
    return spark.createDataFrame([], schema) if found is None else found


def divergence(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 3, top_terms: int = 200,
    shard_terms: int = 1 << 17, page: int = 1 << 13, max_bytes: int = 128 << 20, flush_slots: int = 1 << 23,
) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``: how far each source is from the others of its language, and by
    which terms.

    A language keeps the terms in at least ``least_docs`` of its rows.  A group's share of a term is
    p = 1 + floor(10**9 * (count + 1) / (N + V)), N its occurrences of kept terms, V their number.  ``pair``: for each other source
    of the language, the sum over kept terms of floor((p - q)**2 / q), q the other's share.  ``term``: kept terms that the
    source has and uses more than the whole language, the same measure against the language's share, ``top_terms`` at most.
    Ranks go by value, the largest first, then by item in UTF-8 order.

    Null language, source and text count as empty; groups without terms take part, with V of 0 all values of ``pair`` are 0.
    Repeated rows count again; other columns are ignored; an empty table gives no rows.  Texts of any length.  A filter holds
    ``shard_terms`` terms or so, a round broadcasts ``max_bytes``, a task holds ``flush_slots`` counters of 8 bytes.
    """
    empty = F.lit("")
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), empty).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    terms = written(kept_terms(rows, least_docs), "terms")
    sizes = {r["lang"]: r["count"] for r in terms.groupBy("lang").count().collect()}  # one row a language
    shards = {lang: blocks_for(n, shard_terms) for lang, n in sizes.items()}
    hashes = written(perfect_hashes(terms, shards, page), "hashes")
    counted = written(recounted(rows, hashes, shards, page, max_bytes, flush_slots), "counts")

    totals = counted.groupBy("lang", "source").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    groups = written(rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0).cast("long")).alias("n")), "groups")
    per_lang = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("g"))
    per_lang = per_lang.join(terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v")), "lang").select("lang", "v", F.col("g.source").alias("sources"), F.col("g.n").alias("ns"))
    pages = hashes.select("lang", "shard", F.posexplode("pages").alias("page", "terms")).withColumn("page", F.col("page").cast("long")).join(per_lang, "lang")

    def compare(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(right):
            return pd.DataFrame({"lang": [], "source": [], "part": [], "item": [], "value": []})
        lang, row = key[0], right.iloc[0]
        names, stored = list(row["sources"]), [bytes(t).decode("utf-8", "surrogatepass") for t in row["terms"]]
        at = {s: k for k, s in enumerate(names)}
        counts = np.zeros((len(names), len(stored)), np.int64)
        for source, slots, n in zip(left["source"], left["slots"], left["counts"]):
            counts[at[source], slots] += n  # slots of one row are distinct
        totals_ = np.asarray(row["ns"], np.int64) + row["v"]
        sums = pair_sums(counts, totals_)
        s, t = np.nonzero(~np.eye(len(names), dtype=bool))
        names_ = np.array(names, object)
        out = [pd.DataFrame({"lang": lang, "source": names_[s], "part": "pair", "item": names_[t], "value": sums[s, t]})]
        q = 1 + scaled(counts.sum(0) + 1, np.int64(sum(row["ns"]) + row["v"]))
        for k, name in enumerate(names):
            p = 1 + scaled(counts[k] + 1, totals_[k])
            more = np.flatnonzero((counts[k] > 0) & (p > q))
            f = distance(p[more], q[more])
            best = sorted(zip((-f).tolist(), [stored[i] for i in more.tolist()]))[:top_terms]  # a page's best hold all of the source's best in it
            out.append(pd.DataFrame({"lang": lang, "source": name, "part": "term", "item": [b[1] for b in best], "value": [-b[0] for b in best]}))
        return pd.concat(out, ignore_index=True)

    schema = "lang string, source string, part string, item string, value long"
    parts = written(counted.groupBy("lang", "shard", "page").cogroup(pages.groupBy("lang", "shard", "page")).applyInPandas(compare, schema), "parts")
    sums = parts.where(F.col("part") == "pair").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    others = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where(F.col("source") != F.col("item"))
    pairs = others.join(sums, ["lang", "source", "item"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value")
    )
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    top = parts.where(F.col("part") == "term").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    return ranked.unionAll(top)
