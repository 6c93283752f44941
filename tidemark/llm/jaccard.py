"""N-gram Jaccard join: a grouped prefix join over word shingles, and the components of its links."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import row_hash, words_of, written

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
HELD = 4_000_000  # shingles a task gathers before it passes on what repeats
BITS = 1 << 26  # of the bitmap that spares reading again texts without candidates
SIGNATURE = 512  # bits of a set's parities


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``size``-word shingles; of fewer words, one for the whole sequence."""
    words = words_of(text or "")
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(size, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = (h ^ w[j:j + n]) * _MIX[j % len(_MIX)]
        h ^= h >> np.uint64(32)
    return np.unique(h)


def parities(shingles: np.ndarray) -> np.ndarray:
    """``SIGNATURE`` bits, as longs: of each bit whether an odd number of shingles falls on it.  Bits in which two sets differ are no
    more than shingles in which they differ."""
    at = (shingles * _MIX[0]) >> np.uint64(64 - SIGNATURE.bit_length() + 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=SIGNATURE) & 1).astype(np.uint8)).view(np.int64)


def _alike(a: Column, b: Column, sizes: Column, percent: int) -> Column:
    """Whether sets of these parities and this sum of sizes can reach the likeness: 100 - percent in 100 + percent of the sum may differ."""
    bits = sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(SIGNATURE // 64)), F.lit(0))
    return bits * (100 + percent) <= sizes * (100 - percent)


def _prefix_length(n: int, percent: int) -> int:
    """Two sets of at least this likeness share one of the first n - ceil(percent * n / 100) + 1 in any common order."""
    return n - -(-percent * n // 100) + 1


def common_shingles(docs: DataFrame, text_col: str, size: int, often_from: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (upper 32 bits) of the shingles counted ``often_from`` times or more, sorted, with their rank by ascending count.  At most
    ``most``: where more are that frequent, the bar is raised to 1 in ``most`` of all occurrences.

    All shingles of all texts are counted, each task's own first, so that the list is the same however the rows are dealt.  Two shingles
    of one bucket count together: the common order of the prefixes is right whatever the counts say, they only keep
    passages of many texts out of the prefixes.
    """

    def summed(held: list[np.ndarray]) -> pd.DataFrame:
        s, n = np.unique((np.concatenate(held) >> np.uint64(32)).astype(np.uint32), return_counts=True)
        return pd.DataFrame({"s": s.view(np.int32), "n": n.astype(np.int32)})

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        n = 0
        for b in batches:
            for text in b["text"]:
                held.append(shingle_set(text, size))
                n += len(held[-1])
                if n >= HELD:
                    yield summed(held)
                    held, n = [], 0
        if n:
            yield summed(held)

    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInPandas(count, "s int, n int")
    sums = parts.groupBy("s").agg(F.sum("n").alias("n"))
    low = F.when(F.col("n") < often_from, F.col("n"))  # the many rare ones only count in the total
    key = F.when(F.col("n") >= often_from, F.col("s"))
    sums = written(sums.groupBy(key.alias("s")).agg(F.max(F.when(key.isNotNull(), F.col("n"))).alias("n"), F.coalesce(F.sum(low), F.lit(0)).alias("rare")), "shingle-counts")
    frequent = sums.where("s IS NOT NULL").select("s", "n")
    bar = often_from
    if frequent.count() > most:
        total = sums.agg(F.sum(F.col("rare") + F.coalesce("n", F.lit(0)))).first()[0]
        bar = max(often_from, -(-total // most))
    rows = frequent.where(F.col("n") >= bar).toArrow()
    s, n = rows["s"].to_numpy().view(np.uint32), rows["n"].to_numpy()
    order = np.lexsort((s, n))
    rank = np.empty(len(s), np.int64)
    rank[order] = np.arange(len(s))
    by = np.argsort(s)
    return s[by], rank[by]


def _signed(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, common: tuple) -> DataFrame:
    """``id, p, n, cls, sig, grp, tail, end, prefix``: set size, digest and parities of the set, hash of size and prefix, where the
    prefix ends in the common order, and the prefix (once for each group and task, else null)."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, ranks = sent.value
        told: set[int] = set()
        for b in batches:
            n, cls, sig, grp, prefix, tail, end = [], [], [], [], [], [], []
            for text in b["text"]:
                s = shingle_set(text, size)
                first, plain, rank = s, len(s), np.empty(0, np.int64)
                if len(s) and len(hashes):
                    bucket = (s >> np.uint64(32)).astype(np.uint32)
                    at = np.minimum(np.searchsorted(hashes, bucket), len(hashes) - 1)
                    often = hashes[at] == bucket
                    rank = np.sort(ranks[at[often]])
                    first, plain = np.concatenate([s[~often], s[often][np.argsort(ranks[at[often]], kind="stable")]]), int((~often).sum())
                first = first[: _prefix_length(len(s), percent)] if len(s) else s
                # place of the prefix's last shingle in the common order: a frequent one's rank, else its hash
                tail.append(int(rank[len(first) - plain - 1]) if len(first) > plain else -1)
                end.append(int(first[-1]) - (1 << 63) if len(first) else 0)
                g = xxhash.xxh64_intdigest(first.tobytes(), len(s)) - (1 << 63)
                n.append(len(s))
                cls.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig.append(parities(s))
                grp.append(g)
                if len(told) > 300_000:
                    told = set()
                prefix.append(None if g in told or not len(s) else first.view(np.int64))
                told.add(g)
            yield pd.DataFrame({"id": b["id"], "p": b["p"], "n": n, "cls": cls, "sig": sig, "grp": grp, "tail": tail, "end": end, "prefix": prefix})

    rows = docs.select(F.col(id_col).cast("string").alias("id"), _place(id_col).alias("p"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    signed = rows.mapInPandas(sign, "id string, p long, n int, cls binary, sig array<long>, grp long, tail long, end long, prefix array<long>")
    return written(signed.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)), "shingle-prefixes")


def _place(id_col: str) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(BITS))


def _sets(docs: DataFrame, id_col: str, text_col: str, size: int, wanted: DataFrame) -> DataFrame:
    """``cls, shingles`` of the wanted classes (``cls, p``).  A bitmap over hashed ids, of fixed size, spares hashing again the
    texts that no pair asks for; a join then keeps exactly the wanted ones."""
    bucket, bit = F.expr("bitmap_bucket_number(p)"), F.expr("bitmap_construct_agg(bitmap_bit_position(p))")
    bits = np.zeros(BITS // 8 + 8192, np.uint8)
    for r in wanted.where("p > 0").groupBy(bucket.alias("b")).agg(bit.alias("m")).collect():
        at = (r["b"] - 1) * 4096
        bits[at:at + 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mask = sent.value
        for b in batches:
            at = b["p"].to_numpy() - 1
            # the bitmap's positions count from 1; place 0 is always read
            asked = (mask[np.maximum(at, 0) >> 3] >> (np.maximum(at, 0) & 7)) & 1
            keep = b[(asked == 1) | (at < 0)]
            for s in range(0, len(keep), 200):
                sets = [shingle_set(t, size) for t in keep["text"].iloc[s:s + 200]]
                yield pd.DataFrame({"cls": [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], "shingles": [x.view(np.int64) for x in sets]})

    rows = docs.select(_place(id_col).alias("p"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = rows.mapInPandas(collect, "cls binary, shingles array<long>").join(wanted.select("cls").distinct(), "cls", "left_semi")
    return found.groupBy("cls").agg(F.first("shingles").alias("shingles"))


def _verified(pairs: DataFrame, classes: DataFrame, percent: int, sets) -> DataFrame:
    """The pairs (``a, b``) whose shingle sets reach the likeness."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(classes.select("cls", "p"), "cls")
    held = sets(asked)
    both = pairs.join(held.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), "a").join(held.select(F.col("cls").alias("b"), F.col("shingles").alias("sb")), "b")
    # 100 * i >= percent * (x + y - i)
    reached = F.size(F.array_intersect("sa", "sb")) * (100 + percent) >= (F.size("sa") + F.size("sb")) * percent
    return written(both.where(reached).select("a", "b"), "links")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``cls, comp`` for every linked class: the smallest label that links reach.  In each round all classes of a label take the
    least label that any of them has as a neighbour, then that label's own label, so components merge in pairs at least
    and long chains take a logarithmic number of rounds.  Labels are written to the shared folder in between."""
    both = written(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.select(F.col("a").alias("cls"), F.col("a").alias("comp")).distinct(), "labels")
    for _ in range(most_rounds):
        of_a, of_b = (labels.select(F.col("cls").alias(c), F.col("comp").alias(f"c{c}")) for c in "ab")
        open_ = written(both.join(of_a, "a").join(of_b, "b").where("ca <> cb"), "open-links")
        if open_.isEmpty():
            return labels
        least = open_.groupBy(F.col("ca").alias("comp")).agg(F.min("cb").alias("least"))
        moved = labels.join(least, "comp", "left").select("cls", F.least("comp", F.coalesce("least", "comp")).alias("comp"))
        jump = moved.select(F.col("cls").alias("comp"), F.col("comp").alias("further"))
        labels = written(moved.join(jump, "comp").select("cls", F.col("further").alias("comp")), "labels")
    raise RuntimeError("the links did not settle; raise most_rounds")


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """Every class with its component; without links it is its own."""
    return members.join(components(links), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))


def _likely(shared: DataFrame, ends: DataFrame, percent: int) -> DataFrame:
    """The pairs of classes ``a, b`` that can reach the likeness, of those keyed ``a, na, b, nb`` (key and set size), given ``o``
    shared shingles in their prefixes, the last at places ``la`` and ``lb``.  ``ends``: class, parities and prefix end of ``key, n``.  Both hold their shingles in one order, so only what follows the last shared place can be
    shared too; and the prefix that ends first in that order was compared whole, so of that set only the rest."""
    need = F.ceil((F.col("na") + F.col("nb")) * percent / (100.0 + percent) - 1e-9)
    # the smaller set's rest is a bound that needs no further look at the pair
    rough = F.col("o") + F.least(F.col("na") - F.col("la") - 1, F.col("nb") - F.col("lb") - 1, F.ceil(F.greatest("na", "nb") * percent / 100.0 - 1e-9) - 1)
    pairs = shared.where(rough >= need)
    for side in "ab":
        pairs = pairs.join(ends.select(F.col("key").alias(side), F.col("n").alias(f"n{side}"), F.col("cls").alias(f"cls_{side}"), F.col("sig").alias(f"sig_{side}"), F.col("ends").alias(f"ends_{side}")), [side, f"n{side}"])
    pairs = pairs.where(_alike(F.col("sig_a"), F.col("sig_b"), F.col("na") + F.col("nb"), percent))
    first = F.when(F.col("ends_a") <= F.col("ends_b"), F.col("na")).otherwise(F.col("nb"))
    return pairs.where(F.col("o") + F.ceil(first * percent / 100.0 - 1e-9) - 1 >= need).select(F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b"))


def _mixed(lists: DataFrame, labels: DataFrame, key: list[str]) -> DataFrame:
    """The entries, groups still, of the lists that hold several components."""
    spans = labels.groupBy(*key).agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    several = lists.select("s", *key).join(spans, key).groupBy("s").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("s")
    return lists.join(several, "s", "left_semi")


def _sparse(entries: DataFrame, ends: DataFrame, percent: int) -> DataFrame:
    """Few pairs of different groups (``key``): in every list and size band each meets the first and the one before it in an
    order by hash.  Lists where a pair does not meet are not counted for its bound, so this may drop pairs that the last
    round looks at again."""
    place = F.struct("key", "comp", "n", "at")
    order = Window.partitionBy("s", "band").orderBy(F.xxhash64("key"), "key")
    met = entries.select(F.first(place).over(order).alias("x"), F.lag(place).over(order).alias("y"), place.alias("z"))
    met = met.select("z", F.explode(F.array_distinct(F.array("x", "y"))).alias("x")).where(F.col("x.comp") != F.col("z.comp"))
    first = F.col("x.key") < F.col("z.key")
    pick = {f"{c}{k}": F.when(first if k == "a" else ~first, F.col(f"x.{c}")).otherwise(F.col(f"z.{c}")) for c in ("key", "n", "at") for k in "ab"}
    shared = met.select(*[c.alias(k) for k, c in pick.items()]).groupBy(F.col("keya").alias("a"), F.col("keyb").alias("b"), "na", "nb").agg(
        F.count(F.lit(1)).alias("o"), F.max("ata").alias("la"), F.max("atb").alias("lb")
    )
    return _likely(shared.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent), ends, percent)


def _spread(entries: DataFrame, ends: DataFrame, percent: int, seed: int) -> DataFrame:
    """Pairs ``a, b`` of classes in different components that can reach the likeness, few: in every list and size band each class meets the first
    and the one before it, in an order of the list's own, so that a class of many lists meets many others."""
    place = F.struct("cls", "comp", "n", "at")
    order = Window.partitionBy("s", "band").orderBy(F.xxhash64(F.lit(seed), "s", "cls"), "cls")
    met = entries.select(F.first(place).over(order).alias("x"), F.lag(place).over(order).alias("y"), place.alias("z"))
    met = met.select("z", F.explode(F.array_distinct(F.array("x", "y"))).alias("x")).where(F.col("x.comp") != F.col("z.comp"))
    n, left = F.col("x.n") + F.col("z.n"), F.least(F.col("x.n") - F.col("x.at"), F.col("z.n") - F.col("z.at"))
    pairs = met.where(left * (100 + percent) >= n * percent)  # see _across
    pairs = pairs.select(F.least("x.cls", "z.cls").alias("a"), F.greatest("x.cls", "z.cls").alias("b"), n.alias("sizes")).distinct()
    for side in "ab":
        pairs = pairs.join(ends.select(F.col("cls").alias(side), F.col("sig").alias(f"sig_{side}")), side)
    return pairs.where(_alike(F.col("sig_a"), F.col("sig_b"), F.col("sizes"), percent)).select("a", "b")


def _sided(entries: DataFrame, key: list[str]) -> DataFrame:
    """The entries of lists (``key``) with several components, each with whether it is ``minor``: outside the list's largest component."""
    by_comp = entries.groupBy(*key, "comp").agg(F.count(F.lit(1)).alias("k"))
    largest = by_comp.groupBy(*key).agg(F.max_by("comp", F.struct("k", "comp")).alias("major"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    return entries.join(largest.select(*key, "major"), key).withColumn("minor", F.col("comp") != F.col("major"))


def _across(entries: DataFrame, ends: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of classes in different components that can reach the likeness, all of them: those of a list's largest component do
    not meet one another there.

    Sets that link need 6/7 (at 75 percent) of their mean size in common, and what they share starts with the first shingle that both
    have in the common order.  In that list at least this much is left of both, so the smaller set has had at most 1/7 of
    its shingles before; entries further on only wait for smaller sets.  A list where the rest is too short is not that list.
    Parities drop most of what meets.
    """
    rows = _sided(entries, ["s"])
    rest = (F.col("n") - F.col("at")) * (100 + percent)
    starts = rest >= F.col("n") * 2 * percent  # may be the smaller one
    open_ = rows.where(starts).select("s").distinct()
    rows = rows.join(open_, "s", "left_semi").withColumn("starts", starts).join(ends.select("cls", "sig"), "cls")
    side = {i: [F.col(c).alias(f"{i}_{c}") for c in ("cls", "comp", "n", "at", "sig")] for i in "xy"}
    bands = F.array(*[F.struct((F.col("band") + i).alias("band"), F.lit(m).alias("minor")) for i in (0, 1) for m in (True, False)])
    met = F.filter(bands, lambda x: F.col("minor") | x["minor"])
    x = rows.where("starts").select("s", F.explode(met).alias("meet"), *side["x"])
    y = rows.select("s", F.struct("band", "minor").alias("meet"), *side["y"])
    left = F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at"))
    both = F.col("x_n") + F.col("y_n")
    pairs = x.join(y, ["s", "meet"]).where(
        (F.col("x_comp") != F.col("y_comp")) & (F.struct("x_n", "x_cls") < F.struct("y_n", "y_cls")) & (F.col("x_n") * 100 >= F.col("y_n") * percent)
        & (left * (100 + percent) >= both * percent) & _alike(F.col("x_sig"), F.col("y_sig"), both, percent)
    )
    return pairs.select(F.least("x_cls", "y_cls").alias("a"), F.greatest("x_cls", "y_cls").alias("b")).distinct()


def _within(labels: DataFrame, ends: DataFrame, key: list[str], percent: int) -> DataFrame:
    """Pairs ``a, b`` of classes of one group (``key``) but different components that can reach the likeness."""
    rows = _sided(labels, key).join(ends.select("cls", "sig"), "cls")
    side = {i: [F.col(c).alias(f"{i}_{c}") for c in ("cls", "comp", "minor", "sig")] for i in "xy"}
    pairs = rows.where("minor").select(*key, *side["x"]).join(rows.select(*key, *side["y"]), key).where(
        (F.col("x_comp") != F.col("y_comp")) & (~F.col("y_minor") | (F.col("x_cls") < F.col("y_cls"))) & _alike(F.col("x_sig"), F.col("y_sig"), F.col("n") * 2, percent)
    )
    return pairs.select(F.least("x_cls", "y_cls").alias("a"), F.greatest("x_cls", "y_cls").alias("b"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, often_from: int = 16, most_common: int = 1 << 21) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id``, ``set_digest`` (its class: rows of equal sets are one) and
    ``link_digest`` (a class that its class links with, verified; null where it links with none).

    Two texts link when 100 * |intersection| >= percent * |union| of their shingle sets; ``component_id`` is the smallest
    id reachable by links, itself included.  Sets without shingles link with nothing, not even one another.

    Equal sets are one class.  Classes of equal size and equal prefix are one group, and only groups meet: on the shingles of
    their prefixes, in a common order that puts frequent shingles last.  First every group meets the first of each of its
    lists and one neighbour there, and every class the first of its group; what verifies is contracted.  Lists that still
    hold several components do the same again, member by member, in another order.  Last, all pairs of one list in
    different components meet, apart from those between members of its largest component; bounds from their places in the list and
    from the parities of the sets drop most, and the rest is verified.  So a group of near copies costs pairs in proportion to its size,
    and no link between different components is missed.  The links kept by the way connect each component; ``link_digest``
    is one of them, so that every membership can be checked.

    Null text is empty.  A null id is never a component's id while another is there.  Repeated rows are returned as often as
    they come.  An empty table gives no rows.  Other columns are not read.
    """
    return _joined(docs, id_col, text_col, size, percent, often_from, most_common).drop("_comp")


def _joined(docs: DataFrame, id_col: str, text_col: str, size: int = 5, percent: int = 75, often_from: int = 16, most_common: int = 1 << 21, spreads: int = 2) -> DataFrame:
    """See jaccard_join; with ``_comp``, which tells components apart whose smallest ids are equal."""
    common = common_shingles(docs, text_col, size, often_from, most_common)
    signed = _signed(docs, id_col, text_col, size, percent, common)
    key = ["grp", "n"]
    members = signed.where("n > 0").groupBy("cls", *key).agg(F.min("p").alias("p"), F.first("sig").alias("sig"), F.min(F.struct("tail", "end")).alias("ends"))  # every different set
    members = written(members, "classes")
    groups = members.groupBy(*key).agg(F.min("cls").alias("rep"), F.min_by("sig", "cls").alias("sig"), F.min("ends").alias("ends"))  # one prefix has one end
    ends = members.select(F.col("cls").alias("key"), "n", "cls", "sig", "ends")

    # lists: the groups of a shingle, by size band; a list of one group is dropped
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    postings = signed.where(F.col("prefix").isNotNull()).select(*key, F.posexplode("prefix").alias("at", "s"))
    entry = F.struct("grp", "n")
    in_list = Window.partitionBy("s").orderBy(band, *key)
    whole = in_list.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = postings.withColumns({"before": F.lag(entry).over(in_list), "low": F.first(entry).over(whole), "high": F.last(entry).over(whole)})
    live = seen.where((F.col("low") != F.col("high")) & ~F.coalesce(F.col("before") == entry, F.lit(False)))
    live = written(live.select("s", *key, "at", band.alias("band")), "lists")
    inside = members.select("cls", *key, F.col("sig").alias("own")).join(groups, key).where((F.col("cls") != F.col("rep")) & _alike(F.col("own"), F.col("sig"), F.col("n") * 2, percent)).select(F.col("rep").alias("a"), F.col("cls").alias("b"))
    apart = live.select("s", "band", F.col("grp").alias("key"), F.col("grp").alias("comp"), "n", "at")
    pairs = _sparse(apart, groups.select(F.col("grp").alias("key"), "n", F.col("rep").alias("cls"), "sig", "ends"), percent)
    pairs = written(pairs.unionAll(inside).distinct(), "pairs")

    def sets(wanted: DataFrame) -> DataFrame:
        return _sets(docs, id_col, text_col, size, wanted)

    links = _verified(pairs, members, percent, sets)

    # what is still apart in some list meets others there, in other orders; a list of one component stays one
    labels = written(_labelled(members.select("cls", *key), links), "labelled")
    live = written(_mixed(live, labels, key), "mixed-lists")
    for seed in range(1, spreads + 1):
        entries = live.join(labels, key).select("s", "band", "cls", "comp", "n", "at")
        more = written(_spread(entries, ends, percent, seed).join(pairs, ["a", "b"], "left_anti"), "pairs")
        if more.isEmpty():
            break
        pairs, links = pairs.unionAll(more), links.unionAll(_verified(more, members, percent, sets))
        labels = written(_labelled(members.select("cls", *key), links), "labelled")
        live = written(_mixed(live, labels, key), "mixed-lists")

    # last round: all pairs of a list in different components
    entries = written(live.join(labels, key).select("s", "band", "cls", "comp", "n", "at"), "entries")
    close = _across(entries, ends, percent)
    within = _within(labels, ends, key, percent)
    rest = written(close.unionAll(within).distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
    if not rest.isEmpty():
        links = links.unionAll(_verified(rest, members, percent, sets))
        labels = _labelled(members.select("cls", *key), links)

    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    one_link = both.groupBy(F.col("a").alias("cls")).agg(F.min("b").alias("link"))
    labels = written(labels.select("cls", "comp").join(one_link, "cls", "left"), "labelled")
    rows = signed.select("id", "n", "cls")
    full = rows.where("n > 0").join(labels, "cls")
    least = full.groupBy("comp").agg(F.min("id").alias("component_id"))
    full = full.join(least, "comp").select("id", "n", "component_id", "link", "cls", "comp")
    empty = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"), F.lit(None).cast("binary").alias("link"), "cls", F.col("cls").alias("comp"))
    return full.unionAll(empty).select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id", F.lower(F.hex("cls")).alias("set_digest"), F.lower(F.hex("link")).alias("link_digest"), F.col("comp").alias("_comp"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component: the one with the component's id (of its rows with that id, the smallest by a
    hash of the row).  Documents without words are each their own; so are rows with a null id.  Rows that share an id but
    not their set are told apart by the set's digest."""
    found = _joined(docs, id_col, text_col, **options).select(F.col(id_col).alias("_i"), F.col("component_id").alias("_c"), F.col("set_digest").alias("_d"), "_comp")
    found = written(found, "components")
    several = found.where("_i IS NOT NULL").groupBy("_i").agg(F.min("_d").alias("_low"), F.max("_d").alias("_high")).where("_low <> _high").select("_i")
    several = written(several, "several-sets")
    dropped = found.where("_i <> _c").select("_i").unionAll(several).distinct().withColumnRenamed("_i", id_col)
    same = Window.partitionBy(id_col).orderBy(row_hash(docs.columns))
    kept = docs.join(dropped, id_col, "left_anti").withColumn("_nth", F.row_number().over(same))
    kept = kept.where((F.col("_nth") == 1) | F.col(id_col).isNull()).select(*docs.columns)
    if several.isEmpty():
        return kept

    size = options.get("size", 5)

    def digest(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: hashlib.blake2b(shingle_set(x, size).tobytes(), digest_size=16).hexdigest())

    shared = docs.join(several.withColumnRenamed("_i", id_col), id_col, "left_semi")
    shared = shared.withColumn("_d", F.pandas_udf(digest, "string")(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    stay = found.where("_i = _c").select(F.col("_i").alias(id_col), "_d", "_comp").distinct()
    same = Window.partitionBy(id_col, "_comp").orderBy(row_hash(docs.columns))
    shared = shared.join(stay, [id_col, "_d"]).withColumn("_nth", F.row_number().over(same)).where("_nth = 1")
    return kept.unionByName(shared.select(*docs.columns))
