"""Document fingerprints: a Merkle tree over sections, paragraphs and content-defined leaves."""
from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import blocks_for

SKETCH = 64  # smallest leaf digests kept in a fingerprint
_R = 0x9E3779B97F4A7C15
_INV = pow(_R, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    """Powers of the leaf hash's base and of its inverse, as far as the longest text so far."""

    up, down = _powers(_R, 1 << 16), _powers(_INV, 1 << 16)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            size = 1 << n.bit_length()
            cls.up, cls.down = _powers(_R, size), _powers(_INV, size)
        return cls.up, cls.down


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


@dataclass
class Tree:
    """``data`` as a tree.  Paragraphs are lines; a section ends at an empty line or after a paragraph whose digest begins
    with four zero bits, so an insertion moves no later boundary; leaves end at line ends and where the last four bytes
    hash to zero, about every 16 bytes.  A paragraph's digest covers its bytes, a section's its paragraphs' digests, the
    root's the sections'."""

    data: bytes

    @cached_property
    def paragraphs(self) -> list[tuple[int, int, bytes]]:
        """(start, end, digest), the line end included in the span."""
        out, at = [], 0
        for line in self.data.split(b"\n"):
            out.append((at, min(at + len(line) + 1, len(self.data)), _digest(line)))
            at += len(line) + 1
        return out

    @cached_property
    def sections(self) -> list[tuple[int, int, bytes]]:
        """(first paragraph, past the last, digest)."""
        out, first, digests = [], 0, []
        for i, (start, end, d) in enumerate(self.paragraphs):
            digests.append(d)
            if end - start <= 1 or d[0] < 16 or i == len(self.paragraphs) - 1:
                out.append((first, i + 1, _digest(b"".join(digests))))
                first, digests = i + 1, []
        return out

    @cached_property
    def root(self) -> bytes:
        return _digest(b"".join(d for _, _, d in self.sections))

    @cached_property
    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and 64-bit hashes."""
        n = len(self.data)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        b = np.frombuffer(self.data, np.uint8)
        stop = b == 10
        if n > 4:
            w = b.astype(np.uint32)
            w = w[3:] | (w[2:-1] << np.uint32(8)) | (w[1:-2] << np.uint32(16)) | (w[:-3] << np.uint32(24))
            stop[3:] |= (w * np.uint32(0x9E3779B1)) >> np.uint32(28) == 0
        ends = np.flatnonzero(stop) + 1
        if not len(ends) or ends[-1] != n:
            ends = np.append(ends, n)
        starts = np.concatenate([[0], ends[:-1]])
        up, down = _Powers.to(n + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
        h = (total[ends] - total[starts]) * down[starts]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return starts, h ^ (h >> np.uint64(29))

    @cached_property
    def fingerprint(self) -> str:
        """Root digest in hex, a colon, and in base64 the smallest different leaf hashes, 32 bits each."""
        small = np.unique((self.leaves[1] >> np.uint64(32)).astype(np.uint32))[:SKETCH]
        return self.root.hex() + ":" + base64.b64encode(small.tobytes()).decode()


def likeness(a: str, b: str) -> float:
    """Of two fingerprints, 0 to 1: 1 if the roots agree, else the share of leaves they have in common, estimated from the
    smallest hashes of the union (exact while both texts have few leaves)."""
    if a[:32] == b[:32]:
        return 1.0
    x, y = (np.frombuffer(base64.b64decode(f[33:]), np.uint32) for f in (a, b))
    union = np.union1d(x, y)[:SKETCH]
    if not len(union):
        return 0.0
    both = len(np.intersect1d(np.intersect1d(x, y, True), union, True))
    return 2 * both / (len(union) + both)


def differing(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """Byte spans of ``b`` that ``a`` has nowhere, found by descending only into branches whose digest ``a`` lacks."""
    if a.root == b.root:
        return []
    known_sections, known = {d for _, _, d in a.sections}, {d for _, _, d in a.paragraphs}
    open_ = [b.paragraphs[i] for first, past, d in b.sections if d not in known_sections for i in range(first, past)]
    open_ = [(s, e) for s, e, d in open_ if d not in known and e > s]
    if not open_:
        return []
    starts, hashes = b.leaves
    new = ~np.isin(hashes, a.leaves[1])
    ends = np.append(starts[1:], len(b.data))
    first = np.searchsorted(starts, [s for s, _ in open_])
    past = np.searchsorted(starts, [e for _, e in open_])
    out: list[tuple[int, int]] = []
    for f, p in zip(first, past):
        for k in np.flatnonzero(new[f:p]) + f:
            s, e = int(starts[k]), int(ends[k])
            if out and out[-1][1] == s:
                out[-1] = (out[-1][0], e)
            else:
                out.append((s, e))
    return out


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many of the following text, or all of it."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _ordered_with_next(docs: DataFrame, id_col: str, text_col: str, block_rows: int, most_blocks: int) -> DataFrame:
    """``block, ahead, id, has_id, text``: rows sorted by descending id within blocks, each block followed by the next block's
    first row (``ahead`` 1), the last one by the first of all.  Texts are shuffled once."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    n = min(most_blocks, blocks_for(docs.count(), block_rows))
    ranks = [i / n for i in range(1, n)] or [0.5]
    bounds = rows.agg(F.percentile_approx("id", ranks, 100_000).alias("q")).first()["q"] or []
    edges = F.array(*[F.lit(int(x)) for x in sorted(set(bounds))]) if bounds else F.array().cast("array<bigint>")
    # the number of bounds below an id, counted from the largest ids on; null ids come last
    above = F.size(edges) - F.size(F.filter(edges, lambda e: e < F.col("id")))
    rows = rows.withColumn("block", F.when(F.col("id").isNull(), F.size(edges) + 1).otherwise(above)).withColumn("h", F.xxhash64("text"))
    firsts = rows.groupBy("block").agg(F.max(F.struct("id", "h")).alias("f")).orderBy("block").collect()
    order = [r["block"] for r in firsts]
    before = {b: order[i - 1] for i, b in enumerate(order)}  # the first block's predecessor is the last
    heads = docs.sparkSession.createDataFrame([(r["block"], r["f"]["id"], r["f"]["h"], before[r["block"]]) for r in firsts], "block int, id long, h long, to int")
    marked = rows.join(F.broadcast(heads.withColumnsRenamed({"id": "hid", "h": "hh"})), "block")
    ahead = F.array(F.struct(F.col("to").alias("block"), F.lit(1).alias("ahead")))
    own = F.array(F.struct("block", F.lit(0).alias("ahead")))
    head = F.col("id").eqNullSafe(F.col("hid")) & (F.col("h") == F.col("hh"))
    placed = marked.select(F.explode(F.when(head, F.concat(own, ahead)).otherwise(own)).alias("p"), "id", "h", "text")
    placed = placed.select("p.block", "p.ahead", F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNotNull().alias("has_id"), "h", "text")
    return placed.repartition("block").sortWithinPartitions("block", "ahead", F.col("has_id").desc(), F.col("id").desc(), F.col("h").desc())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_rows: int = 500, most_blocks: int = 4_096) -> DataFrame:
    """One row per row of ``docs``: id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``,
    ``near_next`` and ``edit_at`` (code point where the first differing branch of the edited tree begins; null if none).

    The edited text is the text with its last third replaced by the first code points of the next document in descending id
    order (after the last: the first; alone: itself).  Rows of equal id follow one another by a hash of their text.  Blocks
    of ids are cut at quantiles, at most ``most_blocks``, and streamed in order: a task holds two texts at a time.

    Null texts are empty; the empty text's fingerprint is that of one empty paragraph.  Null ids come last and are returned
    as null.  An empty table gives no rows.
    """
    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], FINGERPRINT_SCHEMA.format(id=id_col))

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = None
        for b in batches:
            out = []
            for block, ahead, id_, has_id, text in zip(b["block"], b["ahead"], b["id"], b["has_id"], b["text"]):
                here = (block, ahead, id_ if has_id else None, text, Tree(text.encode("utf-8", "surrogatepass")))
                if before is not None and before[0] == block and not before[1]:
                    out.append(_fingerprinted(before, here))
                before = here
            yield pd.DataFrame(out, columns=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edit_at"]).astype({"id": "Int64", "edit_at": "Int64"})

    rows = _ordered_with_next(docs, id_col, text_col, block_rows, most_blocks)
    return rows.mapInPandas(stream, FINGERPRINT_SCHEMA.format(id="id")).withColumnRenamed("id", id_col)


FINGERPRINT_SCHEMA = "{id} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edit_at long"


def _fingerprinted(own: tuple, following: tuple) -> tuple:
    _, _, id_, text, tree = own
    data = edited(text, following[3]).encode("utf-8", "surrogatepass")
    changed = Tree(data)
    spans = differing(tree, changed)
    at = len(data[: spans[0][0]].decode("utf-8", "ignore")) if spans else None
    return (
        id_, len(text), hashlib.sha256(data).hexdigest(), tree.fingerprint, changed.fingerprint,
        likeness(tree.fingerprint, changed.fingerprint), likeness(tree.fingerprint, following[4].fingerprint), at,
    )
