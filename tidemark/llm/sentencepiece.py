"""SentencePiece encoding and decoding: best paths of the unigram lattice, giant texts by a max-plus parallel scan."""
from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fresh
from tidemark.llm.lattice import NEG, SPACE, Lattice, Vocabulary, max_plus

UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
RESULT = ("ids", "n_tokens", "path_score", "round_trip")
AT_ONCE = 1 << 20  # bytes of text that a worker encodes at a time, whatever the size of Spark's batches
_ENCODERS: dict[int, Encoder] = {}


class Encoder:
    """Encodes texts in a Python worker.  Segmentations of short units are kept from batch to batch, in flat arrays, and dropped
    when there are more than ``kept`` of them."""

    def __init__(self, model: bytes, kept: int = 100_000):
        self.vocab = Vocabulary.read(model)
        self.kept = kept
        self._forget()
        self.bytes_of = [p.replace(SPACE, " ").encode() for p in self.vocab.pieces]
        for b, i in enumerate(self.vocab.byte_ids.tolist()):
            self.bytes_of[i] = bytes([b])

    @cached_property
    def lattice(self) -> Lattice:
        return Lattice(self.vocab)

    @classmethod
    def here(cls, sent: Broadcast) -> Encoder:
        """One encoder per worker process; a worker runs many tasks."""
        key = hash(sent.value)
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = cls(sent.value)
        return _ENCODERS[key]

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.tokens, self.lens, self.scores = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0)

    def units(self, marked: str) -> list[str]:
        """The stretches between places that no piece crosses."""
        return UNITS.findall(marked) if self.lattice.cuts_at_spaces else [marked] if marked else []

    def paths(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best paths of marked texts: ids of all texts one after the other, where each text's begin and end, and scores."""
        split = [self.units(t) for t in texts]
        if len(self.known) > self.kept:
            self._forget()
        new = list(set(chain.from_iterable(split)).difference(self.known))
        places, tokens, lens, scores = self.lattice.viterbi(new)
        base = len(self.known)
        self.known.update(zip([new[i] for i in places.tolist()], range(base, base + len(new))))
        self.tokens, self.lens, self.scores = np.concatenate([self.tokens, tokens]), np.concatenate([self.lens, lens]), np.concatenate([self.scores, scores])
        per = np.fromiter(map(len, split), np.int64, len(split))
        used = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, int(per.sum()))
        start = np.cumsum(self.lens) - self.lens
        count = self.lens[used]
        ends = np.cumsum(count)
        flat = self.tokens[np.repeat(start[used] - (ends - count), count) + np.arange(int(count.sum()))]
        unit_edges = np.concatenate([[0], np.cumsum(per)])
        edges = np.concatenate([[0], ends])[unit_edges]
        sums = np.concatenate([[0.0], np.cumsum(self.scores[used])])[unit_edges]
        if base + len(new) > self.kept:
            self._forget()
        return flat, edges, np.diff(sums)

    def matrix(self, part: str, size: int) -> np.ndarray:
        """Boundary-state matrix of a chunk of ``size`` characters, followed in ``part`` by what the next chunk begins with.

        State i at a boundary: the piece that crosses it ends i characters after it.  Between the first and the last cut
        inside the chunk every path takes the same places, so only the two ends are run for all states, and what lies
        between is left out: it adds the same to every entry, which chooses nothing, and the backtrace adds its score up."""
        w = self.lattice.width
        cuts = [c for c in self.lattice.cuts(part) if c <= size]
        if cuts:
            first, last = cuts[0], cuts[-1]
            head = self.lattice.between(part[:first], w, first)[:, :1]
            found = head + self.lattice.between(part[last:], 1, size - last)
        else:
            found = self.lattice.between(part, w, size)
        out = np.full((w, w), NEG)
        out[:, : found.shape[1]] = found
        return out

    def spells(self, flat: np.ndarray, edges: np.ndarray, marked: list[str]) -> np.ndarray:
        """Whether the ids between the edges decode to the marked texts again."""
        pieces, at = [self.bytes_of[i] for i in flat.tolist()], edges.tolist()
        return np.array([b"".join(pieces[a:z]) == t.replace(SPACE, " ").encode("utf-8", "surrogatepass") for a, z, t in zip(at, at[1:], marked)], bool)

    def text(self, ids) -> str:
        """The text of ids: byte pieces joined, space marks back to spaces, the added first space removed."""
        raw = b"".join([self.bytes_of[i] for i in ids])
        return raw.decode("utf-8", "replace")[1:]


def portions(texts: pa.Array, most: int = AT_ONCE) -> Iterator[slice]:
    """Stretches of a batch of about ``most`` bytes of text, one text at least: what a worker holds besides the batch (its units,
    their places, pieces) is many times its text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, before = 0, 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield slice(start, stop)
        start, before = stop, int(ends[stop - 1])


def _arrow(flat: np.ndarray, edges: np.ndarray, scores: np.ndarray, same: np.ndarray) -> pa.StructArray:
    ids = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat, pa.int32()))
    return pa.StructArray.from_arrays([ids, pa.array(scores), pa.array(same)], ["ids", "path_score", "round_trip"])


def mark(text: str) -> str:
    """Spaces become marks, one more in front; an empty text stays empty."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def _sent(spark: SparkSession, model_path: str) -> Broadcast:
    """The model file goes to the tasks from the driver; its size is the vocabulary's, whatever the corpus."""
    with open(model_path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model_path: str, text_col: str = "text", chunk: int = 16_384, fan: int = 64) -> DataFrame:
    """``docs`` with ``ids`` (array of int), ``n_tokens``, ``path_score`` and ``round_trip`` (whether the ids decode to the text
    again), of the segmentation whose pieces' scores sum highest.

    Any SentencePiece file with byte pieces serves; its pieces and scores are read as a unigram vocabulary.  Spaces become
    marks, one is put in front, nothing else is normalised; unknown characters are spelled in bytes.  Of equal scores the
    longest last piece of a unit wins, and the shortest overhang at the boundary of a chunk.

    Texts above ``chunk`` characters are cut into chunks: each gives a boundary-state matrix, the matrices of a text are
    combined associatively, ``fan`` at a time, level by level, the chosen states travel back down the same tree, and each chunk
    is then backtraced by itself, in any task.  Copies of a giant text are encoded once.

    Null and empty texts have no ids and score 0.  Columns named like a result are replaced, others pass through.
    """
    sent = _sent(docs.sparkSession, model_path)
    (key,) = fresh(docs, "_key")
    kept = [c for c in docs.columns if c.lower() not in RESULT or c == text_col]
    docs = docs.select(*kept)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def short(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = Encoder.here(sent)
        for texts in batches:
            found = [_arrow(np.empty(0, np.int32), np.zeros(1, np.int32), np.empty(0), np.empty(0, bool))]
            for part in portions(texts):
                plain = texts[part].to_pylist()
                marked = [mark(t) for t in plain]
                flat, edges, scores = coder.paths(marked)
                same = coder.spells(flat, edges, marked) & np.array([SPACE not in t for t in plain], bool)
                found.append(_arrow(flat, edges, scores, same))
            yield pa.concat_arrays(found)

    small = docs.where(F.length(text) <= chunk).withColumn(key, F.arrow_udf(short, "ids array<int>, path_score double, round_trip boolean")(text))
    giant = docs.where(F.length(text) > chunk).withColumn(key, F.unhex(F.sha2(text, 256)))
    whole = _giants(giant.select(F.col(key).alias("key"), text.alias("text")), sent, chunk, fan)
    out = small.select(*kept, F.col(key)["ids"].alias("ids"), F.size(F.col(key)["ids"]).cast("long").alias("n_tokens"), F.col(key)["path_score"].alias("path_score"), F.col(key)["round_trip"].alias("round_trip"))
    joined = giant.join(whole, giant[key] == whole["key"])
    return out.unionByName(joined.select(*kept, "ids", F.size("ids").cast("long").alias("n_tokens"), "path_score", (F.col("same") & ~F.contains(text, F.lit(SPACE))).alias("round_trip")))


def _giants(texts: DataFrame, sent: Broadcast, chunk: int, fan: int) -> DataFrame:
    """``key, ids, path_score`` for every different giant text."""

    def parts(batches: Iterator[pd.DataFrame], width: int):
        for batch in batches:
            for key, text in zip(batch["key"], batch["text"]):
                marked = mark(text)
                n = -(-len(marked) // chunk)
                for i in range(n):
                    yield bytes(key), i, n, marked[i * chunk:(i + 1) * chunk + width - 1]

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Encoder.here(sent)
        for key, i, n, part in parts(batches, coder.lattice.width):
            yield pd.DataFrame({"key": [key], "idx": [i], "n": [n], "m": [coder.matrix(part, min(chunk, len(part))).tobytes()]})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Encoder.here(sent)
        for key, i, _, part in parts(batches, coder.lattice.width):
            yield pd.DataFrame({"key": [key], "idx": [i], "part": [part]})

    levels = [texts.mapInPandas(matrices, "key binary, idx long, n long, m binary").dropDuplicates(["key", "idx"])]
    most = texts.agg(F.coalesce(F.max(F.length("text")), F.lit(0))).first()[0]
    count = -(-(most + 1) // chunk)
    while count > fan:
        grouped = levels[-1].withColumn("up", F.floor(F.col("idx") / fan)).groupBy("key", "up")
        levels.append(grouped.applyInPandas(_combined, "key binary, idx long, n long, m binary"))
        count = -(-count // fan)
    states = levels[-1].withColumns({"entry": F.lit(0), "exit": F.lit(0)}).groupBy("key").applyInPandas(_settled, "key binary, idx long, entry int, exit int")
    for level in reversed(levels[:-1]):
        above = states.withColumnRenamed("idx", "up")
        children = level.withColumn("up", F.floor(F.col("idx") / fan)).join(above, ["key", "up"])
        states = children.groupBy("key", "up").applyInPandas(_settled, "key binary, idx long, entry int, exit int")

    def backtrace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder.here(sent)
        for b in (batch.slice(p.start, p.stop - p.start) for batch in batches for p in portions(batch["part"])):
            stretch = [p[a:min(chunk, len(p)) + z] for p, a, z in zip(b["part"].to_pylist(), b["entry"].to_pylist(), b["exit"].to_pylist())]
            flat, edges, scores = coder.paths(stretch)
            found = _arrow(flat, edges, scores, coder.spells(flat, edges, stretch))
            yield pa.RecordBatch.from_arrays([b["key"], b["idx"], *found.flatten()], ["key", "idx", "ids", "score", "same"])

    chunks = texts.mapInPandas(cut, "key binary, idx long, part string").dropDuplicates(["key", "idx"])
    done = chunks.join(states, ["key", "idx"]).mapInArrow(backtrace, "key binary, idx long, ids array<int>, score double, same boolean")
    whole = done.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("idx", "ids"))).alias("parts"), F.sum("score").alias("path_score"), F.min("same").alias("same"))
    return whole.select("key", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"), "path_score", "same")


def _matrices(pdf: pd.DataFrame) -> list[np.ndarray]:
    flat = [np.frombuffer(m, np.float64) for m in pdf["m"]]
    return [m.reshape(int(len(m) ** 0.5), -1) for m in flat]


def _combined(pdf: pd.DataFrame) -> pd.DataFrame:
    """The product of neighbouring matrices, in order."""
    pdf = pdf.sort_values("idx")
    found = _matrices(pdf)
    total = found[0]
    for m in found[1:]:
        total = max_plus(total, m)
    up = int(pdf["up"].iloc[0])
    return pd.DataFrame({"key": [pdf["key"].iloc[0]], "idx": [up], "n": [0], "m": [total.tobytes()]})


def _settled(pdf: pd.DataFrame) -> pd.DataFrame:
    """Entry and exit state of each child, given those of the whole row of children."""
    pdf = pdf.sort_values("idx")
    found = _matrices(pdf)
    ahead = [np.full(len(found[0]), NEG)]
    ahead[0][int(pdf["entry"].iloc[0])] = 0.0
    for m in found:
        ahead.append((ahead[-1][:, None] + m).max(0))
    state, states = int(pdf["exit"].iloc[0]), []
    for m, before in zip(reversed(found), reversed(ahead[:-1])):
        entry = int(np.argmax(before + m[:, state]))
        states.append((entry, state))
        state = entry
    entries, exits = zip(*reversed(states))
    return pd.DataFrame({"key": pdf["key"].to_list(), "idx": pdf["idx"].to_list(), "entry": np.array(entries, np.int32), "exit": np.array(exits, np.int32)})


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids.  Null ids give an empty text; bytes that are no UTF-8 become U+FFFD.

    ``decode(encode(t))`` is ``t`` unless ``t`` holds U+2581, which comes back as a space."""
    sent = _sent(df.sparkSession, model_path)

    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = Encoder.here(sent)
        for ids in batches:
            flat = ids.flatten().to_numpy(zero_copy_only=False).tolist()
            edges = np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).tolist()
            yield pa.array([coder.text(flat[a:z]) for a, z in zip(edges, edges[1:])], pa.string())

    return df.withColumn(text_col, F.arrow_udf(texts, "string")(F.col(ids_col)))
