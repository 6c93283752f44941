"""URL rules in a sorted array of 64-bit digests: memory-mapped, probed by vectorised binary search."""
from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import lower_ascii


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class RuleIndex:
    """Three files in one folder: sorted digests, offsets of the stored strings in the same order, and the strings.

    A rule is ``host/path``.  The files are shipped by Spark to every executor and mapped, never loaded: a probe touches
    the pages of its binary search only, and Python workers of one machine share them.
    """

    def __init__(self, name: str, path_lengths: Sequence[int], longest_host: int):
        self.name, self.path_lengths, self.longest_host = name, tuple(path_lengths), longest_host
        self._open = None

    @classmethod
    def build(cls, spark: SparkSession, rules: Iterable[tuple[str, str, str]], max_bytes: int = 1 << 30) -> RuleIndex:
        """``rules``: (verdict, host, path); the same host and path once.  More than ``max_bytes`` is an error: use
        :func:`judge_by_join` for rule sets of that size."""
        rows = sorted({(xxhash.xxh64_intdigest(f"{h}{p}".encode()), f"{h}{p}".encode(), v, len(p)) for v, h, p in rules})
        if len({r[1] for r in rows}) < len(rows):
            raise ValueError("a rule is given twice, with different verdicts")
        body = b"".join(r[1] for r in rows)
        if len(body) + 16 * len(rows) > max_bytes:
            raise ValueError(f"{len(rows)} rules exceed max_bytes; judge_by_join shuffles instead")
        name = f"rules-{uuid.uuid4().hex}.idx"
        keys = np.array([r[0] for r in rows], np.uint64)
        ends = np.cumsum([0, *[len(r[1]) for r in rows]]).astype(np.int64)
        verdicts = np.array([r[2] == "allow" for r in rows], np.uint8)
        # the driver's file server hands the staged file to every executor; no executor reads this folder
        staged = os.path.join(tempfile.mkdtemp(prefix="spark-rules-"), name)
        with open(staged, "wb") as out:
            out.write(np.int64(len(rows)).tobytes() + keys.tobytes() + ends.tobytes() + verdicts.tobytes() + body)
        spark.sparkContext.addFile(staged)
        return cls(name, sorted({r[3] for r in rows}), max((len(r[1].decode()) - r[3] for r in rows), default=0))

    def __getstate__(self):
        return {**self.__dict__, "_open": None}

    def _arrays(self):
        if self._open is None:
            path = SparkFiles.get(self.name)
            n = int(np.fromfile(path, np.int64, 1)[0])
            at = 8 + 8 * n
            keys = np.memmap(path, np.uint64, "r", 8, n) if n else np.empty(0, np.uint64)
            ends = np.memmap(path, np.int64, "r", at, n + 1)
            verdicts = np.memmap(path, np.uint8, "r", at + 8 * (n + 1), n) if n else np.empty(0, np.uint8)
            start = at + 8 * (n + 1) + n
            body = np.memmap(path, np.uint8, "r", start) if os.path.getsize(path) > start else np.empty(0, np.uint8)
            self._open = keys, ends, verdicts, body
        return self._open

    def probe(self, texts: list[bytes]) -> np.ndarray:
        """Position of each text's rule, or -1.  Equal digests are walked until the stored string matches."""
        keys, ends, _, body = self._arrays()
        digests = np.fromiter(map(xxhash.xxh64_intdigest, texts), np.uint64, len(texts))
        at = np.searchsorted(keys, digests)
        out = np.full(len(texts), -1, np.int64)
        for i in np.flatnonzero((at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == digests)) if len(keys) else ():
            j = int(at[i])
            while j < len(keys) and keys[j] == digests[i]:
                if bytes(body[ends[j]:ends[j + 1]]) == texts[i]:
                    out[i] = j
                    break
                j += 1
        return out

    def rule(self, position: int) -> tuple[str, str]:
        _, ends, verdicts, body = self._arrays()
        return bytes(body[ends[position]:ends[position + 1]]).decode(), "allow" if verdicts[position] else "block"


def _suffixes(host: str, longest: int) -> list[str]:
    """The host and its parent domains, longest first, of at most ``longest`` characters: no rule has a longer host."""
    out = [host] if len(host) <= longest else []
    at = host.find(".", max(0, len(host) - longest - 1))
    while at >= 0:
        out.append(host[at + 1:])
        at = host.find(".", at + 1)
    return out


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]], url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``; columns of these names are replaced.

    A rule fits its host and all subdomains when the url's path starts with the rule's.  The longest rule wins (of equal
    length, the longer host); without one ``rule`` is null and the verdict ``default``.  Null urls and urls without
    ``://`` have an empty host and path and fit no rule that has a host.
    """
    index = RuleIndex.build(pages.sparkSession, rules)

    def longest(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            owner, asked = [], []
            for i, (host, path) in enumerate(zip(hosts, paths)):
                heads = [path[:n] for n in index.path_lengths if n <= len(path)]
                for suffix in _suffixes(host, index.longest_host):
                    for head in heads:
                        owner.append(i)
                        asked.append((suffix + head).encode("utf-8", "surrogatepass"))
            found = index.probe(asked)
            best: list[int] = [-1] * len(hosts)
            for k in np.flatnonzero(found >= 0):  # longer hosts come first, so a tie keeps the longer host
                i = owner[k]
                if best[i] < 0 or len(asked[k]) > len(asked[best[i]]):
                    best[i] = k
            named = [index.rule(int(found[k])) if k >= 0 else (None, default) for k in best]
            yield pd.DataFrame({"rule": [r for r, _ in named], "verdict": [v for _, v in named]}, dtype=object)

    matched = F.pandas_udf(longest, "rule string, verdict string")
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict") or c == url_col]
    out = pages.select(*kept, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    return out.withColumn("_m", matched("host", "path")).select(*kept, "host", "path", "_m.rule", "_m.verdict")


def judge_by_join(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """The same verdicts for rule sets too large to ship, ``rules``: verdict, host, path.  Distinct (host, path) pairs meet
    the rules on the host's suffixes, so a hot host is one entry per path."""
    urls = pages.select(host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")).distinct()
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    asked = urls.withColumn("_suffix", F.explode(suffixes))
    r = rules.select(F.col("host").alias("_suffix"), F.col("path").alias("_path"), F.col("verdict").alias("_verdict"))
    fits = asked.join(r, "_suffix").where(F.startswith("path", "_path"))
    rank = F.struct(F.length(F.concat("_suffix", "_path")), F.length("_suffix"))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("_suffix", "_path").alias("rule"), F.col("_verdict").alias("verdict")), rank).alias("_m"))
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict") or c == url_col]
    out = pages.select(*kept, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    return out.join(best, ["host", "path"], "left").select(*kept, "host", "path", "_m.rule", F.coalesce("_m.verdict", F.lit(default)).alias("verdict"))
