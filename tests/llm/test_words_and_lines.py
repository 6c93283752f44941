"""Line labelling, spelling variants and the divergence audit against brute force, SQL and edge cases."""
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import divergence, line_quality, queries, spelling
from tidemark.llm.line_quality import LineField, Lines

SCHEMA = "doc_id long, text string, lang string, source string, kept string, word string, n int"
JUNK = "\n".join(f"nav{i} | menu{i} | item{i} | link{i} |" for i in range(30))
SAYS = random.Random(5)
PROSE = "\n".join("The " + " ".join("".join(SAYS.choice("aeioulmnrst") for _ in range(SAYS.randint(2, 7))) for _ in range(12)) + "." for _ in range(12))
ROWS = [
    (1, PROSE, "en", "a", "x", "w", 1), (2, JUNK, "en", "a", "x", "w", 1), (3, PROSE + "\n" + "\n".join(JUNK.split("\n")[:3]), "en", "b", None, None, None),
    (3, PROSE + "\n" + "\n".join(JUNK.split("\n")[:3]), "en", "b", None, None, None), (4, None, None, None, None, None, None), (5, "", "en", "", None, None, None),
    (6, "a b c a b c a b c\n\na b c a b c a b c\n \na b c", "de", "a", None, None, None), (None, "no id, Übermäßig übermäßig", "de", "b", None, None, None),
    (7, "x" * 30_000 + " " + "Wort " * 5000, "de", "c", None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def random_field(seed):
    rng = np.random.default_rng(seed)
    crf = LineField()
    crf.weights[:] = rng.normal(0, 1, crf.weights.shape)
    crf.steps[:] = rng.normal(0, 1, (2, 2))
    crf.start[:] = rng.normal(0, 1, 2)
    return crf


def path_score(crf, emit, path):
    return crf.start[path[0]] + sum(emit[i, s] for i, s in enumerate(path)) + sum(crf.steps[a, b] for a, b in zip(path, path[1:]))


@pytest.mark.parametrize("seed", range(4))
def test_field_against_all_paths(seed):
    crf, lines = random_field(seed), Lines.of("One line.\nTwo | lines |\n\nThree three three\nfour\nOne line.\nsix six").features
    emit = crf.scores(lines)
    paths = list(itertools.product((0, 1), repeat=len(lines)))
    scores = np.array([path_score(crf, emit, p) for p in paths])
    assert list(paths[int(scores.argmax())]) == crf.decode(lines)
    state, step, log_z = crf.marginals(emit)
    share = np.exp(scores - scores.max()) / np.exp(scores - scores.max()).sum()
    assert math.isclose(log_z, scores.max() + math.log(np.exp(scores - scores.max()).sum()), rel_tol=1e-9)
    for i in range(len(lines)):
        assert math.isclose(state[i, 1], sum(w for w, p in zip(share, paths) if p[i] == 1), abs_tol=1e-9)
    for i, a, b in itertools.product(range(len(lines) - 1), (0, 1), (0, 1)):
        assert math.isclose(step[i, a, b], sum(w for w, p in zip(share, paths) if p[i:i + 2] == (a, b)), abs_tol=1e-9)


def test_fit_raises_the_likelihood():
    texts = [Lines.of(t).features for t in (PROSE, JUNK, PROSE + "\n" + JUNK)]
    states = [np.ones(12, int), np.zeros(30, int), np.r_[np.ones(12, int), np.zeros(30, int)]]
    crf = LineField().fit(texts, states, rounds=20)
    for lines, y in zip(texts, states):
        assert crf.decode(lines) == y.tolist()
        assert path_score(crf, crf.scores(lines), y.tolist()) - crf.marginals(crf.scores(lines))[2] > math.log(0.5)


def base_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_line_quality_rows(docs, none):
    crf = LineField().fit([Lines.of(PROSE).features, Lines.of(JUNK).features], [np.ones(12, int), np.zeros(30, int)])
    out = line_quality.line_quality(docs, crf)
    got = sorted(((r["doc_id"], tuple(r[c] for c in COUNTS)) for r in out.collect()), key=str)
    assert got == sorted(((r[0], base_counts(r[1])) for r in ROWS), key=str)
    kept = {r["doc_id"]: (r["kept"], len(r["content_lines"])) for r in out.collect()}
    assert kept[1] == (True, 12) and kept[2] == (False, 0) and kept[3] == (True, 12) and not kept[4][0] and not kept[5][0]
    assert line_quality.line_quality(none, crf).count() == 0
    labels = none.sparkSession.createDataFrame([], "doc_id long, quality int")
    assert line_quality.learn(docs, labels).decode(Lines.of(JUNK).features) == [1] * 30


def test_line_quality_query(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = queries.read(spark, sf, "documents"), queries.read(spark, sf, "labels")
    got = {r["doc_id"]: r for r in queries.op11_line_quality(spark, sf).collect()}
    for r in docs.select("doc_id", "text").collect():
        assert tuple(got[r["doc_id"]][c] for c in COUNTS) == base_counts(r["text"])
    crf = line_quality.learn(docs, labels, mod=4, held_fold=2)
    fold = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    held = line_quality.line_quality(docs.where(fold).join(labels, "doc_id"), crf).where("NOT base_failed").collect()
    good, bad = [r["kept"] for r in held if r["quality"] == 1], [r["kept"] for r in held if r["quality"] == 0]
    assert len(bad) >= 5 and np.mean(good) >= 0.97 and np.mean(bad) <= 0.1


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def grouped(counts, ratio=10):
    forms, out = {}, []
    for w, n in counts.items():
        others = [v for v in counts if near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= ratio * n else None
        out.append((w, n, len(others)))
    def root(w):
        return root(forms[w]) if forms[w] else w
    return sorted((w, forms[w], root(w), n, k, counts.get(forms[w])) for w, n, k in out)


def some_words(seed):
    rng, words = random.Random(seed), {}
    for _ in range(60):
        w = "".join(rng.choice("abcäÿ") for _ in range(rng.randint(1, 9)))
        words[w] = rng.choice((1, 2, 9, 10, 100, 1000, 20_000))
        for _ in range(4):
            i = rng.randrange(len(w) + 1)
            w = rng.choice((w[:i] + w[i + 1:], w[:i] + rng.choice("abcäÿ") + w[i:], w[:i] + rng.choice("abcäÿ") + w[i + 1:])) or "a"
            words[w] = rng.choice((1, 2, 10, 100, 1000))
    return words


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"part_words": 7, "max_bytes": 40_000, "cells": 50})])
def test_spelling_groups(spark, seed, options):
    counts = some_words(seed)
    rows = [(w, n) for w, n in counts.items()] + [(None, 5), ("", 5)]
    got = spelling.spelling_groups(spark.createDataFrame(rows, "word string, n long"), **options).collect()
    assert sorted(map(tuple, got)) == grouped(counts)


def test_spelling_edges(spark, docs, none):
    assert spelling.spelling_groups(none).count() == 0 and spelling.corpus_words(none).count() == 0
    odd = {"漢字漢字漢字漢": 30, "漢字漢字漢字": 3, "😀" * 7: 50, "😀" * 6 + "!": 2}
    frame = spark.createDataFrame([(w, n, 1) for w, n in odd.items()] + [("漢字漢字漢字", 0, 1)], "word string, n long, form int")
    assert sorted(map(tuple, spelling.spelling_groups(frame).collect())) == grouped(odd)
    got = {r["word"]: r["n"] for r in spelling.corpus_words(docs, least_chars=1, least_n=1, flush=10).collect()}
    assert got == damaged(((r[0], r[1]) for r in ROWS), 1, 1)
    with pytest.raises(ValueError):
        spelling.spelling_groups(frame, ratio=1)


def damaged(rows, least_chars=7, least_n=2):
    lower, seen = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least_chars:
                seen[run] += 1
    return {w: n for w, n in seen.items() if n >= least_n}


def test_spelling_query(spark):
    sf = "/root/testdata/sf0.001"
    counts = damaged(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(map(tuple, queries.op12_spelling(spark, sf).collect())) == grouped(counts)


def test_perfect_hash(monkeypatch):
    terms = [f"t{i}é".encode() for i in range(5000)]
    made = divergence.PerfectHash.build(terms)
    assert sorted(made.slots(terms).tolist()) == list(range(5000)) and made.stored()[made.slots([b"t7\xc3\xa9"])[0]] == b"t7\xc3\xa9"
    assert (made.slots([f"u{i}".encode() for i in range(20_000)]) == -1).all()
    monkeypatch.setattr(divergence, "digests", lambda terms: np.array([len(t) % 2 for t in terms], np.uint64))  # every digest collides
    same = divergence.PerfectHash.build(terms[:50])
    assert sorted(same.slots(terms[:50]).tolist()) == list(range(50)) and same.slots([b"no", b"none"]).tolist() == [-1, -1]
    assert len(divergence.PerfectHash.build([])) == 0


def test_exact_shares():
    rng = random.Random(3)
    for _ in range(200):
        total = rng.choice((1, 7, 10**6, 9 * 10**15)) + rng.randrange(100)
        n = rng.randrange(total + 1)
        assert int(divergence.scaled(np.array([n]), np.int64(total))[0]) == 10**9 * n // total


def test_pair_sums():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 3, (4, 30)) * rng.integers(0, 2, (4, 30)) * 1000
    totals = counts.sum(1) + 30
    p = [[1 + 10**9 * (int(c) + 1) // int(t) for c in row] for row, t in zip(counts, totals)]
    want = [[sum((a - b) ** 2 // b for a, b in zip(x, y)) for y in p] for x in p]
    assert divergence.pair_sums(counts, totals).tolist() == want


@pytest.mark.parametrize("options", [{}, {"shard_terms": 5, "page": 3, "max_bytes": 3_000, "flush_slots": 8}])
def test_divergence_rows(docs, spark, options):
    more = docs.select("lang", "source", "text").unionAll(docs.select("lang", F.concat("source", F.lit("é")), "text")).unionAll(docs.select("lang", F.lit("q"), F.concat(F.lit("Rain "), "text")))
    frame = more.withColumn("value", F.lit(1)).withColumn("term", F.lit("x"))
    got = divergence.divergence(frame, **options)
    pdf = pd.DataFrame(more.collect(), columns=["lang", "source", "text"])
    con = duckdb.connect()
    con.register("documents", pdf)
    want = con.sql(queries.ORACLES["op13_divergence"])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_divergence_edges(spark, none):
    assert divergence.divergence(none).count() == 0
    few = spark.createDataFrame([("en", "a", "one"), ("en", "b", "two"), (None, None, None)], "lang string, source string, text string")
    assert sorted(map(tuple, divergence.divergence(few).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
