"""Operators of the training-data pipeline against brute force, SQL, the library, and edge cases."""
import hashlib
import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, exact_dedup, jaccard, lattice, lm, merkle, mixing, queries, sentencepiece, token_counts, toxicity, urlfilter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string, keep_id int"
LONG = " ".join(f"w{i % 97}x{i % 31}" for i in range(9000))
ROWS = [
    (1, "The cat sat on the mat and looked at the dog", "en", "a", 1, "x", 0),
    (2, "the CAT sat on the mat and looked at the dog", "en", "a", 1, "y", 0),
    (3, "the CAT sat on the mat and looked at the dog", "en", None, 1, "y", 0),
    (3, "the CAT sat on the mat and looked at the dog", "en", None, 1, "y", 0),
    (4, None, None, "b", None, None, None), (5, "", "en", "b", 0, "", 0), (6, "two words", "de", "b", 9, "", 0),
    (7, LONG, "en", "c", 1, "", 0), (8, LONG + " tail", "en", "c", 1, "", 0), (None, "no id here at all", "fr", "c", 1, "", 0),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def grid():
    with open(queries.PIECES, "rb") as f:
        return lattice.Lattice(lattice.Vocabulary.read(f.read()))


def rows_by_id(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_exact_dedup(docs, none):
    got = exact_dedup.exact_dedup(docs, run_rows=2, fan_in=2).collect()
    norm = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    groups = {}
    for r in ROWS:
        groups.setdefault(norm(r[1]), []).append(r[0])
    want = []
    for t, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        for k, i in enumerate(ids):
            want.append((i, best, len(ids), i == best and i not in ids[:k], hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert exact_dedup.exact_dedup(none).count() == 0
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_jaccard_join_against_all_pairs(spark, none):
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(12):
        base = rng.integers(0, 400, 120).tolist()
        for k in range(8):
            t = list(base)
            for _ in range(k):
                t[int(rng.integers(0, len(t)))] = int(rng.integers(1000, 9000))
            texts.append(" ".join(f"t{x}" for x in t))
    texts += [None, "", "a b", "A b", texts[0], texts[0].upper()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(df, often_from=4).collect()}
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            comp[y] = x
    assert got == {i: (len(sets[i]), root(i)) for i in sets}
    assert jaccard.jaccard_join(none).count() == 0


def test_jaccard_edge_rows(docs):
    got = jaccard.jaccard_join(docs)
    assert got.count() == len(ROWS)
    by = {r["doc_id"]: r["component_id"] for r in got.collect()}
    assert by[2] == by[3] == 1 and by[4] == 4 and by[5] == 5 and by[8] == 7
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 4, 5, 6, 7, None}


def test_jaccard_shows_a_link_of_every_class(spark):
    rng = np.random.default_rng(5)
    texts = []
    for length, copies in ((90, 60), (30, 5), (200, 3)):
        base = rng.integers(0, 400, length).tolist()
        for k in range(copies):  # few edits and tails of up to a fifth of the length: links across sizes, and pairs that miss the bar
            t = base + rng.integers(400, 9000, k % 13 * length // 60).tolist()
            t[int(rng.integers(0, length))] = int(rng.integers(1000, 9000))
            texts.append(" ".join(f"t{x}" for x in t))
    texts += ["", texts[0], "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = [t.split() for t in texts]
    sets = [frozenset(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset() for w in words]
    linked = [{b for b in set(sets) - {a, frozenset()} if 100 * len(a & b) >= 75 * len(a | b)} if a else set() for a in sets]
    assert max(map(len, linked)) > 20
    got = jaccard.jaccard_join(df, often_from=4).orderBy("doc_id").collect()
    set_of = {r["set_digest"]: sets[r["doc_id"]] for r in got}
    for r, others in zip(got, linked):
        assert set_of[r["link_digest"]] in others if others else r["link_digest"] is None


def test_jaccard_pairs_of_a_group_of_copies_that_just_do_not_link(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base, texts = rng.integers(0, 400, 150).tolist(), []
    for k in range(200):  # 3 to 5 edits each: some 25 of 146 shingles, so that most pairs share less than the bar
        t = list(base)
        for at in rng.integers(0, 150, 3 + k % 3):
            t[int(at)] = int(rng.integers(1000, 900_000))
        texts.append(" ".join(f"t{x}" for x in t))
    words = [t.split() for t in texts]
    sets = [frozenset(tuple(w[j:j + 5]) for j in range(len(w) - 4)) for w in words]
    bits = [jaccard.parities(jaccard.shingle_set(t)).view(np.uint64) for t in texts]
    comp = list(range(200))
    for a, b in itertools.combinations(range(200), 2):
        assert np.bitwise_count(bits[a] ^ bits[b]).sum() <= len(sets[a] ^ sets[b])
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
            low, high = sorted((comp[a], comp[b]))
            comp = [low if c == high else c for c in comp]
    made, across = [], jaccard._across
    monkeypatch.setattr(jaccard, "_across", lambda *a: made.append(across(*a)) or made[-1])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_join(df, often_from=4).collect()}
    assert got == dict(enumerate(comp)) and len(set(comp)) > 20
    assert made[0].count() < 10 * len(texts)


def test_frequent_shingles_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(8)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, " ".join(f"t{x}" for x in rng.integers(0, 90_000, 60)) + (f" {passage}" if i % 5 == 0 else "")) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [jaccard.common_shingles(df.repartition(n), "text", 5, 16, 1 << 21) for n in (4, 211)]
    assert found[0][0].tolist() == found[1][0].tolist() and found[0][1].tolist() == found[1][1].tolist()
    want = {int(x) for x in jaccard.shingle_set(passage) >> np.uint64(32)}
    assert want <= set(found[0][0].tolist()) and len(found[0][0]) <= len(want) + 4
    few = jaccard.common_shingles(df, "text", 5, 2, 10)
    assert len(few[0]) <= 10


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(b"%04d" % i, b"%04d" % (i + 1)) for i in range(300)], "a binary, b binary")
    assert jaccard.components(links).select("comp").distinct().count() == 1


def test_merkle(docs, none):
    got = {r["doc_id"]: r for r in merkle.fingerprints(docs.where("doc_id <> 3 or doc_id is null"), block_rows=2).collect()}
    order = [8, 7, 6, 5, 4, 2, 1, None]
    text = {r[0]: r[1] or "" for r in ROWS}
    for k, i in enumerate(order):
        e = merkle.edited(text[i], text[order[(k + 1) % len(order)]])
        assert got[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and got[i]["n_chars"] == len(text[i])
    assert got[4]["fingerprint"] == got[5]["fingerprint"] and got[7]["near_edited"] > 0.5
    assert merkle.fingerprints(none).count() == 0
    assert merkle.fingerprints(docs).count() == len(ROWS)


def test_merkle_locates_an_edit():
    a = "\n".join(f"line {i} of the text with some words" for i in range(400)).encode()
    b = a.replace(b"line 200 of", b"line 200 OF")
    spans = merkle.differing(merkle.Tree(a), merkle.Tree(b))
    at = b.index(b"line 200 OF")
    assert spans and all(at - 64 <= s <= e <= at + 160 for s, e in spans)
    assert merkle.likeness(merkle.Tree(a).fingerprint, merkle.Tree(b).fingerprint) > 0.9


def test_lattice_is_the_best_segmentation(grid):
    rng = np.random.default_rng(1)
    words = ["▁" + "".join(rng.choice(list("thenaio\n漢é"), int(rng.integers(1, 7)))) for _ in range(200)]
    own = {grid.vocab.pieces[i]: grid.own[i] for i in grid.vocab.normal}
    places, tokens, lens, scores = grid.viterbi(words)
    logp = np.where(np.isin(np.arange(len(grid.own)), np.concatenate([grid.vocab.normal, grid.vocab.byte_ids])), -3.0 - np.arange(len(grid.own)) / 1e4, -np.inf)
    sums = grid.marginals(words, [logp])[:, 0]
    at = 0
    for place, n, score in zip(places, lens, scores):
        w, best, total = words[place], -math.inf, -math.inf
        for cut in itertools.product((0, 1), repeat=len(w) - 1):
            parts = "".join(c + ("|" if i < len(cut) and cut[i] else "") for i, c in enumerate(w)).split("|")
            cost = lp = 0.0
            for p in parts:
                if p in own:
                    cost, lp = cost + own[p], lp + logp[grid.vocab.pieces.index(p)]
                elif len(p) == 1:
                    ids = grid.vocab.byte_ids[list(p.encode())]
                    cost, lp = cost + grid.own[ids].sum(), lp + logp[ids].sum()
                else:
                    cost = lp = -math.inf
            best, total = max(best, cost), np.logaddexp(total, lp)
        assert score == best and math.isclose(total, sums[place], rel_tol=1e-9)
        coder_ids = tokens[at:at + n]
        at += n
        assert len(coder_ids) == n


def test_encoding_round_trips_and_chunks_agree(docs, none):
    whole = sentencepiece.encode(docs, queries.PIECES, chunk=1 << 20)
    cut = sentencepiece.encode(docs, queries.PIECES, chunk=300, fan=3)
    a, b = ({(r["doc_id"], r["text"], r["extra"]): r for r in x.collect()} for x in (whole, cut))
    assert len(a) == len(b) and whole.count() == cut.count() == len(ROWS)
    for k in a:
        assert a[k]["round_trip"] and b[k]["round_trip"] and a[k]["path_score"] == b[k]["path_score"]
    back = sentencepiece.decode(cut, queries.PIECES)
    assert back.where(F.col("decoded") != F.coalesce("text", F.lit(""))).count() == 0
    assert sentencepiece.encode(none, queries.PIECES).count() == 0


def test_lm_scores(docs, none):
    train = ~F.coalesce(F.col("doc_id") == 2, F.lit(False))
    got = lm.lm_scores(docs, queries.PIECES, train, class_col="lang", common=3).collect()
    words = lambda t: (t or "").encode().lower().split() + ["end"]
    c = Counter(w for r in ROWS if r[0] != 2 for w in words(r[1]))
    n, v = sum(c.values()), len(c)
    want = {}
    for r in ROWS:
        want[r[0]] = (len(words(r[1])), sum(c[w] > 0 for w in words(r[1])), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(r[1])))
    assert len(got) == len(ROWS)
    for r in got:
        k = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == k[:3] and math.isclose(r["base_score"], k[3], rel_tol=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0
    assert lm.lm_scores(none, queries.PIECES, train).count() == 0
    assert lm.lm_scores(docs, queries.PIECES, F.lit(False)).where("base_score <> 0").count() == 0


def test_lm_query_runs_three_rounds(monkeypatch, docs):
    asked = []
    fit = lm.fit
    monkeypatch.setattr(lm, "fit", lambda counts, ends, vocabulary, rounds: asked.append(rounds) or fit(counts, ends, vocabulary, rounds))
    monkeypatch.setattr(queries, "read", lambda *_: docs)
    queries.op8_lm_score(docs.sparkSession, "")
    assert asked == [3]


def test_toxicity(spark, docs, none):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(600):
        w = [f"w{x}" for x in rng.integers(0, 300, 40)]
        bad = i % 3 == 0
        if bad:
            w[int(rng.integers(0, 40))] = "vile"
        rows.append((i, " ".join(w), "en", int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.learn(df, df.select("doc_id", "toxic"), buckets=1 << 12)
    held = toxicity.scored(df, model, lang_col="lang").where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    assert held.where((F.col("score") >= 0.3) == (F.col("toxic") == 1)).count() >= 0.95 * held.count()
    assert toxicity.scored(docs, model).count() == len(ROWS) and toxicity.scored(none, model).count() == 0
    empty = toxicity.learn(none, df.select("doc_id", "toxic").limit(0))
    assert {r["score"] for r in toxicity.scored(docs, empty).collect()} == {0.0}


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://NET/", "http://net", "https://a.example.net/en/x?q", "https://a.example.net/de/", "http://xnet/", "ftp://w.example.com/de/#a", "http://b.org/fr/", "http://u@b.org/frx://y"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = urlfilter.judge(pages, queries.RULES)
    by_join = urlfilter.judge_by_join(pages, spark.createDataFrame(list(queries.RULES), "verdict string, host string, path string"))
    assert rows_by_id(got) == rows_by_id(by_join)
    assert [r["rule"] for r in got.orderBy("page_id").collect()] == [None, None, None, "net/", None, "example.net/en/", "net/", None, "example.com/de/", "org/fr/", None]
    assert urlfilter.judge(pages.limit(0), queries.RULES).count() == 0


def test_preferences(spark):
    t = "array<struct<turn:bigint,role:string,text:string>>"
    a, b, c = (0, "user", "hi"), (1, "assistant", "yes"), (1, "assistant", "no")
    df = spark.createDataFrame([(1, [a, b], [a, c]), (2, [a, b], [a, b]), (3, [b], [c, a]), (4, None, [a])], f"id int, chosen {t}, rejected {t}")
    got = {r["id"]: r for r in chat.preferences(df).collect()}
    assert got[1]["prompt"] == "<|user|>\nhi<|end|>\n" and got[1]["prompt_turns"] == 1
    for side, said in (("chosen", "yes"), ("rejected", "no")):
        s = got[1][f"{side}_mask"][0]
        assert got[1][f"{side}_completion"][s["start"]:s["start"] + s["length"]] == f"{said}<|end|>\n"
    assert got[2]["chosen_completion"] == got[2]["rejected_completion"] == "" and got[3]["prompt"] == "" and got[4]["prompt_turns"] == 0


def test_token_histogram(docs, none):
    lengths = token_counts.encoded_lengths(docs, queries.RANKS)
    n = [r["tokens"] for r in lengths.collect()]
    for r in token_counts.length_histogram(lengths, width=4).collect():
        limit = r["tokens"]
        assert r["truncated_total"] == sum(min(x, limit) for x in n) and r["dropped_total"] == sum(x for x in n if x <= limit)
        assert r["docs_at_least"] == sum(x >= limit for x in n) and math.isclose(r["quantile"], sum(x <= limit for x in n) / len(n))
    assert token_counts.length_histogram(token_counts.encoded_lengths(none, queries.RANKS)).count() == 0


def test_mixing(spark, docs, none):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), f"s{min(i % 7, 3)}" if i % 11 else None) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    q = mixing.queued(df, block_rows=50)
    taken = mixing.mixed(q).groupBy("source", "id").agg(F.sum("taken").alias("taken"), F.first("size").alias("size"), F.first("target").alias("target")).collect()
    total = sum(len(r[1].split()) for r in rows)
    targets = {}
    for r in taken:
        assert 0 <= r["taken"] <= 2 * r["size"]
        targets[r["source"]] = r["target"]
    assert math.isclose(sum(targets.values()), 1.5 * total, rel_tol=1e-9)
    for s, t in targets.items():
        assert abs(sum(r["taken"] for r in taken if r["source"] == s) - t) <= 1
    assert mixing.mix(df).groupBy("doc_id").count().where("count > 2").count() == 0
    assert mixing.mix(docs).count() > 0 and mixing.mix(none).count() == 0 and mixing.queued(docs).count() == len(ROWS)


def test_repeated_ids_keep_their_rows(spark, monkeypatch):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(40))
    near = text("a") + " tail"
    df = spark.createDataFrame([(1, text("a")), (2, near), (2, text("b")), (3, text("c")), (3, text("d")), (3, text("d"))], "doc_id long, text string")
    kept = sorted(map(tuple, jaccard.one_of_each(df).collect()))
    assert kept == [(1, text("a")), (2, text("b")), (3, text("c")), (3, text("d"))]

    rows = [(7, None, "a"), (7, "", "a"), (7, "", "b"), (7, None, None), (8, "one two", "a"), (8, "one two", "a"), (9, "x", "a"), (9, "x", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    monkeypatch.setattr(queries, "read", lambda *_: docs)
    assert sorted(r["doc_id"] for r in queries.op10_mix(spark, "").collect()) == sorted(r[0] for r in rows)


def test_queries_match_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, sf)
        cols = sorted(df.columns)
        assert sorted(map(str, map(tuple, df.select(*cols).collect()))) == sorted(map(str, con.execute(f"select {', '.join(cols)} from ({sql})").fetchall())), name


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        docs = out
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
