"""A worker encodes a batch in stretches of bounded size."""
import pyarrow as pa

from tidemark.llm import sentencepiece as S
from tidemark.llm.queries import PIECES


def test_portions_cover_a_batch_within_their_size():
    texts = pa.array(["a" * 40, None, "", "b" * 70, "c" * 500, "d", "e" * 99, "f"])
    parts = list(S.portions(texts, 100))
    assert [i for p in parts for i in range(p.start, p.stop)] == list(range(8))
    sizes = [sum(len(t or "") for t in texts[p].to_pylist()) for p in parts]
    assert all(size <= 100 or p.stop - p.start == 1 for size, p in zip(sizes, parts)) and len(parts) == 5
    assert not list(S.portions(pa.array([], pa.string())))
    assert [(p.start, p.stop) for p in S.portions(pa.array(["x", "é" * 60, "y"]).slice(1), 100)] == [(0, 1), (1, 2)]


def test_a_batch_of_many_portions(spark):
    rows = [(i, None if i % 50 == 0 else f"the cat {i} sat on a mat " * (i % 90)) for i in range(4_000)]
    assert sum(len(t or "") for _, t in rows) > 3 * S.AT_ONCE
    got = {r["doc_id"]: r for r in S.encode(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), PIECES).collect()}
    with open(PIECES, "rb") as f:
        coder = S.Encoder(f.read())
    assert len(got) == len(rows) and all(r["round_trip"] for r in got.values())
    for i, t in rows[::97]:
        flat, _, scores = coder.paths([S.mark(t or "")])
        assert got[i]["ids"] == flat.tolist() and got[i]["path_score"] == scores[0]
