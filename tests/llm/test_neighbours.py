import numpy as np
import pytest

from fleetlens.llm import ann
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def brute(rows, query, k=20):
    own = dict(rows)[query]
    near = [(-float((np.float64(own) * np.float64(v)).sum()), i) for i, v in rows if i != query and len(v) == len(own)]
    return [(i, -s) for s, i in sorted(near)[:k]]


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    got = found(ann.nearest(table, F.col("vec_id") % 20 == 0))
    queries = [i for i, _ in rows if i % 20 == 0]
    assert sorted(got) == queries
    hits = [len({i for i, _ in got[q]} & {i for i, _ in brute(rows, q)}) for q in queries]
    assert sum(hits) >= 0.9 * 20 * len(queries)


def test_exact_when_all_are_probed(spark):
    """Equal vectors, vectors that take no part, other lengths, norms that differ, ids that tie."""
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=6) * rng.uniform(0.1, 9)).tolist()) for i in range(1, 90)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(100, 160)]
    rows += [(200 + i, [float(i + 1), 1.0]) for i in range(5)]
    odd = [(300, None), (320, [0.0] * 6), (340, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (360, [float("nan")] * 6), (380, [float("inf")] * 6), (None, [1.0] * 6), (400, [])]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], "vec_id long, embedding array<double>, key string, rank int")
    got = found(ann.nearest(table, F.col("vec_id") % 20 == 0, probes=16))
    assert sorted(got) == [i for i, _ in rows if i % 20 == 0]
    for query, near in got.items():
        expected = brute(rows, query)
        assert [i for i, _ in near] == [i for i, _ in expected]
        assert [s for _, s in near] == pytest.approx([s for _, s in expected], abs=1e-9)
    assert len(got[200]) == 4


def test_few_found_are_looked_for_everywhere(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(ann.nearest(table, F.col("vec_id") == 0, tables=1, probes=1))
    assert [i for i, _ in got[0]] == [i for i, _ in brute(rows, 0)]


def test_empty(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(table, F.col("vec_id") % 20 == 0).count() == 0


def test_blocks(spark, monkeypatch):
    """Blocks that are cut small give the same answers."""
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").where("vec_id < 200")
    whole = found(ann.nearest(table, F.col("vec_id") % 20 == 0))
    monkeypatch.setattr(ann, "BLOCK_ROWS", 7)
    assert found(ann.nearest(table, F.col("vec_id") % 20 == 0)) == whole
