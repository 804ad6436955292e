"""Threshold search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspan.llm.topk import Query, search, top_k

VECTORS = "vec_id long, embedding array<float>, score int, rank int"


def brute_force(rows, asks, k):
    usable = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    found = set()
    for q, a in {(i, tuple(v)) for i, v in usable if asks(i)}:
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q and len(b) == len(a))[:k]
        found |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)}
    return found


@pytest.mark.parametrize("block_rows, query_rows", [(16_384, 4_096), (40, 3)])
def test_equals_brute_force(spark, block_rows, query_rows):
    rnd = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rnd.normal(size=8).round(1)]) for i in range(300)]
    rows += [(300, [1.0] * 8), (301, [1.0] * 8), (302, [1.0] * 8), (400, [0.0] * 8), (500, None), (501, [1.0, None] * 4), (502, [float("nan")] * 8), (503, [float("inf")] * 8)]
    rows += [(600, [1.0, 2.0]), (601, [3.0, -1.0]), (700, [2.0]), (None, [1.0] * 8), (800, []), (801, []), (303, [1.0] * 8), (303, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 1, 1) for i, v in rows], VECTORS)
    result = top_k(df, F.col("vec_id") % 100 == 0, k=5, block_rows=block_rows, query_rows=query_rows)
    found = [(r.query_id, r["rank"], r.vec_id, r.score) for r in result.collect()]
    assert len(found) == len(set(found)) and set((q, i, s) for q, _, i, s in found) == set((q, i, s) for q, _, i, s in brute_force(rows, lambda i: i % 100 == 0, 5))
    assert set(found) == brute_force(rows, lambda i: i % 100 == 0, 5)


def test_empty(spark):
    assert top_k(spark.createDataFrame([], VECTORS), F.col("vec_id") % 100 == 0).count() == 0


def test_stops_early_and_not_on_equal_bounds():
    n = 5000
    vectors = np.zeros((n, 2))
    vectors[:, 0] = np.arange(n)
    order = np.argsort(vectors, axis=0, kind="stable").T
    touched = []

    class Watched(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, np.ndarray) and at.dtype == bool:
                touched.append(int(at.sum()))
            return super().__getitem__(at)

    ids, scores = search(Query(-1, np.array([2.0, 0.0])), np.arange(n), vectors.view(Watched), order, 10)
    assert list(ids) == list(range(n - 1, n - 11, -1)) and list(scores[:2]) == [2 * (n - 1), 2 * (n - 2)]
    assert sum(touched) < 200
    equal = np.ones((n, 1))
    ids, _ = search(Query(0, np.array([1.0])), np.arange(n), equal, np.argsort(-np.arange(n)).reshape(1, -1), 3)
    assert list(ids) == [1, 2, 3]  # all scores are equal, so the smallest ids win wherever they stand in the list


def test_scores_beyond_floats(spark):
    rows = [(0, [8000.0] * 64, 1, 1), (1, [8000.0] * 63 + [7999.9990234375], 1, 1), (2, [8000.0] * 64, 1, 1)]
    found = top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") == 0).collect()
    whole = 8000 * 1024
    assert [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"])] == [(2, 64 * whole**2), (1, 63 * whole**2 + whole * (whole - 1))]


def test_large_components_take_part(spark):
    from fieldspan.llm.queries import OP10_SQL

    duckdb = pytest.importorskip("duckdb")
    rnd = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rnd.normal(size=4)]) for i in range(40)]
    rows += [(100, [16_384.0, 1.0, -2.0, 0.0]), (200, [2.0**15, 0.0, 1.0, 0.5]), (7_001, [2.0**27, 0.0, 0.0, 1.0]), (7_002, [-(2.0**27), 0.0, 0.0, 1.0]), (7_003, [2.0**19, 2.0**20, -1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 1) for i, v in rows], VECTORS)
    found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df, F.col("vec_id") % 100 == 0).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    assert {q for q, *_ in found} == {0, 100, 200} and any(i == 7_001 for _, _, i, _ in found)
    assert found == sorted(con.execute(OP10_SQL).fetchall())
    assert set(found) == brute_force(rows, lambda i: i % 100 == 0, 10)


def test_a_score_that_no_long_holds_is_an_error(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0], 1, 1), (1, [1e30, 1.0], 1, 1)], VECTORS)
    with pytest.raises(Exception, match="does not fit in a long"):
        top_k(df, F.col("vec_id") == 0).collect()


def test_one_plan_for_many_blocks_of_queries(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rnd.normal(size=4).round(1)]) for i in range(3_000)]
    df = spark.createDataFrame([(i, v, 1, 1) for i, v in rows], VECTORS)
    result = top_k(df, F.col("vec_id") % 2 == 0, k=2, block_rows=1_000, query_rows=2)
    assert result._jdf.queryExecution().analyzed().toString().count("CoGroup") == 1
    found = {(r.query_id, r["rank"], r.vec_id, r.score) for r in result.collect()}
    assert len(found) == 3_000 and {x for x in found if x[0] % 100 == 0} == {x for x in brute_force(rows, lambda i: i % 100 == 0, 2)}
