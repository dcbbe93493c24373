import numpy as np
from pyspark.sql import functions as F

from subgrade.llm import topk
from tests.conftest import DATA, same_rows

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, block string"


def brute(rows, queries, k, scale=256):
    usable = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, qv in usable:
        if q in queries:
            scores = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in usable if i != q and len(v) == len(qv))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_query_against_sql(spark, duck):
    same_rows(topk.op5_top_k_search(spark, str(DATA)).toPandas(), duck.sql(topk.OP5_SQL).df())


def test_many_tiles_ties_and_unusable_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 7)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.integers(-2, 3, 4)]) for i in range(150)]
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [float("nan")] * 4), (203, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (204, []), (300, [1.0, 2.0]), (310, [2.0, 2.0])]
    df = spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA).repartition(5)
    got = topk.top_k(df, F.col("id") % 10 == 0, 5).collect()
    assert sorted((g.query_id, g.rank, g.vec_id, g.score) for g in got) == brute(rows, set(range(0, 400, 10)), 5)


def test_products_beyond_double_precision(spark):
    rows = [(0, [1e6, 1.0]), (1, [1e6, 0.0]), (2, [1e6, 1.0]), (3, [-1e6, 3.0])]
    df = spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA.replace("array<float>", "array<double>"))
    got = topk.top_k(df, F.col("id") == 0, 3).orderBy("rank").collect()
    assert [(g.vec_id, g.score) for g in got] == [(2, 65536000000065536), (1, 65536000000000000), (3, -65536000000000000 + 3 * 65536)]


def test_an_empty_table(spark):
    assert topk.top_k(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0


def test_components_beyond_a_double_are_held(spark):
    rows = [(0, [1e307, 1.0]), (1, [1e307, 2.0]), (2, [-1e308, 0.0]), (3, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.top_k(df, F.col("id") == 0, k=5).collect()
    assert [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r.rank)] == [(1, 2**63 - 1), (3, 2**63 - 1), (2, -(2**63))]


def test_no_matrix_is_broadcast_and_lists_grow_with_stripes_only(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 5)
    monkeypatch.setattr(topk, "QUERY_ROWS", 5)
    seen = {}
    keep = topk.written

    def noted(df, name):
        seen[name] = (df._jdf.queryExecution().executedPlan().toString(), keep(df, name))
        return seen[name][1]

    monkeypatch.setattr(topk, "written", noted)
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 11)]) for i in range(400)], "vec_id long, embedding array<float>")
    got = topk.top_k(df, F.col("id") % 10 == 0, 5)
    assert got.count() == 200
    plans = [p for p, _ in seen.values()] + [got._jdf.queryExecution().executedPlan().toString()]
    assert not [p for p in plans if "Broadcast" in p]
    assert seen["topk-lists"][1].count() <= 40 * 5 * 8
