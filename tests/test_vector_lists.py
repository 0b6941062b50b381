"""The stored inverted lists against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.operators import batches as bt
from larder.operators.vectorlists import candidates, read_vector_index, search_lists, write_vector_index
from larder.operators.vectors import semantic_top

SCHEMA = "id long, supplier_id long, price double, embedding array<float>"


def table(spark, vectors):
    return spark.createDataFrame([(i, i % 5, float(i % 97), [float(x) for x in v]) for i, v in enumerate(vectors)], SCHEMA)


def clustered(rng, n, dim):
    centres = rng.normal(size=(40, dim))
    return centres[rng.integers(0, 40, n)] + 0.3 * rng.normal(size=(n, dim))


def exact(rows, asks, threshold, k):
    asks = bt.complete(asks, "bigint")
    return {(r["query_id"], r["id"]): r["similarity"] for r in semantic_top(rows, asks, bt.measure(asks, k), threshold, k).collect()}


@pytest.mark.parametrize("kind", ["clustered", "random"])
def test_recall_and_share_compared(spark, tmp_path, kind):
    rng = np.random.default_rng(3)
    vectors = clustered(rng, 4000, 24) if kind == "clustered" else rng.normal(size=(4000, 24))
    rows = table(spark, vectors)
    write_vector_index(rows, str(tmp_path / "index"))
    stored, centres = read_vector_index(spark, str(tmp_path / "index"))
    assert stored.count() == 4000
    asks = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    want = exact(rows, asks, None, 10)
    got = {(r["query_id"], r["id"]): r["similarity"] for r in search_lists(stored, centres, asks, None, 10).collect()}
    hit = want.keys() & got.keys()
    assert all(want[k] == pytest.approx(got[k], abs=1e-9) for k in hit)
    assert len(hit) >= 0.9 * len(want)
    full = bt.complete(asks, "bigint")
    compared = candidates(stored, centres, full, None, 10, bt.measure(full, 10)).count()
    assert compared < 0.1 * 4000 * len(want) / 10
    index = spark.read.parquet(str(tmp_path / "index" / "index")).first()
    if kind == "clustered":  # random vectors have no near lists, so most are opened
        assert index["probes"] <= 0.2 * index["lists"]


def test_all_lists_equal_the_exact_search(spark, tmp_path):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(600, 8))
    vectors[100:120] = vectors[100]  # ties
    odd = spark.createDataFrame(
        [(9001, 1, 1.0, None), (9002, 1, 1.0, [0.0] * 8), (9003, 1, 1.0, [float("nan")] * 8), (9004, 1, None, [1.0] * 8), (9005, None, 2.0, [1.0, 2.0])], SCHEMA
    )
    rows = table(spark, vectors).union(odd).withColumn("list", F.lit("clash")).withColumn("dim", F.lit("clash"))
    write_vector_index(rows, str(tmp_path / "index"))
    stored, centres = read_vector_index(spark, str(tmp_path / "index"))
    assert stored.count() == 602
    good = [(1, vectors[100].tolist(), None, None, None, 5), (2, vectors[5].tolist(), 3, 10.0, 60.0, 7), (3, [3.0, 6.0], None, None, None, None)]
    bad = [(4, None, None, None, None, 3), (5, [0.0] * 8, None, None, None, 3), (6, [1.0] * 3, None, None, None, 3)]
    schema = "query_id int, query_embedding array<double>, supplier_filter long, price_min double, price_max double, result_limit int"
    asks = spark.createDataFrame(good + bad, schema)
    got = {(r["query_id"], r["id"]): r["similarity"] for r in search_lists(stored, centres, asks, 0.1, 20, probes=1000).collect()}
    want = exact(rows.where("id < 9003 OR id > 9003").drop("list", "dim"), asks, 0.1, 20)
    assert got.keys() == want.keys() and {q for q, _ in got} == {1, 2, 3}
    assert sorted(i for q, i in got if q == 1) == [100, 101, 102, 103, 104]


def test_only_probed_lists_are_opened_and_filters_reach_the_scan(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = table(spark, clustered(rng, 2000, 8))
    write_vector_index(rows, str(tmp_path / "index"))
    stored, centres = read_vector_index(spark, str(tmp_path / "index"))
    asks = bt.complete(rows.where("id = 7").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding")), "bigint")
    plan = candidates(stored.where("supplier_id = 2"), centres, asks, None, 10, bt.measure(asks, 10))._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "code" in line)
    assert "EqualTo(supplier_id,2)" in scan and "embedding" not in scan.split("ReadSchema")[1]


def test_empty_table(spark, tmp_path):
    write_vector_index(spark.createDataFrame([], SCHEMA), str(tmp_path / "index"))
    stored, centres = read_vector_index(spark, str(tmp_path / "index"))
    asks = spark.createDataFrame([(1, [1.0, 2.0])], "query_id int, query_embedding array<double>")
    assert search_lists(stored, centres, asks, None, 10).collect() == []
