"""Links and components of vectors against the SQL."""

import duckdb
import numpy as np
from oracle import compare
from pyspark.sql import functions as F

from larder.llm import embeddings

KIND = "vec_id long, embedding array<float>, label int"


def against_sql(df, **settings):
    con = duckdb.connect()
    con.register("embeddings", df.select("vec_id", "embedding", "label").toArrow())
    return compare(embeddings.near_vectors(df, **settings), con, embeddings.oracle())


def test_dense_groups_and_odd_vectors(spark):
    rng, rows = np.random.default_rng(1), []
    for label in range(3):
        for _ in range(60):
            rows.append((len(rows), rng.normal(size=16).astype(np.float32).tolist(), label))
        centre = rng.normal(size=16)
        for step in range(80):  # a hot group, with links about the limit
            near = (centre + rng.normal(size=16) * (0.05 + 0.002 * step)).astype(np.float32).tolist()
            rows.append((len(rows), near, label))
    rows += [(len(rows) + i, rows[70][1], 0) for i in range(30)]  # copies
    rows += [(len(rows), [2 * x for x in rows[70][1]], 0), (len(rows) + 1, rows[70][1], None), (len(rows) + 2, None, 0), (len(rows) + 3, [0.0] * 16, 0),
             (len(rows) + 4, [float("nan")] + [1.0] * 15, 0), (len(rows) + 5, [float("inf")] + [1.0] * 15, 0), (len(rows) + 6, [None] + [1.0] * 15, 0)]
    df = spark.createDataFrame(rows, KIND).withColumns({"rep": F.lit(1), "vector": F.lit("x"), "n": F.lit(2)})
    for settings in ({}, {"train_rows": 64, "block_rows": 16}):
        problem, n = against_sql(df, **settings)
        assert problem is None and n == len(rows)


def test_rows_without_partners(spark):
    empty = spark.createDataFrame([], KIND)
    assert embeddings.near_vectors(empty).count() == 0
    rows = [(1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, 2.0], None), (None, [1.0, 2.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(spark.createDataFrame(rows, KIND)).collect()}
    assert got == {1: (0, 1, True), 2: (0, 2, True), 3: (0, 3, True), None: (0, None, False)}
    odd = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0], 1), (4, [1.0], 1), (5, [0.0, 1.0], 1)]  # equal lengths are compared, whatever the others have
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(spark.createDataFrame(odd, KIND)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 0}


def test_probes_and_tables_lose_nothing():
    rng = np.random.default_rng(3)
    base = embeddings.unit(rng.normal(size=(400, 32)))
    near = embeddings.unit(base + rng.normal(size=base.shape) * 0.02)
    model = embeddings.fit(base)
    reach = np.sqrt(2 - 2 * 0.98)
    own, codes, error, _ = model.encode(near, reach)
    probes = model.encode(base, reach)[3]
    close = (base * near).sum(1) >= 0.98
    assert close.sum() > 300 and probes[np.arange(400), own][close].all()
    for i in np.flatnonzero(close):
        assert np.sqrt(model.table_distances(base[i:i + 1], codes[i:i + 1], own[i])[0, 0]) <= reach + error[i] + 1e-6


def test_vectors_of_many_lengths(spark):
    """Each length for itself, whether it has a quantiser or not; the SQL compares lengths that are equal."""
    rng, rows = np.random.default_rng(9), []
    for size, n in ((16, 150), (8, 100), (5, 30), (3, 6)):
        centres = rng.normal(size=(4, size))
        rows += [(len(rows) + i, (centres[i % 4] + rng.normal(size=size) * 0.12).astype(np.float32).tolist(), i % 2) for i in range(n)]
    df = spark.createDataFrame(rows, KIND)
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    problem, n = compare(embeddings.near_vectors(df, block_rows=16), con, embeddings.oracle())
    assert problem is None and n == len(rows)
