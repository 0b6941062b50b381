import numpy as np
import pytest
from frames import ids, products, suppliers
from pyspark.sql import functions as F

from larder.functions.vectors import cosine_similarity
from larder.operators import vectors as vc
from larder.operators.encode import result_documents, result_lines, write_lines
from larder.operators.hybrid import search_hybrid, search_hybrid_batch
from larder.operators.maintenance import hashing_embedder
from larder.plans.search import assistant_search, search, search_messages

X = [1.0, 0.0, 0.0, 0.0]


def test_semantic_rules(spark):
    got = vc.search_semantic(products(spark), suppliers(spark), X, similarity_threshold=0.4).collect()
    assert [(r["id"], r["similarity"]) for r in got] == [("p1", 1.0), ("p2", 0.5)]
    # strictly above the threshold; zero, missing, opposite vectors never match here
    assert ids(vc.search_semantic(products(spark), suppliers(spark), X, similarity_threshold=0.5)) == ["p1"]
    assert ids(vc.search_semantic(products(spark), suppliers(spark), X, price_min=5, similarity_threshold=-2.0)) == ["p2", "p5"]
    assert ids(vc.search_semantic(products(spark), suppliers(spark), [1.0, 0.0], similarity_threshold=-2.0)) == []
    assert ids(vc.search_semantic(products(spark), suppliers(spark), [0.0] * 4, similarity_threshold=-2.0)) == []


def random_case(spark, n=500, q=30, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    base = np.round(rng.normal(size=(n, dim)), 1)
    base[::3] = base[0]  # a third are copies, so ties abound
    rows = [(i, "s1" if i % 2 else "s2", float(i), v.tolist()) for i, v in enumerate(base)]
    asks = [(i, v.tolist(), "s1" if i % 3 == 0 else None, 100.0 if i % 4 == 0 else None, 1 + i % 7)
            for i, v in enumerate(np.round(rng.normal(size=(q, dim)), 1))]
    goods = spark.createDataFrame(rows, "id long, supplier_id string, price double, embedding array<float>")
    queries = spark.createDataFrame(asks, "query_id long, query_embedding array<double>, supplier_filter string, price_min double, result_limit int")
    return rows, asks, goods.repartition(5), queries


@pytest.mark.parametrize("block, sent", [(4096, 1 << 20), (8, 1 << 20), (8, 0), (4096, 0)])
def test_semantic_batch_equals_brute_force(spark, block, sent, monkeypatch):
    monkeypatch.setattr(vc, "BLOCK_QUERIES", block)
    monkeypatch.setattr(vc, "BROADCAST_BYTES", sent)
    monkeypatch.setattr(vc, "CHUNK_ROWS", 64)
    rows, asks, goods, queries = random_case(spark)
    from larder.operators import batches as bt

    full = bt.complete(queries)
    top = vc.semantic_top(goods, full, bt.measure(full, 50), 0.0, 50).collect()
    got = {}
    for r in sorted(top, key=lambda r: (r["query_id"], r["rank_no"])):
        got.setdefault(r["query_id"], []).append((r["id"], r["similarity"]))
    for qid, vec, supplier, low, k in asks:
        want = []
        for i, s, price, e in rows:
            e32 = np.array(e, dtype=np.float32).astype(float)
            if (supplier and s != supplier) or (low and price < low) or not e32.any():
                continue
            sim = float(np.floor(e32 @ np.array(vec) / np.linalg.norm(e32) / np.linalg.norm(vec) * 1e10 + 0.5) / 1e10)
            if sim > 0:
                want.append((i, sim))
        want = sorted(want, key=lambda t: (-t[1], t[0]))[:k]
        assert [i for i, _ in got.get(qid, [])] == [i for i, _ in want]


def test_one_product_scan_for_any_number_of_queries(spark, tmp_path):
    from larder.operators import batches as bt

    _, _, goods, queries = random_case(spark)
    goods.write.parquet(f"{tmp_path}/goods")
    stored = spark.read.parquet(f"{tmp_path}/goods")
    for n in (1, 30, 100_000):
        many = queries.limit(n) if n <= 30 else spark.range(n).select(F.col("id").alias("query_id"), F.array(*[F.rand(i) - 0.5 for i in range(8)]).alias("query_embedding"))
        full = bt.complete(many)
        plan = vc.semantic_top(stored, full, bt.measure(full, 5), 0.5, 5)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1 and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_chunks_out_of_reach_are_skipped():
    """Clustered chunks: the bound leaves out most of them and loses no hit."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    centres = vc._unit(rng.normal(size=(20, 32)))
    asked = pa.array([{"query_id": i, "query_embedding": c.tolist(), "result_limit": 3, "supplier_filter": None, "price_min": None, "price_max": None} for i, c in enumerate(centres)])
    block, whole, live = vc._Block(asked, 32, 3, 0.5), [], 0
    for k, c in enumerate(centres):
        near = vc._unit(c + rng.normal(size=(50, 32)) * 0.05)
        rows = {"id": list(range(k * 50, k * 50 + 50)), "embedding": near.tolist(), "supplier_id": ["s"] * 50, "price": [1.0] * 50, "dim": [32] * 50}
        (chunk,) = vc._packer(64)([pa.RecordBatch.from_pydict(rows, pa.schema([("id", pa.int64()), ("embedding", pa.list_(pa.float64())), ("supplier_id", pa.string()), ("price", pa.float64()), ("dim", pa.int32())]))])
        one = {"ids": chunk.column("ids")[0].values.to_pandas(), "suppliers": chunk.column("suppliers")[0].values, "prices": np.ones(50),
               "vectors": np.frombuffer(chunk.column("vectors")[0].as_buffer()).reshape(-1, 32), "centre": np.frombuffer(chunk.column("centre")[0].as_buffer()), "radius": chunk.column("radius")[0].as_py()}
        live += int((one["centre"] @ block.unit + one["radius"] > 0.5).sum())
        found = block.hits(one)
        if found is not None:
            block.take(found)
        whole += [(q, -round(float(s), 9), k * 50 + r) for r, sims in enumerate(near @ centres.T) for q, s in enumerate(sims) if s > 0.5]
    want = [(q, i) for q in range(20) for _, _, i in sorted(w for w in whole if w[0] == q)[:3]]
    assert list(zip(block.kept["q"].tolist(), block.kept["id"].tolist(), strict=True)) == want and live <= 200  # at least half of the chunks are skipped


def test_cosine_column(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(cosine_similarity(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(0.5**0.5) and got[1:] == [None, None]


def test_approximate_search_recall(spark):
    _, _, goods, queries = random_case(spark, n=300)
    plain = queries.select("query_id", "query_embedding")
    near = vc.search_approximate(goods, plain, 0.5, 10).select("query_id", "id")
    from larder.operators import batches as bt

    full = bt.complete(plain)
    exact = vc.semantic_top(goods, full, bt.measure(full, 10), 0.5, 10).select("query_id", "id")
    assert near.join(exact, ["query_id", "id"]).count() >= 0.8 * exact.count()


def test_hybrid_fusion(spark):
    got = search_hybrid(products(spark), suppliers(spark), "prosecco doc", X, similarity_threshold=0.3).collect()
    by_id = {r["id"]: r for r in got}
    assert set(by_id) == {"p1", "p5", "p2"}  # p5 by text only, p2 by vector only
    best = max(r["fts_rank"] for r in got)
    for r in got:
        want = 0.4 * r["fts_rank"] / best + 0.6 * r["semantic_similarity"]
        assert r["combined_score"] == pytest.approx(want, abs=2e-6)
    assert by_id["p5"]["semantic_similarity"] == 0.0 and by_id["p2"]["fts_rank"] == 0.0


def test_hybrid_branch_cut_is_kept(spark):
    # with limit 1 the text branch keeps only p1; p2 enters by vector with rank 0 although it matches the text
    one = search_hybrid(products(spark), suppliers(spark), "prosecco", [1.0, 1.0, 1.0, 1.0], result_limit=1, fts_weight=0.0, semantic_weight=1.0)
    row = one.collect()
    assert [(r["id"], r["fts_rank"]) for r in row] == [("p2", 0.0)]


def test_hybrid_without_vector_or_text(spark):
    text_only = search_hybrid(products(spark), suppliers(spark), "prosecco doc", None)
    assert ids(text_only) == ["p1", "p5"]
    vector_only = search_hybrid(products(spark), suppliers(spark), "zzz", X).collect()
    assert [(r["id"], r["combined_score"]) for r in vector_only] == [("p1", 0.6), ("p2", 0.3)]


def test_hybrid_batch_equals_single(spark):
    asked = [("prosecco doc", X), ("caffè", None), ("zzz", X), ("sale or prosecco", [0.0, 1.0, 0.0, 0.0])]
    asks = spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(asked)], "query_id int, search_text string, query_embedding array<double>")
    got = {}
    for r in search_hybrid_batch(products(spark), suppliers(spark), asks).orderBy("query_id", "rank_no").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["combined_score"]))
    for i, (t, v) in enumerate(asked):
        one = search_hybrid(products(spark), suppliers(spark), t, v).collect()
        assert got.get(i, []) == [(r["id"], r["combined_score"]) for r in one]


def raw(spark):
    rows = [
        (1, "prosecco", "nord", None, None, "20", "0.4", "0.6"),
        (2, "", None, None, None, None, None, None),
        (3, "x" * 501, None, None, None, None, None, None),
        (4, "prosecco", "nobody", "cheap", None, None, None, None),
        (5, "prosecco", "nobody", None, "7.99", "1", None, None),
        (6, "prosecco", "% OFF_", None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, "query_id int, query string, supplier string, price_min string, price_max string, limit string, fts_weight string, semantic_weight string")


def test_search_entry(spark):
    run = search(raw(spark), products(spark), suppliers(spark), hashing_embedder(4))
    assert {(r["query_id"], r["reject"]) for r in run.rejects.collect()} == {
        (2, "query_missing"), (3, "query_too_long"), (4, "price_min_not_number")
    }
    out = {}
    for r in run.results.collect():
        out.setdefault(r["query_id"], set()).add(r["id"])
    assert out[1] <= {"p1", "p5"} and out[1] >= {"p1"}
    assert len(out[5]) == 1  # an unknown supplier leaves the search unfiltered
    assert out.get(6, set()) <= {"p6"}  # the name is a literal, its wildcards do nothing
    strict = search(raw(spark), products(spark), suppliers(spark), hashing_embedder(4), strict_supplier=True)
    assert 5 not in {r["query_id"] for r in strict.results.collect()}


def test_encoding_keeps_nulls_and_empty_queries(spark, tmp_path):
    asks = spark.createDataFrame([(1, "sale"), (2, "zzz")], "query_id int, search_text string")
    from larder.operators.fulltext import search_fts_batch

    hits = search_fts_batch(products(spark), suppliers(spark), asks)
    docs = {r["query_id"]: r["document"] for r in result_documents(asks, hits, ["id", "price"]).collect()}
    assert docs == {1: '{"query":"sale","count":1,"results":[{"id":"p3","price":null}]}', 2: '{"query":"zzz","count":0,"results":[]}'}
    lines = result_lines(asks, hits, ["id", "price"])
    write_lines(lines, str(tmp_path / "out"))
    got = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert '{"type":"result","data":{"id":"p3","price":null}}' in got and len(got) == 5
    notes = {r["query_id"]: r["message"] for r in search_messages(asks, hits).collect()}
    assert notes == {1: None, 2: 'Nessun risultato per: "zzz"'}


def test_assistant_columns(spark):
    asks = spark.createDataFrame([(1, "prosecco", X)], "query_id int, search_text string, query_embedding array<double>")
    out = assistant_search(asks, products(spark), suppliers(spark))
    assert out.columns == ["query_id", "id", "description", "supplier_name", "supplier_code", "price", "selling_uom", "combined_score"]
