"""The plans the operators are meant to get."""

from frames import products, suppliers
from pyspark.sql import functions as F

from larder.operators.fulltext import search_fts, search_fts_batch
from larder.operators.vectors import search_semantic_batch


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stored(spark, tmp_path):
    path = str(tmp_path / "products")
    products(spark).write.parquet(path)
    return spark.read.parquet(path)


def test_filters_reach_the_scan(spark, tmp_path):
    df = search_fts(stored(spark, tmp_path), suppliers(spark), "prosecco", supplier_filter="s1", price_max=10)
    scan = next(line for line in plan_of(df).splitlines() if "FileScan" in line)
    assert "EqualTo(supplier_id,s1)" in scan and "LessThanOrEqual(price,10.00)" in scan
    assert "embedding" not in scan.split("ReadSchema")[1]
    assert "TakeOrderedAndProject" in plan_of(df)


def test_batch_prunes_before_the_shuffle_and_keeps_products_in_place(spark, tmp_path):
    asks = spark.createDataFrame([(1, "prosecco"), (2, "sale")], "query_id int, search_text string")
    plan = plan_of(search_fts_batch(stored(spark, tmp_path), suppliers(spark), asks, result_limit=5))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    lines = plan.splitlines()
    limits = [i for i, line in enumerate(lines) if "WindowGroupLimit" in line]
    exchange = next(i for i, line in enumerate(lines) if "Exchange hashpartitioning(query_id" in line)
    # a partial limit below the only shuffle of hits
    assert len(limits) == 2 and limits[0] < exchange < limits[1]
    # neither the lookup nor the late join of wide columns shuffles products
    assert "SortMergeJoin [anchor" not in plan and "SortMergeJoin [id" not in plan


def test_vector_search_reads_narrow_rows(spark, tmp_path):
    asks = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "query_id int, query_embedding array<double>")
    plan = plan_of(search_semantic_batch(stored(spark, tmp_path), suppliers(spark), asks, 0.1))
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    vectors = next(line for line in scans if "embedding" in line.split("ReadSchema")[1])
    assert "description" not in vectors.split("ReadSchema")[1]
    assert "IsNotNull(embedding)" in vectors


def test_index_search_reads_asked_buckets_and_no_texts(spark, tmp_path):
    from larder.operators.fulltext import search_fts
    from larder.operators.textindex import bucket_of, search_fts_indexed, write_text_index

    rows = [(i, 1, f"c{i}", text, "u", "u", 1.0) for i, text in enumerate(
        ["red wine of the house", "the house of red", "white wine", "wine wine red", "of the of the", ""] * 3)]
    products = spark.createDataFrame(rows, "id long, supplier_id long, supplier_code string, description string, selling_uom string, pricing_uom string, price double")
    suppliers = spark.createDataFrame([(1, "S")], "id long, name string")
    write_text_index(products, str(tmp_path / "index"), buckets=8)
    products.write.parquet(str(tmp_path / "products"))
    index, stored = spark.read.parquet(str(tmp_path / "index")), spark.read.parquet(str(tmp_path / "products"))
    assert {(r["lexeme"], r["bucket"]) for r in index.collect()} == {(w, bucket_of(w, 8)) for w in "red wine of the house white".split()}
    for text in ("red wine", '"of the"', "wine -red", "house or white", "-red", "wine", '"of the" -house', "nothing"):
        key = lambda df: [(r["id"], r["rank"]) for r in df.collect()]
        assert key(search_fts_indexed(index, stored, suppliers, text, buckets=8)) == key(search_fts(stored, suppliers, text, long_texts=True)), text
    plan = search_fts_indexed(index, stored, suppliers, "red wine", buckets=8)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "In(lexeme" in plan
    scans = [part for part in plan.split("FileScan parquet ")[1:] if "supplier_code" in part.split("Batched")[0]]
    assert len(scans) == 1  # texts are read once, by the join with the best rows


def test_gram_index_equals_scan(spark, tmp_path):
    from larder.operators.fuzzy import search_fuzzy
    from larder.operators.textindex import search_fuzzy_indexed, write_gram_index

    texts = ["red wine", "red whine", "rad wine", "white", "wine wine wine red", "", "r", None, "a much longer text about red wine and other things"]
    rows = [(i, 1, f"c{i}", t, "u", "u", 1.0) for i, t in enumerate(texts)]
    products = spark.createDataFrame(rows, "id long, supplier_id long, supplier_code string, description string, selling_uom string, pricing_uom string, price double")
    suppliers = spark.createDataFrame([(1, "S")], "id long, name string")
    write_gram_index(products, str(tmp_path / "grams"), buckets=8)
    index = spark.read.parquet(str(tmp_path / "grams"))
    for text in ("red wine", "wihte", "r", "", "zzz"):
        for threshold in (0.0, 0.2, 0.5):
            key = lambda df: [(r["id"], round(r["similarity"], 12)) for r in df.collect()]
            assert key(search_fuzzy_indexed(index, products, suppliers, text, threshold, buckets=8)) == key(search_fuzzy(products, suppliers, text, threshold)), (text, threshold)
    plan = search_fuzzy_indexed(index, products, suppliers, "red wine", 0.5, buckets=8)._jdf.queryExecution().executedPlan().toString()
    scan = next(part for part in plan.split("FileScan parquet ")[1:] if "gram#" in part)
    assert "bucket#" in scan.split("PartitionFilters: [")[1].split("PushedFilters")[0] and "DataFilters: [isnotnull(n#" in scan


def test_batch_on_the_index_equals_scan_and_opens_asked_buckets(spark, tmp_path):
    from larder.operators.fulltext import search_fts_batch
    from larder.operators.fuzzy import search_fuzzy_batch
    from larder.operators.textindex import search_fts_indexed_batch, search_fuzzy_indexed_batch, write_gram_index, write_text_index

    texts = ["red wine of the house", "the house of red", "white wine", "wine wine red", "of the of the", "", None, "house wine"]
    rows = [(i, i % 2 + 1, f"c{i}", text, "u", "u", float(i)) for i, text in enumerate(texts * 3)]
    products = spark.createDataFrame(rows, "id long, supplier_id long, supplier_code string, description string, selling_uom string, pricing_uom string, price double")
    suppliers = spark.createDataFrame([(1, "S"), (2, "T")], "id long, name string")
    asked = ["red wine", '"of the"', "wine -red", "house or white", "-red", "wine", '"of the" -house', "nothing", "", None, "wihte wnie", "the the"]
    asks = [(n, t, float(9 + n) if n % 3 == 0 else None, 1 if n % 4 == 1 else None, n % 5 + 1) for n, t in enumerate(asked)]
    queries = spark.createDataFrame(asks, "query_id int, search_text string, price_max double, supplier_filter long, result_limit int")
    write_text_index(products, str(tmp_path / "index"), buckets=8)
    write_gram_index(products, str(tmp_path / "grams"), buckets=8)
    index, grams = spark.read.parquet(str(tmp_path / "index")), spark.read.parquet(str(tmp_path / "grams"))
    key = lambda df, score: sorted((r["query_id"], r["rank_no"], r["id"], r["description"], round(r[score], 12)) for r in df.collect())
    found = search_fts_indexed_batch(index, products, suppliers, queries, buckets=8)
    assert key(found, "rank") == key(search_fts_batch(products, suppliers, queries, long_texts=True), "rank")
    for threshold in (0.0, 0.3):
        near = search_fuzzy_indexed_batch(grams, products, suppliers, queries, threshold, buckets=8)
        assert key(near, "similarity") == key(search_fuzzy_batch(products, suppliers, queries, threshold), "similarity")
    for plan in (found, near):
        assert "dynamicpruning" in plan._jdf.queryExecution().executedPlan().toString().lower()
    empty = search_fts_indexed_batch(index, products, suppliers, queries.limit(0), buckets=8)
    assert empty.collect() == []


def test_index_is_written_with_one_shuffle_and_spreads_a_hot_lexeme(spark, tmp_path):
    from larder.operators import textindex as ti

    rows = spark.range(0, 4000, numPartitions=8).select("id", F.concat(F.lit("hot w"), F.col("id") % 7).alias("description"))
    tracker, group = spark.sparkContext.statusTracker(), "index-is-written"
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    spark.sparkContext.setJobGroup(group, group)
    try:
        ti.write_text_index(rows, str(tmp_path / "index"), buckets=4)
    finally:
        spark.sparkContext.setJobGroup("", "")
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    ran = [s for s in stages if (i := tracker.getStageInfo(s)) and i.numCompletedTasks]
    assert len(ran) == 2  # the texts, and the files: no sampling of the postings, no shuffle before the last
    index = spark.read.parquet(str(tmp_path / "index"))
    hot = index.where("lexeme = 'hot'").select("id", F.input_file_name().alias("file")).collect()
    assert sorted(r["id"] for r in hot) == list(range(4000)) and len({r["file"] for r in hot}) > 1
    assert index.count() == 8000


def test_trigram_batch_deals_postings_by_text_before_they_meet_the_queries(spark, tmp_path):
    """A trigram of many queries fans out after the deal, and what it makes is counted without another shuffle."""
    from larder.operators import textindex as ti

    asks = spark.createDataFrame([(i, f"red wine {i}") for i in range(9)], "query_id int, search_text string")
    ti.write_gram_index(products(spark), str(tmp_path / "grams"), buckets=4)
    near = ti.search_fuzzy_indexed_batch(spark.read.parquet(str(tmp_path / "grams")), products(spark), suppliers(spark), asks, buckets=4)
    plan = plan_of(near)
    deal = plan[: plan.index("LeftSemi")].rindex("hashpartitioning(id")
    assert "REPARTITION_BY_NUM" in plan[deal:].splitlines()[0]
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(query_id" in line and ", id#" in line.split("ENSURE")[0]]
