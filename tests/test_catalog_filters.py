import pytest
from frames import ids, products, suppliers
from pyspark.sql import functions as F

from larder.functions.text import escape_like
from larder.operators.catalog import register_sql_function, search_catalog
from larder.operators.classify import classify, coverage, fill_categories, read_rules
from larder.operators.filters import clamp, normalise_chat_requests, normalise_queries, optional_filters, resolve_supplier
from larder.sources.seeds import CATEGORIES, seed_categories


def page(spark, **kw):
    return search_catalog(products(spark), suppliers(spark), seed_categories(spark), **kw)


def test_filters(spark):
    p = products(spark)
    assert ids(optional_filters(p, price_min=5, price_max=8).orderBy("id")) == ["p2", "p5"]
    assert len(ids(optional_filters(p))) == 6
    assert ids(optional_filters(p, supplier="nobody")) == []
    assert "p3" not in ids(optional_filters(p, price_min=0))


def test_escape_like(spark):
    cases = [("50%off", r"50\%off"), ("product_name", r"product\_name"), (r"path\to\file", r"path\\to\\file"),
             (r"50%_\test", r"50\%\_\\test"), ("NORD SPA", "NORD SPA"), ("", "")]
    df = spark.createDataFrame(cases, "a string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", escape_like(F.col("a")).alias("got")).collect())


def test_clamp(spark):
    got = spark.range(1).select(clamp(F.lit(150), 1, 100), clamp(F.lit(-5), 0, 1), clamp(F.lit(42), 1, 100)).first()
    assert tuple(got) == (100, 0, 42)


def test_normalise_limits_and_weights(spark):
    rows = [("999", "1.5"), ("0", "-0.5"), ("50", "0.6"), ("not-a-number", None), ("-5", "NaN"), (None, "abc"), ("2.7", "1e-1")]
    df = spark.createDataFrame([(i, "q", None, None, a, b, None) for i, (a, b) in enumerate(rows)],
                               "query_id int, query string, price_min string, price_max string, limit string, fts_weight string, semantic_weight string")
    got = normalise_queries(df).orderBy("query_id").collect()
    assert [r["result_limit"] for r in got] == [100, 20, 50, 20, 1, 20, 2]
    assert [r["fts_weight"] for r in got] == [1.0, 0.0, 0.6, 0.4, 0.4, 0.4, 0.1]
    assert [r["reject"] for r in got] == [None] * 5 + ["weight_not_number", None]


def test_chat_request_limits(spark):
    rows = [("x" * 2000, "s"), ("x" * 2001, "s"), ("  ", "s"), (None, "s"), ("hi ", ""), ("\U0001f600" * 1001, "s")]
    df = spark.createDataFrame(rows, "chat_input string, session_id string")
    got = [r["reject"] for r in normalise_chat_requests(df).collect()]
    assert got == [None, "input_too_long", "input_missing", "input_missing", "session_missing", "input_too_long"]


def test_resolve_supplier(spark):
    asks = spark.createDataFrame([(1, "spa"), (2, "alpi"), (3, "_off"), (4, "%"), (5, None), (6, ""), (7, "f_s"), (8, "a s")], "query_id int, supplier string")
    got = {r["query_id"]: r["supplier_filter"] for r in resolve_supplier(asks, suppliers(spark)).collect()}
    # ALPI SPA comes before NORD SPA; '_' and '%' are plain characters
    assert got == {1: "s2", 2: "s2", 3: None, 4: "s3", 5: None, 6: None, 7: "s3", 8: None}


def test_catalog_sorts_and_pages(spark):
    assert ids(page(spark, sort_by="price_asc")) == ["p6", "p1", "p5", "p2", "p4", "p3"]
    assert ids(page(spark, sort_by="price_desc")) == ["p4", "p2", "p5", "p1", "p6", "p3"]
    assert ids(page(spark, sort_by=None)) == ids(page(spark)) == ["p4", "p6", "p1", "p2", "p3", "p5"]
    assert ids(page(spark, sort_by="newest")) == ["p1", "p2", "p3", "p4", "p5", "p6"]
    pages = [r for o in range(0, 8, 2) for r in ids(page(spark, page_size=2, page_offset=o))]
    assert pages == ids(page(spark))
    assert {r["total_count"] for r in page(spark, page_size=2).collect()} == {6}
    assert page(spark, page_offset=50).collect() == []


def test_catalog_text(spark):
    assert len(ids(page(spark, search_text=""))) == 6
    assert ids(page(spark, search_text="prosecco extra")) == ["p1", "p5"]
    assert ids(page(spark, search_text="rosec")) == ["p1", "p2", "p5"]
    assert len(ids(page(spark, search_text="%"))) == 6
    assert ids(page(spark, search_text="s_le")) == ["p3"]
    row = page(spark, search_text="sale").first()
    assert row["category_name"] is None and row["supplier_name"] == "NORD SPA"
    assert "rank" not in row and "pricing_uom" not in row


def test_catalog_collation(spark):
    assert ids(page(spark, collation="UNICODE"))[0] == "p4"


def test_catalog_plan_has_no_single_partition_window(spark):
    df = page(spark)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "TakeOrderedAndProject" in plan


def test_sql_function(spark):
    products(spark).createOrReplaceTempView("t_products")
    suppliers(spark).createOrReplaceTempView("t_suppliers")
    seed_categories(spark).createOrReplaceTempView("t_categories")
    register_sql_function(spark, "t_products", "t_suppliers", "t_categories")
    got = spark.sql("SELECT id FROM search_catalog(search_text => 'prosecco', price_min => 5.0) ORDER BY id")
    assert ids(got) == ["p2", "p5"]
    assert spark.sql("SELECT * FROM search_catalog()").count() == 6


RULES = [(2, "birre", "birra|ale "), (1, "vini-spumanti", "^vino |prosecco"), (3, "caffe-te", "caff[eè] "), (4, "condimenti-conserve", "sale ")]


def test_classify(spark):
    got = {r["id"]: r["category_slug"] for r in classify(products(spark), RULES).collect()}
    # salt holds 'ale ' and so lands with the earlier beer rule
    assert got == {"p1": "vini-spumanti", "p2": "vini-spumanti", "p3": "birre", "p4": "caffe-te", "p5": "vini-spumanti", "p6": "altro"}
    assert coverage(classify(products(spark), RULES)).first()["coverage"] == pytest.approx(5 / 6, abs=1e-6)


def test_fill_categories(spark):
    old = products(spark).withColumn("category_id", F.lit("9"))
    got = {r["id"]: r["category_id"] for r in fill_categories(old, seed_categories(spark), RULES).collect()}
    assert got == {"p1": "1", "p2": "1", "p3": "9", "p4": "9", "p5": "1", "p6": "9"}
    kept = fill_categories(old, seed_categories(spark), RULES, first_overrides=False)
    assert {r["category_id"] for r in kept.collect()} == {"9"}


def test_rules_file(spark, tmp_path):
    (tmp_path / "rules.csv").write_text('priority,slug,pattern\n1,uova,"(^uov[aoe]|[^a-z]uov[aoe])"\n2,birre,birra\n', encoding="utf-8")
    rules = read_rules(spark, str(tmp_path / "rules.csv"))
    df = spark.createDataFrame([("Uova fresche",), ("nuovo",), ("BIRRA",)], "description string")
    assert [r["category_slug"] for r in classify(df, rules).collect()] == ["uova", "altro", "birre"]


def test_categories(spark):
    assert seed_categories(spark).count() == 16 and CATEGORIES[-1][1] == "altro"


def test_backslash_in_catalogue_text(spark):
    from larder.operators.catalog import live_pattern

    rows = spark.createDataFrame([(1, "ab"), (2, "a\\b"), (3, "a%b"), (4, "a_b"), (5, "axb")], "id int, description string")
    found = lambda text: [r["id"] for r in rows.where(F.col("description").ilike(live_pattern(text))).orderBy("id").collect()]
    assert found(r"a\b") == [1] and found(r"a\\b") == [2] and found(r"a\%b") == [3] and found(r"a\_b") == [4]
    assert found("a_b") == [2, 3, 4, 5] and found("a%b") == [1, 2, 3, 4, 5]


def test_cells_and_numbers(spark):
    from larder.functions.text import number, strip

    texts = ["12d", "0x1p3", " 1_000.5 ", "\t7\u00a0", "1e2", "-.5", "5.", "1__0", "_1", "", "NaN", "inf", "12f", None, "1,5"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in rows.orderBy("i").select(number("t")).collect()]
    assert got[:9] == [None, None, 1000.5, 7.0, 100.0, -0.5, 5.0, None, None]
    assert got[9] is None and got[10] != got[10] and got[11] == float("inf") and got[12:] == [None, None, None]
    blanks = spark.createDataFrame([("\t \u2003A b\u00a0\n",), ("\t",)], "t string")
    assert [r[0] for r in blanks.select(strip("t")).collect()] == ["A b", ""]
