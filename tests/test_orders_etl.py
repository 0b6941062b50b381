import json
from decimal import Decimal

import numpy as np
import pytest
from frames import products, suppliers
from pyspark.sql import functions as F

from larder.operators import loading
from larder.operators import maintenance as mt
from larder.operators.analytics import change_status, compare_suppliers, export_csv
from larder.operators.cart import decimal_comma, pack_count, unit_price
from larder.operators.orders import price_orders
from larder.plans.importing import import_products
from larder.sources import price_lists as pl


def customers(spark):
    return spark.createDataFrame(
        [("c1", "u1", "ACME", "IT1", "Hotel A", None, "Ann", None, None)],
        "id string, auth_user_id string, company_name string, vat_number string, hotel_name string, hotel_address string, "
        "contact_person string, contact_role string, phone string",
    )


def item(product, qty):
    return {"product_id": product, "qty": qty}


CASES = {
    "ok": ("u1", [item("p1", 2), item("p2", "3")], None),
    "same_twice": ("u1", [item("p1", 1), item("p1", 1)], None),
    "unknown_user": ("u9", [item("p1", 0)], "customer_not_found"),
    "null_items": ("u1", None, "no_items"),
    "empty": ("u1", [], "no_items"),
    "hundred": ("u1", [item("p1", 1)] * 100, None),
    "too_many": ("u1", [item("p1", 1)] * 101, "too_many_items"),
    "qty_zero": ("u1", [item("p1", 0)], "qty_invalid"),
    "qty_negative": ("u1", [item("p1", -1)], "qty_invalid"),
    "qty_null": ("u1", [item("p1", None)], "qty_invalid"),
    "qty_fraction": ("u1", [item("p1", 2.5)], "qty_not_integer"),
    "qty_text": ("u1", [item("p1", "abc")], "qty_not_integer"),
    "no_product": ("u1", [item("p9", 1)], "product_not_found"),
    "no_price": ("u1", [item("p3", 1)], "product_without_price"),
    "first_wins": ("u1", [item("p1", 1), item("p9", 1), item("p1", 0)], "product_not_found"),
    "check_order": ("u1", [item("p9", 0)], "qty_invalid"),
    "overflow": ("u1", [item("p4", 2147483647)], "total_overflow"),
    "broken": ("u1", "no json", "no_items"),
}


def test_order_pricing(spark):
    rows = [(k, u, i if i is None or isinstance(i, str) else json.dumps(i)) for k, (u, i, _) in CASES.items()]
    requests = spark.createDataFrame(rows, "request_id string, auth_user_id string, items string")
    out = price_orders(requests, products(spark), suppliers(spark), customers(spark))
    rejects = {r["request_id"]: r["reason"] for r in out.rejects.collect()}
    assert rejects == {k: reason for k, (_, _, reason) in CASES.items() if reason}
    orders = {r["id"]: r for r in out.orders.collect()}
    assert set(orders) == {k for k, (_, _, reason) in CASES.items() if reason is None}
    ok = orders["ok"]
    assert ok["total"] == Decimal("32.60") and ok["status"] == "pending"
    assert ok["delivery_address"] == "" and ok["contact_phone"] == "" and ok["billing_company"] == "ACME"
    items = [r for r in out.order_items.collect() if r["order_id"] == "same_twice"]
    assert len(items) == 2 and {r["supplier_name"] for r in items} == {"NORD SPA"}
    assert {r["order_id"] for r in out.order_items.collect()} == set(orders)


def test_hot_product_is_priced_whole(spark):
    requests = spark.range(600).select(
        F.col("id").cast("string").alias("request_id"), F.lit("u1").alias("auth_user_id"),
        F.lit('[{"product_id":"p1","qty":1}]').alias("items"),
    )
    out = price_orders(requests, products(spark), suppliers(spark), customers(spark))
    assert out.orders.agg(F.sum("total")).first()[0] == Decimal("2580.00")


RAW = [
    ("NORD SPA", 8, " 123 ", " Vino ", "PZ", None, "4.5"),
    ("NORD SPA", 9, "  ", "no code", None, None, "1"),
    ("NORD SPA", 10, "124", None, None, None, "1"),
    ("NORD SPA", 11, "125", "price text", "", "KG", "abc"),
    ("NORD SPA", 12, "126", "no price", None, None, None),
    ("nobody", 8, "1", "x", None, None, "1"),
    ("NORD SPA", 13, "127", "nan price", None, None, "NaN"),
]


def test_clean_rows(spark):
    raw = spark.createDataFrame(RAW, "sheet string, line_no long, c0 string, c1 string, c2 string, c3 string, c4 string")
    got = {r["supplier_code"]: r for r in pl.clean_rows(raw, suppliers(spark), "L1").collect()}
    assert set(got) == {"123", "125", "126", "127"}
    assert got["123"]["price"] == Decimal("4.50") and got["123"]["description"] == "Vino"
    assert got["125"]["price"] is None and got["125"]["selling_uom"] is None and got["127"]["price"] is None
    assert got["123"]["currency"] == "EUR" and got["123"]["price_list_id"] == "L1"
    problems = {(r["sheet"], r["problem"]) for r in pl.unknown_sheets(raw, suppliers(spark)).collect()}
    assert problems == {("ALPI SPA", "missing"), ("50% OFF_SHOP", "missing"), ("nobody", "unknown")}


def test_read_sheets_and_json(spark, tmp_path):
    folder = tmp_path / "sheets" / "NORD SPA"
    folder.mkdir(parents=True)
    head = "title,,,,\n" * 7
    (folder / "list.csv").write_text(head + '0123,"Vino ""rosso""\nriserva",PZ,PZ,"4.5"\n,,,,\n7,Acqua,,,\n', encoding="utf-8")
    rows = pl.read_sheets(spark, str(tmp_path / "sheets")).orderBy("line_no").collect()
    assert [(r["sheet"], r["c0"], r["c1"], r["c4"]) for r in rows] == [
        ("NORD SPA", "0123", 'Vino "rosso"\nriserva', "4.5"), ("NORD SPA", None, None, None), ("NORD SPA", "7", "Acqua", None)
    ]
    records = [{"price_list_id": "L", "supplier_id": "s1", "supplier_code": "1", "description": "d", "price": 4.5}]
    (tmp_path / "all.json").write_text(json.dumps(records), encoding="utf-8")
    got = pl.read_json(spark, str(tmp_path / "all.json")).collect()
    assert len(got) == 1 and got[0]["price"] == "4.5" and got[0]["selling_uom"] is None


def test_import_summary_and_write(spark, tmp_path):
    got = pl.import_summary(products(spark).withColumn("supplier_id", F.when(F.col("id") == "p6", "zz").otherwise(F.col("supplier_id"))), suppliers(spark))
    assert [(r["supplier"], r["n_products"]) for r in got.collect()] == [("NORD SPA", 3), ("ALPI SPA", 2), ("zz", 1)]
    pl.write_products(products(spark).withColumn("price_list_id", F.lit("L1")), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).where("price_list_id = 'L1'").count() == 6


def replay_batches(rows, target, size):
    """The loader as it is described: batches in turn, a conflict rejects the batch."""
    held, verdict = set(target), {}
    for b in range(0, max(r[0] for r in rows) // size + 1):
        keys = [k for n, k in rows if n // size == b]
        ok = len(set(keys)) == len(keys) and not held & set(keys)
        verdict[b] = "accepted" if ok else "rejected"
        if ok:
            held |= set(keys)
    return verdict


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batch_atomic_load(spark, seed):
    import random

    rng = random.Random(seed)
    rows = [(n, rng.randrange(400)) for n in range(200)]
    target = [rng.randrange(400) for _ in range(3)]
    load = spark.createDataFrame(rows, "line_no long, k int")
    have = spark.createDataFrame([(t,) for t in target], "k int")
    out = loading.split_new_batches(load, have, ["k"], "line_no", 5)
    got = {r["batch_no"]: r["status"] for r in out.select("batch_no", "status").distinct().collect()}
    assert got == replay_batches(rows, target, 5)


def test_row_conflicts(spark):
    rows = [(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, "c")]
    load = spark.createDataFrame(rows, "line_no int, k string")
    have = spark.createDataFrame([("b",)], "k string")
    got = {r["line_no"]: r["status"] for r in loading.split_new_rows(load, have, ["k"]).collect()}
    assert got == {1: "accepted", 2: "duplicate_in_load", 3: "exists_in_target", 4: "accepted", 5: "duplicate_in_load"}


def test_erase_follows_children(spark):
    tables = {
        "users": spark.createDataFrame([("u1",), ("u2",)], "id string"),
        "customers": spark.createDataFrame([("c1", "u1"), ("c2", "u2")], "id string, auth_user_id string"),
        "chat_messages": spark.createDataFrame([("m1", "c1"), ("m2", "c2")], "id string, customer_id string"),
    }
    left = mt.erase(tables, "users", spark.createDataFrame([("u1",)], "id string"))
    assert {n: [r["id"] for r in df.collect()] for n, df in left.items()} == {"users": ["u2"], "customers": ["c2"], "chat_messages": ["m2"]}
    counts = {r["table"]: (r["n_before"], r["n_after"]) for r in mt.erased_counts(tables, left).collect()}
    assert counts["chat_messages"] == (2, 1)


def test_violations(spark):
    tables = {
        "suppliers": spark.createDataFrame([("s1", "A"), ("s2", "A"), ("s3", None)], "id string, name string"),
        "items": spark.createDataFrame([("i1", "s1", "user"), ("i2", "s9", "boss")], "id string, supplier_id string, role string"),
    }
    got = {tuple(r) for r in mt.violations(
        tables, not_null=[("suppliers", "id", "name")], unique=[("suppliers", ["name"])],
        references=[("items", "id", "supplier_id", "suppliers")], allowed=[("items", "id", "role", ["user"])]).collect()}
    assert got == {("suppliers", "not_null:name", "s3"), ("suppliers", "unique:name", "A"),
                   ("items", "references:supplier_id->suppliers", "i2"), ("items", "allowed:role", "i2")}


def test_embedding_backfill(spark):
    made = mt.embed_missing(products(spark), mt.hashing_embedder(4))
    assert made.where(F.col("embedding").isNull()).count() == 0
    again = mt.embed_missing(products(spark), mt.hashing_embedder(4))
    assert made.select("id", "embedding").exceptAll(again.select("id", "embedding")).count() == 0

    def failing(texts):
        raise RuntimeError("remote is down")

    report = mt.embed_report(products(spark), mt.embed_missing(products(spark), failing)).first()
    assert tuple(report) == (0, 1, 1)


def test_hashed_texts_are_unit_vectors(spark):
    """Words whose signs cancel still give a unit vector; only a blank text gives zeros."""
    from larder.plans.etl_queries import embed_vectors

    texts = ["w14 w22", "W14 w22 w14 w22", "w14", "\n", "", "  "]  # w14 and w22 meet in one place with opposite signs
    norms = np.linalg.norm(mt.hashing_embedder()(texts), axis=1)
    assert norms.tolist() == pytest.approx([1, 1, 1, 1, 0, 0])

    class Rows:
        def docs(self, embedding):
            return spark.createDataFrame([(1, "w14 w22", None), (2, "", None), (3, "x", [0.5] * 64)], "id int, description string, embedding array<float>")

    got = {r["id"]: (r["n_dims"], r["kept_first"], r["norm"]) for r in embed_vectors(Rows()).collect()}
    assert got == {1: (64, None, 1.0), 2: (64, None, None), 3: (64, 0.5, None)}


def test_touch_and_status(spark):
    old = spark.createDataFrame([("1", "a", 0), ("2", "b", 0), ("3", "c", 0)], "id string, v string, updated_at int")
    new = spark.createDataFrame([("1", "a"), ("2", "x")], "id string, v string")
    every = {r["id"]: (r["v"], r["updated_at"]) for r in mt.touch(old, new, "id", ["v"], F.lit(9)).collect()}
    assert every == {"1": ("a", 9), "2": ("x", 9), "3": ("c", 0)}
    some = {r["id"]: r["updated_at"] for r in mt.touch(old, new, "id", ["v"], F.lit(9), only_changed=True).collect()}
    assert some == {"1": 0, "2": 9, "3": 0}
    orders = spark.createDataFrame([("1", "pending"), ("2", "shipped")], "id string, status string")
    asks = spark.createDataFrame([("1", "confirmed"), ("1", "shipped"), ("2", "delivered"), ("7", "confirmed")], "id string, new_status string")
    got = {(r["id"], r["new_status"]): bool(r["accepted"]) for r in change_status(orders, asks).collect()}
    assert got == {("1", "confirmed"): True, ("1", "shipped"): False, ("2", "delivered"): True, ("7", "confirmed"): False}


def test_unit_prices(spark, tmp_path):
    df = spark.createDataFrame([("6X1,5 L", "11,98"), ("12 x 75 CL", "1.200,50"), ("PZ", "2"), (None, "x")], "uom string, price string")
    got = df.select(pack_count(F.col("uom")).alias("n"), decimal_comma(F.col("price")).alias("p")).collect()
    assert [(r["n"], r["p"]) for r in got] == [(6, 11.98), (12, 1200.5), (1, 2.0), (1, None)]
    one = spark.range(1).select(unit_price(F.lit("11.98"), F.lit("6X1,5 L")).alias("u")).first()["u"]
    assert one == Decimal("2.00")
    export_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 4


def test_compare_suppliers_brute_force(spark):
    import itertools
    import random

    rng = random.Random(5)
    words = ["vino", "rosso", "bianco", "doc", "riserva"]
    rows = [(i, f"s{rng.randrange(3)}", " ".join(rng.sample(words, 2)) if i % 3 else "vino rosso") for i in range(60)]
    goods = spark.createDataFrame(rows, "id int, supplier_id string, description string")

    def grams(t):
        return {f"  {w} "[i : i + 3] for w in t.split() for i in range(len(w) + 1)}

    want = {}
    for (i, s, t), (j, r, u) in itertools.product(rows, rows):
        a, b = grams(t), grams(u)
        sim = len(a & b) / len(a | b)
        if s != r and sim > 0.4:
            want.setdefault(i, []).append((-round(sim, 6), j))
    got = {}
    for r in compare_suppliers(goods, k=4, threshold=0.4).orderBy("id", "place").collect():
        got.setdefault(r["id"], []).append((-round(r["similarity"], 6), r["other_id"]))
    assert got == {i: sorted(v)[:4] for i, v in want.items()}


def test_import_run(spark, tmp_path):
    raw = spark.createDataFrame(RAW + [("NORD SPA", 14, "123", "again", None, None, "9")], "sheet string, line_no long, c0 string, c1 string, c2 string, c3 string, c4 string")
    load = pl.clean_rows(raw, suppliers(spark), "L1")
    have = spark.createDataFrame([("L1", "s1", "126")], "price_list_id string, supplier_id string, supplier_code string")
    dry = import_products(load, have, suppliers(spark))
    assert {r["supplier_code"] for r in dry.accepted.collect()} == {"123", "125", "127"}
    assert {(r["line_no"], r["status"]) for r in dry.rejected.collect()} == {(14, "duplicate_in_load"), (12, "exists_in_target")}
    assert [tuple(r) for r in dry.summary.collect()] == [("NORD SPA", 5)]
    import_products(load, have, suppliers(spark), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    whole = import_products(load.withColumn("line_no", F.col("line_no") - 8), have, suppliers(spark), batch_atomic=True)
    assert whole.accepted.count() == 0
    meta = pl.register_price_list(spark, "L1", "Hotel", None, None, "file.xlsx").first()
    assert meta["hotel_name"] == "Hotel" and meta["notes"] is None
