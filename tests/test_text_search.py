import pyarrow as pa
import pytest
from frames import ids, products, suppliers, texts
from pyspark.sql import functions as F

from larder.functions import postings as po
from larder.functions import text as tx
from larder.functions.italian import stem
from larder.functions.websearch import read_query
from larder.operators import batches as bt
from larder.operators import fulltext as ft
from larder.operators import fuzzy as fz


def rank_of(spark, description, query, **options):
    rows = texts(spark, [("t", description)])
    found = ft.search_fts(rows, suppliers(spark), query, **options).collect()
    return found[0]["rank"] if found else None


@pytest.mark.parametrize(
    "description, query, rank",
    [
        ("red ring", "red", 0.060793),
        ("red ring", "red ring", 0.099103),
        ("red old ring", "red ring", 0.098501),
        ("red red", "red", 0.1 * (1 + 1 / 4) / 1.64493406685),
        ("red ring", "red or bolt", 0.0303964),
        ("red", "red -ring", 0.0),
        ("red ring", '"red ring"', 0.099103),
        ("ring red", '"red ring"', None),
        ("red ring", "red -ring", None),
        ("red ring", "red bolt", None),
        ("", "red", None),
        ("red", "", None),
        ("bolt", "-ring", 0.0),
    ],
)
def test_rank_values(spark, description, query, rank):
    for long_texts in (False, True):
        got = rank_of(spark, description, query, long_texts=long_texts)
        assert got == (None if rank is None else pytest.approx(rank, abs=1.1e-6))


def test_query_reader():
    assert read_query("a or b c").lexemes == ["a", "b", "c"]
    assert [c.required for c in read_query("a or b c").clauses] == [[[("a", 0)]], [[("b", 0)], [("c", 0)]]]
    assert read_query("or").lexemes == ["or"]
    assert read_query("a or").lexemes == ["a", "or"]
    assert read_query('"x y" -z').clauses[0].excluded == [[("z", 0)]]
    assert read_query("il di", "italian", frozenset(["il", "di"])).clauses == []


def test_stop_words_keep_positions(spark):
    rows = texts(spark, [("t", "birra di malto"), ("u", "birra malto")])
    found = ft.search_fts(rows, suppliers(spark), '"birra di malto"', config="italian")
    assert ids(found) == ["t"]
    only_stops = ft.search_fts(rows, suppliers(spark), "di il", config="italian")
    assert ids(only_stops) == []


def test_stemming_keeps_words_in_arrow(spark):
    """Each distinct word of a part is stemmed once, lists keep their lengths, and a batch is taken in parts."""
    lists = pa.array([["x"], None, [], ["vini", "di", "vini"], ["rossi"] * 5], pa.list_(pa.string())).slice(1)
    asked = []
    got = tx.lexeme_lists(lists, lambda w: asked.append(w) or ("" if w == "di" else stem(w)))
    assert got.to_pylist() == [None, [], ["vin", "", "vin"], ["ross"] * 5]
    assert asked == ["vini", "di", "rossi"]
    dealt = [list(part) for part in tx.parts(pa.array([["a"] * tx.PART_WORDS, [], ["b"], ["c"] * tx.PART_WORDS * 2]))]
    assert dealt == [[0, 2], [2, 1], [3, 1]]


def test_italian_search_matches_inflections(spark):
    rows = texts(spark, [("t", "bottiglie di vino rosso"), ("u", "CL75 bottiglia vini rossi")])
    assert sorted(ids(ft.search_fts(rows, suppliers(spark), "vini rossi bottiglia", config="italian"))) == ["t", "u"]
    assert ids(ft.search_fts(rows, suppliers(spark), "cl75", config="italian")) == ["u"]


@pytest.mark.parametrize(
    "word, want",
    [
        ("abbandonata", "abbandon"), ("abbandonare", "abbandon"), ("pronunciamento", "pronunc"), ("propaganda", "propagand"),
        ("velocemente", "veloc"), ("attività", "attiv"), ("acqua", "acqua"), ("piatti", "piatt"), ("bottiglie", "bottigl"),
        ("mangiarlo", "mang"), ("azione", "azion"),
    ],
)
def test_italian_stems(word, want):
    assert stem(word) == want


QUERIES = ["prosecco", "prosecco doc", '"extra prosecco"', "prosecco -doc", "caffè or sale", "-prosecco", "zzz or detersivo", "doc or extra"]


@pytest.mark.parametrize("small", [True, False])
def test_batch_equals_single(spark, small, monkeypatch):
    """The broadcast and the shuffle plan give what single queries give."""
    if not small:
        monkeypatch.setattr(bt, "MAX_BROADCAST_QUERIES", 0)
    asks = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, search_text string")
    got = {}
    for r in ft.search_fts_batch(products(spark), suppliers(spark), asks).orderBy("query_id", "rank_no").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["rank"], r["supplier_name"]))
    for i, q in enumerate(QUERIES):
        one = ft.search_fts(products(spark), suppliers(spark), q).collect()
        assert got.get(i, []) == [(r["id"], r["rank"], r["supplier_name"]) for r in one], q
        assert one


def test_batch_filters_and_limits(spark):
    asks = spark.createDataFrame(
        [(1, "prosecco", "s1", None, None, None), (2, "prosecco", None, 5.0, 8.0, None), (3, "prosecco", None, None, None, 1),
         (4, "sale", None, 0.0, None, None)],
        "query_id int, search_text string, supplier_filter string, price_min double, price_max double, result_limit int",
    )
    out = {}
    for r in ft.search_fts_batch(products(spark), suppliers(spark), asks).collect():
        out.setdefault(r["query_id"], set()).add(r["id"])
    assert out == {1: {"p1", "p5"}, 2: {"p2", "p5"}, 3: {"p1"}}


def test_stored_tokens_are_used(spark):
    rows = products(spark).withColumn("tokens", F.array(F.lit("x")))
    assert len(ids(ft.search_fts(rows, suppliers(spark), "x"))) == 6


def test_postings_cap_positions(spark):
    rows = texts(spark, [("t", "a b a"), ("u", " ".join(["w"] * 300))])
    got = {(r["lexeme"], r["id"]): r["positions"] for r in ft.postings(rows).collect()}
    assert got[("a", "t")] == [1, 3] and got[("b", "t")] == [2]
    assert got[("w", "u")] == list(range(1, 257))


def test_postings_move_no_words(spark):
    """Postings come from the task that reads the text; only what a caller groups afterwards is shuffled."""
    rows = texts(spark, [("t", "a b a"), ("u", "b")])
    for found in (ft.postings(rows), ft.located(rows)):
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limits", [False, True])
@pytest.mark.parametrize("part", [1, 7, 1 << 18])
def test_posting_batches_of_odd_rows(limits, part, monkeypatch):
    """Against plain loops: NULL lists, NULL and blank words, empty lists, a sliced batch, parts of any size, long texts."""
    monkeypatch.setattr(tx, "PART_WORDS", part)
    lists = [["x"], None, [], ["b", "a", "", "a", None, "b"], ["", ""], [f"w{i % 3}" for i in range(40)], ["h"] * 300, ["z", *["y"] * 20000, "z"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lists))), pa.array(lists, pa.list_(pa.string()))], names=["id", "tokens"]).slice(1)
    want = {}
    for i, words in enumerate(lists):
        for at, w in enumerate(words or []):
            if i and w:
                want.setdefault((w, i), []).append(at)
    if limits:
        want = {k: list(dict.fromkeys(min(p + 1, tx.MAX_POSITION) for p in at))[: tx.MAX_POSITIONS] for k, at in want.items()}
    got = [r for b in po.posting_batches(limits)([batch]) for r in b.to_pylist()]
    assert {(r["lexeme"], r["id"]): r["at"] for r in got} == want and len(got) == len(want)


def test_hot_lexeme_is_whole(spark):
    """A word in every text still ranks every text, also with more hits than the limit."""
    rows = texts(spark, [(f"{i:04d}", "hot bolt" if i % 3 else "hot") for i in range(900)])
    asks = spark.createDataFrame([(1, "hot"), (2, "bolt hot")], "query_id int, search_text string")
    n = ft.search_fts_batch(rows, suppliers(spark), asks, result_limit=1000).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in n} == {1: 900, 2: 600}


def test_trigram_similarity(spark):
    pairs = [("word", "two words", 4 / 11), ("", "", 0.0), ("abc", "abc", 1.0), ("Èa", "èA", 1.0), ("a-b", "b a", 1.0)]
    df = spark.createDataFrame(pairs, "a string, b string, want double")
    near = df.select("want", tx.trigram_similarity(F.col("a"), F.col("b")).alias("s"), tx.trigram_similarity(F.col("b"), F.col("a")).alias("t"))
    for r in near.collect():
        assert r["s"] == pytest.approx(r["want"]) and r["t"] == r["s"]


def test_fuzzy_threshold_is_strict(spark):
    rows = texts(spark, [("t", "two words"), ("u", "word")])
    hit = fz.search_fuzzy(rows, suppliers(spark), "word", similarity_threshold=0.3)
    assert [(r["id"], r["similarity"]) for r in hit.collect()] == [("u", 1.0), ("t", pytest.approx(4 / 11))]
    exact = fz.search_fuzzy(texts(spark, [("t", "abc")]), suppliers(spark), "abc", similarity_threshold=1.0)
    assert ids(exact) == []


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("threshold", [0.0, 0.2, 0.5])
def test_fuzzy_batch_equals_single(spark, small, threshold, monkeypatch):
    if not small:
        monkeypatch.setattr(bt, "MAX_BROADCAST_QUERIES", 0)
    asked = ["proseco doc", "detersivo", "caffe arabica", "sale", "zzz", "extra"]
    asks = spark.createDataFrame(list(enumerate(asked)), "query_id int, search_text string")
    for frequencies in (None, fz.trigram_frequencies(products(spark))):
        got = {}
        batch = fz.search_fuzzy_batch(products(spark), suppliers(spark), asks, threshold, frequencies=frequencies)
        for r in batch.orderBy("query_id", "rank_no").collect():
            got.setdefault(r["query_id"], []).append((r["id"], r["similarity"]))
        for i, q in enumerate(asked):
            one = fz.search_fuzzy(products(spark), suppliers(spark), q, threshold).collect()
            assert got.get(i, []) == [(r["id"], r["similarity"]) for r in one], (q, threshold)
    with pytest.raises(ValueError):
        fz.search_fuzzy_batch(products(spark), suppliers(spark), asks, -0.1)
