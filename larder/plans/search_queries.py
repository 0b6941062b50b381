"""Registered search queries: full text, fuzzy, vector, hybrid, catalogue, result encoding."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators import batches as bt
from larder.operators.catalog import search_catalog
from larder.operators.classify import classify
from larder.operators.encode import result_documents, result_lines
from larder.operators.fulltext import lexeme_stats, postings, search_fts, search_fts_batch
from larder.operators.fuzzy import search_fuzzy, search_fuzzy_batch, trigram_frequencies
from larder.operators.hybrid import search_hybrid, search_hybrid_batch
from larder.operators.textindex import (
    search_fts_indexed,
    search_fts_indexed_batch,
    search_fuzzy_indexed,
    search_fuzzy_indexed_batch,
    write_gram_index,
    write_text_index,
)
from larder.operators.vectorlists import candidates, read_vector_index, search_lists, write_vector_index
from larder.operators.vectors import search_approximate, search_semantic, search_semantic_batch
from larder.plans.registry import query
from larder.plans.search import assistant_search, search
from larder.plans.views import RULES, Views
from larder.session import cut_lineage, shared_folder

# ---------------------------------------------------------------- SQL building blocks


def words(text: str) -> str:
    return f"[x FOR x IN regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+') IF x <> '']"


def digits(x: str) -> str:
    """Ten significant digits, as the searches compare ranks and fused scores."""
    power = "pow(10, 9 - floor(log10(abs(v))))"
    return f"list_transform([({x})::DOUBLE], lambda v: CASE WHEN v = 0 THEN v ELSE floor(v * {power} + 0.5) / {power} END)[1]"


def positions_sql(view: str) -> str:
    return f"""
tok AS (SELECT id, unnest(t) AS lexeme, generate_subscripts(t, 1) AS pos
  FROM (SELECT id, {words('description')} AS t FROM {view})),
spot AS (SELECT id, lexeme, place AS pos, row_number() OVER (PARTITION BY id, lexeme ORDER BY place) AS j
  FROM (SELECT DISTINCT id, lexeme, least(pos, 16383) AS place FROM tok) QUALIFY j <= 256),"""


def rank_sql(terms: str) -> str:
    """Matches and ranks; ``terms``: (query_id, clause, lexeme, excluded) and filters in ``ask``."""
    return f"""
term AS ({terms}),
lex AS (SELECT query_id, list(DISTINCT lexeme) AS lexemes, count(DISTINCT lexeme) AS n,
    count(DISTINCT clause) = 1 AND count(*) > 1 AS together FROM term GROUP BY query_id),
clause_need AS (SELECT query_id, clause, count(*) FILTER (NOT excluded) AS need FROM term GROUP BY ALL),
present AS (SELECT DISTINCT id, lexeme FROM spot),
clause_hit AS (SELECT t.query_id, t.clause, w.id, count(*) FILTER (NOT excluded) AS got, count(*) FILTER (excluded) AS bad
  FROM term t JOIN present w USING (lexeme) GROUP BY ALL),
matched AS (SELECT DISTINCT query_id, id FROM clause_hit JOIN clause_need USING (query_id, clause) WHERE got = need AND bad = 0),
found AS (SELECT m.query_id, m.id, s.lexeme, s.pos, s.j FROM matched m JOIN lex USING (query_id)
  JOIN spot s ON s.id = m.id AND list_contains(lex.lexemes, s.lexeme)),
or_rank AS (SELECT query_id, id, sum(0.1 / (j * j)) AS s FROM found GROUP BY ALL),
gap AS (SELECT a.query_id, a.id, abs(a.pos - b.pos) AS d FROM found a JOIN found b
    ON a.query_id = b.query_id AND a.id = b.id AND a.lexeme < b.lexeme AND a.pos <> b.pos
    WHERE a.query_id IN (SELECT query_id FROM lex WHERE together AND n > 1)),
and_rank AS (SELECT query_id, id, 1 - exp(sum(ln(1 - 0.1 * sqrt(CASE WHEN d > 100 THEN 1e-30
    ELSE 1.0 / (1.005 + 0.05 * exp(d / 1.5 - 2.0)) END)))) AS r FROM gap GROUP BY ALL),
hit AS (SELECT m.query_id, m.id, {digits("CASE WHEN together AND n > 1 THEN coalesce(r, 1e-20) ELSE coalesce(s, 0) / 1.64493406685 / n END")} AS rank
  FROM matched m JOIN lex USING (query_id) LEFT JOIN or_rank USING (query_id, id) LEFT JOIN and_rank USING (query_id, id)),"""


def one_query(*terms) -> str:
    rows = ", ".join(f"(0, {c}, '{w}', {str(x).lower()})" for c, w, x in terms)
    return f"SELECT * FROM (VALUES {rows}) t(query_id, clause, lexeme, excluded)"


PRODUCT = "supplier_code, description, selling_uom, pricing_uom, CAST(price AS DOUBLE) AS price"


def single_fts_sql(terms: str, where: str = "true", limit: int = 50, view: str = "v_products", names: str = "v_suppliers"):
    return positions_sql(view) + rank_sql(terms) + f"""
best AS (SELECT h.rank, p.* FROM hit h JOIN {view} p USING (id) WHERE {where} ORDER BY h.rank DESC, p.id LIMIT {limit})
SELECT b.id, s.name AS supplier_name, {PRODUCT}, rank FROM best b JOIN {names} s ON s.id = b.supplier_id"""


RED_RING = one_query((0, "red", False), (0, "ring", False))
HOT_PLATE = one_query((0, "hot", False), (0, "plate", False), (1, "bolt", False))
LARGE_NO_ROD = one_query((0, "large", False), (0, "rod", True))

# ---------------------------------------------------------------- full text


@query("fts_index", positions_sql("v_docs") + """
n AS (SELECT lexeme, id, count(*) AS c FROM tok GROUP BY ALL)
SELECT lexeme, count(*) AS n_texts, CAST(sum(c) AS BIGINT) AS n_occurrences FROM n GROUP BY lexeme""")
def fts_index(v: Views) -> DataFrame:
    return lexeme_stats(v.docs())


@query("fts_postings", positions_sql("v_docs") + """
p AS (SELECT lexeme, id, count(*) AS n, sum(pos) AS s FROM spot GROUP BY ALL)
SELECT id, count(*) AS n_lexemes, CAST(sum(n) AS BIGINT) AS n_positions, CAST(sum(s) AS BIGINT) AS position_sum
FROM p GROUP BY id""")
def fts_postings(v: Views) -> DataFrame:
    n = F.size("positions").cast("long")
    total = F.aggregate("positions", F.lit(0).cast("long"), lambda a, x: a + x)
    return postings(v.docs()).groupBy("id").agg(
        F.count("*").alias("n_lexemes"), F.sum(n).alias("n_positions"), F.sum(total).alias("position_sum")
    )


@query("fts_search", single_fts_sql(RED_RING))
def fts_search(v: Views) -> DataFrame:
    return search_fts(v.products(), v.suppliers(), "red ring")


@query("fts_filtered", single_fts_sql(RED_RING, "price >= 905 AND price <= 960 AND supplier_id = 60"))
def fts_filtered(v: Views) -> DataFrame:
    return search_fts(v.products(), v.suppliers(), "red ring", supplier_filter=60, price_min=905, price_max=960)


@query("fts_or_search", single_fts_sql(HOT_PLATE))
def fts_or_search(v: Views) -> DataFrame:
    return search_fts(v.products(), v.suppliers(), "hot plate or bolt")


@query("fts_negation", single_fts_sql(LARGE_NO_ROD))
def fts_negation(v: Views) -> DataFrame:
    return search_fts(v.products(), v.suppliers(), "large -rod")


@query("fts_phrase", positions_sql("v_docs") + rank_sql(one_query((0, "of", False), (0, "the", False))) + """
phrase AS (SELECT DISTINCT a.id FROM tok a JOIN tok b ON a.id = b.id AND b.pos = a.pos + 1
  WHERE a.lexeme = 'of' AND b.lexeme = 'the'),
best AS (SELECT h.rank, d.* FROM hit h JOIN phrase USING (id) JOIN v_docs d USING (id) ORDER BY h.rank DESC, d.id LIMIT 50)
SELECT b.id, s.name AS supplier_name, supplier_code, selling_uom, rank
FROM best b JOIN v_doc_suppliers s ON s.id = b.supplier_id""")
def fts_phrase(v: Views) -> DataFrame:
    out = search_fts(v.docs(), v.doc_suppliers(), '"of the"', long_texts=True)
    return out.select("id", "supplier_name", "supplier_code", "selling_uom", "rank")


def stored_index(v: Views, rows: DataFrame) -> DataFrame:
    """The text index of some rows, written to the shared folder and read back."""
    path = f"{shared_folder(v.spark)}/text-index-{uuid.uuid4().hex}"
    write_text_index(rows, path)
    return v.spark.read.parquet(path)


@query("fts_indexed", positions_sql("v_docs") + rank_sql(one_query((0, "of", False), (0, "the", False))) + """
phrase AS (SELECT DISTINCT a.id FROM tok a JOIN tok b ON a.id = b.id AND b.pos = a.pos + 1
  WHERE a.lexeme = 'of' AND b.lexeme = 'the'),
best AS (SELECT h.rank, d.* FROM hit h JOIN phrase USING (id) JOIN v_docs d USING (id) ORDER BY h.rank DESC, d.id LIMIT 50)
SELECT b.id, s.name AS supplier_name, supplier_code, selling_uom, rank
FROM best b JOIN v_doc_suppliers s ON s.id = b.supplier_id""")
def fts_indexed(v: Views) -> DataFrame:
    out = search_fts_indexed(stored_index(v, v.docs()), v.docs(), v.doc_suppliers(), '"of the"')
    return out.select("id", "supplier_name", "supplier_code", "selling_uom", "rank")


@query("fts_indexed_or", single_fts_sql(HOT_PLATE, "price >= 905"))
def fts_indexed_or(v: Views) -> DataFrame:
    return search_fts_indexed(stored_index(v, v.products()), v.products(), v.suppliers(), "hot plate or bolt", price_min=905)


def name_queries(v: Views) -> DataFrame:
    """One query per distinct product name, with a price ceiling on red things."""
    names = v.table("part").select("p_name").distinct()
    return names.select(
        F.col("p_name").alias("query_id"),
        F.col("p_name").alias("search_text"),
        F.when(F.col("p_name").startswith("red"), 1000.0).alias("price_max"),
        F.when(F.col("p_name").startswith("hot"), 5).otherwise(20).alias("result_limit"),
    )


NAME_QUERIES = """
ask AS (SELECT DISTINCT p_name AS query_id, CASE WHEN p_name LIKE 'red%' THEN 1000.0 END AS price_max,
  CASE WHEN p_name LIKE 'hot%' THEN 5 ELSE 20 END AS result_limit FROM part),"""
NAME_TERMS = "SELECT query_id, 0 AS clause, unnest(string_split(query_id, ' ')) AS lexeme, false AS excluded FROM ask"


FTS_BATCH = NAME_QUERIES + positions_sql("v_products") + rank_sql(NAME_TERMS) + f"""
best AS (SELECT h.query_id, h.rank, p.*, row_number() OVER (PARTITION BY h.query_id ORDER BY h.rank DESC, p.id) AS rank_no,
    result_limit
  FROM hit h JOIN ask USING (query_id) JOIN v_products p USING (id) WHERE price_max IS NULL OR price <= price_max
  QUALIFY rank_no <= result_limit)
SELECT query_id, b.id, rank_no, s.name AS supplier_name, {PRODUCT}, rank FROM best b JOIN v_suppliers s ON s.id = b.supplier_id"""


@query("fts_batch", FTS_BATCH)
def fts_batch(v: Views) -> DataFrame:
    return search_fts_batch(v.products(), v.suppliers(), name_queries(v))


@query("fts_batch_indexed", FTS_BATCH)
def fts_batch_indexed(v: Views) -> DataFrame:
    return search_fts_indexed_batch(stored_index(v, v.products()), v.products(), v.suppliers(), name_queries(v))


DOC_QUERIES = [
    (1, "the of and"),
    (2, "der -und or les"),
    (3, "erst or heineren or zzz"),
    (4, "el que -the"),
]
DOC_TERMS = """SELECT * FROM (VALUES (1, 0, 'the', false), (1, 0, 'of', false), (1, 0, 'and', false), (2, 0, 'der', false),
  (2, 0, 'und', true), (2, 1, 'les', false), (3, 0, 'erst', false), (3, 1, 'heineren', false), (3, 2, 'zzz', false),
  (4, 0, 'el', false), (4, 0, 'que', false), (4, 0, 'the', true)) t(query_id, clause, lexeme, excluded)"""


DOCS_BATCH = positions_sql("v_docs") + rank_sql(DOC_TERMS) + """
best AS (SELECT query_id, id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, id) AS rank_no FROM hit
  QUALIFY rank_no <= 100)
SELECT query_id, b.id, rank_no, rank, d.supplier_code FROM best b JOIN v_docs d ON d.id = b.id"""


@query("fts_docs_batch", DOCS_BATCH)
def fts_docs_batch(v: Views) -> DataFrame:
    asks = v.spark.createDataFrame(DOC_QUERIES, "query_id int, search_text string")
    out = search_fts_batch(v.docs(), v.doc_suppliers(), asks, result_limit=100, long_texts=True)
    return out.select("query_id", "id", "rank_no", "rank", "supplier_code")


@query("fts_docs_batch_indexed", DOCS_BATCH)
def fts_docs_batch_indexed(v: Views) -> DataFrame:
    asks = v.spark.createDataFrame(DOC_QUERIES, "query_id int, search_text string")
    out = search_fts_indexed_batch(stored_index(v, v.docs()), v.docs(), v.doc_suppliers(), asks, result_limit=100)
    return out.select("query_id", "id", "rank_no", "rank", "supplier_code")


@query("fts_italian")
def fts_italian(v: Views) -> DataFrame:
    """Stemmed search; SQL has no stemmer for it, so tests check it on fixtures."""
    asks = v.spark.createDataFrame(DOC_QUERIES, "query_id int, search_text string")
    out = search_fts_batch(v.docs(), v.doc_suppliers(), asks, result_limit=100, config="italian", long_texts=True)
    return out.select("query_id", "id", "rank_no", "rank", "supplier_code")


# ---------------------------------------------------------------- fuzzy


def grams_sql(text: str) -> str:
    return (
        f"list_distinct(flatten([[substring('  ' || w || ' ', i, 3) FOR i IN range(1, length(w) + 2)] "
        f"FOR w IN {words(text)}]))"
    )


SIMILARITY = "len(list_intersect(p.g, q.g)) / (len(p.g) + len(q.g) - len(list_intersect(p.g, q.g)))"


FUZZY_SQL = f"""
p AS (SELECT *, {grams_sql('description')} AS g FROM v_products),
q AS (SELECT {grams_sql("'smal rnig econmy'")} AS g),
best AS (SELECT p.*, {SIMILARITY} AS similarity FROM p, q WHERE {SIMILARITY} > 0.2 ORDER BY similarity DESC, p.id LIMIT 50)
SELECT b.id, s.name AS supplier_name, {PRODUCT}, similarity FROM best b JOIN v_suppliers s ON s.id = b.supplier_id"""


@query("fuzzy_search", FUZZY_SQL)
def fuzzy_search(v: Views) -> DataFrame:
    return search_fuzzy(v.products(), v.suppliers(), "smal rnig econmy")


@query("fuzzy_indexed", FUZZY_SQL)
def fuzzy_indexed(v: Views) -> DataFrame:
    path = f"{shared_folder(v.spark)}/gram-index-{uuid.uuid4().hex}"
    write_gram_index(v.products(), path)
    return search_fuzzy_indexed(v.spark.read.parquet(path), v.products(), v.suppliers(), "smal rnig econmy")


FUZZY_BATCH = f"""
p AS (SELECT *, {grams_sql('description')} AS g FROM v_products),
q AS (SELECT p_name AS query_id, {grams_sql("replace(p_name, 'l', '')")} AS g FROM (SELECT DISTINCT p_name FROM part)),
best AS (SELECT q.query_id, p.*, {SIMILARITY} AS similarity,
    row_number() OVER (PARTITION BY q.query_id ORDER BY {SIMILARITY} DESC, p.id) AS rank_no
  FROM p, q WHERE {SIMILARITY} > 0.2 QUALIFY rank_no <= 10)
SELECT query_id, b.id, rank_no, s.name AS supplier_name, {PRODUCT}, similarity
FROM best b JOIN v_suppliers s ON s.id = b.supplier_id"""


def misspelt_names(v: Views) -> DataFrame:
    return v.table("part").select("p_name").distinct().select(
        F.col("p_name").alias("query_id"), F.replace("p_name", F.lit("l"), F.lit("")).alias("search_text")
    )


@query("fuzzy_batch", FUZZY_BATCH)
def fuzzy_batch(v: Views) -> DataFrame:
    return search_fuzzy_batch(
        v.products(), v.suppliers(), misspelt_names(v), result_limit=10, frequencies=trigram_frequencies(v.products())
    )


@query("fuzzy_batch_indexed", FUZZY_BATCH)
def fuzzy_batch_indexed(v: Views) -> DataFrame:
    path = f"{shared_folder(v.spark)}/gram-index-{uuid.uuid4().hex}"
    write_gram_index(v.products(), path)
    return search_fuzzy_indexed_batch(v.spark.read.parquet(path), v.products(), v.suppliers(), misspelt_names(v), result_limit=10)


# ---------------------------------------------------------------- vectors


def label_vectors(v: Views) -> DataFrame:
    """The mean vector of every label, over all embeddings."""
    parts = v.table("embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    lists = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("ms"))
    return lists.select(F.col("label").alias("query_id"), F.transform("ms", lambda s: s["m"]).alias("query_embedding"))


LABEL_VECTORS = """
part_of AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
mean_of AS (SELECT label, i, avg(x) AS m FROM part_of GROUP BY ALL),
ask AS (SELECT label AS query_id, list(m ORDER BY i) AS vec FROM mean_of GROUP BY label),"""
ALL_VECTOR = """
part_of AS (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
ask AS (SELECT 0 AS query_id, list(m ORDER BY i) AS vec FROM (SELECT i, avg(x) AS m FROM part_of GROUP BY i)),"""


def mean_vector(v: Views) -> list[float]:
    """The mean of all embeddings; one small row."""
    parts = v.table("embeddings").select(F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    row = means.agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("ms")).first()
    return [s["m"] for s in row["ms"]]


def near_sql(threshold: float, limit: int, where: str = "true", view: str = "v_products") -> str:
    return f"""
near AS (SELECT query_id, p.id, floor((list_cosine_similarity(p.embedding, vec)) * 1e10 + 0.5) / 1e10 AS sim,
    row_number() OVER (PARTITION BY query_id ORDER BY floor((list_cosine_similarity(p.embedding, vec)) * 1e10 + 0.5) / 1e10 DESC, p.id) AS rank_no
  FROM {view} p, ask WHERE p.embedding IS NOT NULL AND floor((list_cosine_similarity(p.embedding, vec)) * 1e10 + 0.5) / 1e10 > {threshold} AND {where}
  QUALIFY rank_no <= {limit})"""


@query("semantic_search", ALL_VECTOR + near_sql(0.1, 50) + f"""
SELECT n.id, s.name AS supplier_name, {PRODUCT}, sim AS similarity
FROM near n JOIN v_products p ON p.id = n.id JOIN v_suppliers s ON s.id = p.supplier_id""")
def semantic_search(v: Views) -> DataFrame:
    return search_semantic(v.products(True), v.suppliers(), mean_vector(v), similarity_threshold=0.1)


@query("semantic_filtered", ALL_VECTOR + near_sql(0.0, 30, "price >= 910 AND price <= 1000") + f"""
SELECT n.id, s.name AS supplier_name, {PRODUCT}, sim AS similarity
FROM near n JOIN v_products p ON p.id = n.id JOIN v_suppliers s ON s.id = p.supplier_id""")
def semantic_filtered(v: Views) -> DataFrame:
    return search_semantic(
        v.products(True), v.suppliers(), mean_vector(v), price_min=910, price_max=1000,
        similarity_threshold=0.0, result_limit=30,
    )


@query("semantic_batch", LABEL_VECTORS + near_sql(0.1, 20) + f"""
SELECT query_id, n.id, rank_no, s.name AS supplier_name, {PRODUCT}, sim AS similarity
FROM near n JOIN v_products p ON p.id = n.id JOIN v_suppliers s ON s.id = p.supplier_id""")
def semantic_batch(v: Views) -> DataFrame:
    return search_semantic_batch(v.products(True), v.suppliers(), label_vectors(v), 0.1, 20)


@query("semantic_batch_filtered", LABEL_VECTORS + near_sql(
    -1.0, 20, "(query_id >= 3 OR price <= 930) AND (query_id <= 6 OR supplier_id = query_id)") + """
SELECT query_id, id, rank_no, sim AS similarity FROM near""")
def semantic_batch_filtered(v: Views) -> DataFrame:
    """Low labels with a price ceiling, high ones with a supplier."""
    asks = label_vectors(v).withColumns({
        "price_max": F.when(F.col("query_id") < 3, 930.0),
        "supplier_filter": F.when(F.col("query_id") > 6, F.col("query_id").cast("long")),
    })
    out = search_semantic_batch(v.products(True), v.suppliers(), asks, -1.0, 20)
    return out.select("query_id", "id", "rank_no", "similarity")


@query("semantic_approximate")
def semantic_approximate(v: Views) -> DataFrame:
    return search_approximate(v.products(True), label_vectors(v), 0.1, 20)


EVERY_50TH = """
ask AS (SELECT id AS query_id, embedding AS vec FROM v_products WHERE embedding IS NOT NULL AND id % 50 = 0),"""


def stored_lists(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The inverted lists of all products, written to the shared folder and read back, and every 50th product as a query."""
    path = f"{shared_folder(v.spark)}/vector-index-{uuid.uuid4().hex}"
    write_vector_index(v.products(True), path)
    asks = v.products(True).where("embedding IS NOT NULL AND id % 50 = 0")
    return *read_vector_index(v.spark, path), asks.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))


@query("semantic_lists", EVERY_50TH + near_sql(0.1, 10) + """
SELECT (SELECT count(*) FROM ask) AS n_queries, count(*) AS n_exact, CAST(0 AS BIGINT) AS n_wrong, true AS recall_reached, true AS few_compared FROM near""")
def semantic_lists(v: Views) -> DataFrame:
    """The stored lists against the exact search: wrong similarities, recall at 10 of 0.9, under a tenth of the vectors compared in full."""
    rows, centres, asks = stored_lists(v)
    exact = search_semantic_batch(v.products(True), v.suppliers(), asks, 0.1, 10).select("query_id", "id", F.col("similarity").alias("true_similarity"))
    # each search is its own plan: together they are too much for a small driver
    exact, found = cut_lineage(exact), cut_lineage(search_lists(rows, centres, asks, 0.1, 10))
    facts = exact.join(found, ["query_id", "id"], "left").agg(
        F.count("*").alias("n_exact"),
        F.count(F.when(F.abs(F.col("similarity") - F.col("true_similarity")) > 2e-10, 1)).alias("n_wrong"),
        (F.count("similarity") >= 0.9 * F.count("*")).alias("recall_reached"),
    )
    full = bt.complete(asks, "bigint")
    compared = cut_lineage(candidates(rows, centres, full, 0.1, 10, bt.measure(full, 10)).agg(F.count("*").alias("compared")))
    sizes = asks.agg(F.count("*").alias("n_queries")).join(rows.agg(F.count("*").alias("n_rows"))).join(compared)  # one row each
    few = (F.col("compared") < 0.1 * F.col("n_queries") * F.col("n_rows")).alias("few_compared")
    return facts.join(sizes.select("n_queries", few)).select("n_queries", "n_exact", "n_wrong", "recall_reached", "few_compared")


@query("semantic_lists_all", EVERY_50TH + near_sql(0.1, 10, "price <= 950") + """
SELECT query_id, id, rank_no, sim AS similarity FROM near""")
def semantic_lists_all(v: Views) -> DataFrame:
    """All lists opened: byte codes with their bounds give the exact result, the price filter inside the scan."""
    rows, centres, asks = stored_lists(v)
    return search_lists(rows.where("price <= 950"), centres, asks, 0.1, 10, probes=1 << 20)


# ---------------------------------------------------------------- hybrid


def name_vectors(v: Views) -> DataFrame:
    """Per product name: the name as text and the mean vector of its products."""
    rows = v.products(True).where(F.col("embedding").isNotNull()).select("name", F.posexplode("embedding").alias("i", "x"))
    means = rows.groupBy("name", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    lists = means.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("ms"))
    return lists.select(
        F.col("name").alias("query_id"), F.col("name").alias("search_text"),
        F.transform("ms", lambda s: s["m"]).alias("query_embedding"),
    )


NAME_VECTORS = """
part_of AS (SELECT name, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM v_products WHERE embedding IS NOT NULL),
ask AS (SELECT name AS query_id, list(m ORDER BY i) AS vec FROM (SELECT name, i, avg(x) AS m FROM part_of GROUP BY ALL) GROUP BY name),"""


def fuse_sql(k: int, w1: float = 0.4, w2: float = 0.6, scaled: bool = True, where: str = "true", view: str = "v_products") -> str:
    norm = "CASE WHEN max(f) OVER w > 0 THEN f / max(f) OVER w ELSE 0 END" if scaled else "f"
    return f""",
text_top AS (SELECT h.query_id, h.id, h.rank, row_number() OVER (PARTITION BY h.query_id ORDER BY h.rank DESC, h.id) AS n
  FROM hit h JOIN {view} p USING (id) WHERE {where} QUALIFY n <= {k}),
both_top AS (SELECT coalesce(t.query_id, n.query_id) AS query_id, coalesce(t.id, n.id) AS id,
    coalesce(t.rank, 0) AS f, coalesce(n.sim, 0) AS s
  FROM text_top t FULL JOIN near n ON t.query_id = n.query_id AND t.id = n.id),
scaled AS (SELECT query_id, id, f, s, {norm} AS fn FROM both_top WINDOW w AS (PARTITION BY query_id)),
fused AS (SELECT query_id, id, f AS fts_rank, s AS semantic_similarity, {digits(f"fn * {w1}e0 + s * {w2}e0")} AS combined_score,
    row_number() OVER (PARTITION BY query_id ORDER BY {digits(f"fn * {w1}e0 + s * {w2}e0")} DESC, id) AS rank_no
  FROM scaled QUALIFY rank_no <= {k})"""


@query("hybrid_search", ALL_VECTOR + positions_sql("v_products") + rank_sql(RED_RING) + near_sql(0.1, 40, "price <= 1080")
       + fuse_sql(40, 0.7, 0.3, where="price <= 1080") + f"""
SELECT f.id, s.name AS supplier_name, {PRODUCT}, fts_rank, semantic_similarity, combined_score
FROM fused f JOIN v_products p ON p.id = f.id JOIN v_suppliers s ON s.id = p.supplier_id""")
def hybrid_search(v: Views) -> DataFrame:
    return search_hybrid(
        v.products(True), v.suppliers(), "red ring", mean_vector(v), price_max=1080, fts_weight=0.7,
        semantic_weight=0.3, result_limit=40, similarity_threshold=0.1,
    )


@query("hybrid_negation", ALL_VECTOR + positions_sql("v_products") + rank_sql(LARGE_NO_ROD) + near_sql(0.1, 40) + fuse_sql(40) + """
SELECT f.id, fts_rank, semantic_similarity, combined_score FROM fused f""")
def hybrid_negation(v: Views) -> DataFrame:
    """Every text hit has the rank of texts without a pair, 1e-20, and counts as the best one."""
    found = search_hybrid(v.products(True), v.suppliers(), "large -rod", mean_vector(v), result_limit=40, similarity_threshold=0.1)
    return found.select("id", "fts_rank", "semantic_similarity", "combined_score")


HYBRID_BATCH_SQL = NAME_VECTORS + positions_sql("v_products") + rank_sql(NAME_TERMS)


@query("hybrid_batch", HYBRID_BATCH_SQL + near_sql(0.1, 20) + fuse_sql(20) + f"""
SELECT query_id, f.id, rank_no, s.name AS supplier_name, {PRODUCT}, fts_rank, semantic_similarity, combined_score
FROM fused f JOIN v_products p ON p.id = f.id JOIN v_suppliers s ON s.id = p.supplier_id""")
def hybrid_batch(v: Views) -> DataFrame:
    return search_hybrid_batch(v.products(True), v.suppliers(), name_vectors(v), 20, 0.1)


@query("hybrid_unscaled", HYBRID_BATCH_SQL + near_sql(-2, 20) + fuse_sql(20, scaled=False) + """
SELECT query_id, id, rank_no, fts_rank, semantic_similarity, combined_score FROM fused""")
def hybrid_unscaled(v: Views) -> DataFrame:
    out = search_hybrid_batch(v.products(True), v.suppliers(), name_vectors(v), 20, variant="unscaled")
    return out.select("query_id", "id", "rank_no", "fts_rank", "semantic_similarity", "combined_score")


@query("hybrid_single_scan", NAME_VECTORS + positions_sql("v_products") + rank_sql(NAME_TERMS) + f"""
sims AS (SELECT query_id, p.id, coalesce(floor((list_cosine_similarity(p.embedding, vec)) * 1e10 + 0.5) / 1e10, 0) AS sim,
    p.embedding IS NOT NULL AND floor((list_cosine_similarity(p.embedding, vec)) * 1e10 + 0.5) / 1e10 > 0.5 AND price <= 1000 AS close
  FROM v_products p, ask),
chosen AS (SELECT s.query_id, s.id, coalesce(h.rank, 0) AS fts_rank, s.sim AS semantic_similarity
  FROM sims s LEFT JOIN hit h ON h.query_id = s.query_id AND h.id = s.id WHERE h.id IS NOT NULL OR s.close),
best AS (SELECT *, {digits("fts_rank * 0.4e0 + semantic_similarity * 0.6e0")} AS combined_score,
    row_number() OVER (PARTITION BY query_id ORDER BY {digits("fts_rank * 0.4e0 + semantic_similarity * 0.6e0")} DESC, id) AS rank_no
  FROM chosen QUALIFY rank_no <= 20)
SELECT query_id, id, rank_no, fts_rank, semantic_similarity, combined_score FROM best""")
def hybrid_single_scan(v: Views) -> DataFrame:
    asks = name_vectors(v).withColumn("price_max", F.lit(1000.0))
    out = search_hybrid_batch(v.products(True), v.suppliers(), asks, 20, variant="single_scan")
    return out.select("query_id", "id", "rank_no", "fts_rank", "semantic_similarity", "combined_score")


DOC_ASK = "\nask AS (SELECT query_id, vec FROM mean_vec, (VALUES (1), (2), (3), (4)) t(query_id)),"


@query("hybrid_docs", """
part_of AS (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
mean_vec AS (SELECT list(m ORDER BY i) AS vec FROM (SELECT i, avg(x) AS m FROM part_of GROUP BY i)),"""
       + DOC_ASK + positions_sql("v_docs") + rank_sql(DOC_TERMS) + near_sql(0.1, 30, view="v_docs") + fuse_sql(30, view="v_docs") + """
SELECT query_id, f.id, rank_no, s.name AS supplier_name, fts_rank, semantic_similarity, combined_score
FROM fused f JOIN v_docs d ON d.id = f.id JOIN v_doc_suppliers s ON s.id = d.supplier_id""")
def hybrid_docs(v: Views) -> DataFrame:
    vector = mean_vector(v)
    asks = v.spark.createDataFrame(
        [(q, t, vector) for q, t in DOC_QUERIES], "query_id int, search_text string, query_embedding array<double>"
    )
    out = search_hybrid_batch(v.docs(True), v.doc_suppliers(), asks, 30, 0.1, long_texts=True)
    return out.select("query_id", "id", "rank_no", "supplier_name", "fts_rank", "semantic_similarity", "combined_score")


def raw_requests(v: Views) -> DataFrame:
    """Search requests as they arrive: one per product name, all parameters as text."""
    return name_vectors(v).select(
        "query_id",
        F.col("search_text").alias("query"),
        "query_embedding",
        F.when(F.col("query_id").contains("ring"), "#00000000").alias("supplier"),
        F.lit("905").alias("price_min"),
        F.when(F.col("query_id").contains("rod"), "abc").alias("price_max"),
        F.when(F.col("query_id").contains("bolt"), "999").when(F.col("query_id").contains("gear"), "x").otherwise("10").alias("limit"),
        F.lit("0.5").alias("fts_weight"),
        F.when(F.col("query_id").contains("gizmo"), "7").otherwise("0.25").alias("semantic_weight"),
    )


@query("search_entry", NAME_VECTORS.replace("FROM part_of GROUP BY ALL) GROUP BY name),", "FROM part_of GROUP BY ALL) GROUP BY name HAVING name NOT LIKE '%rod%'),")
       + """
first_supplier AS (SELECT min_by(id, (name, id)) AS sid FROM v_suppliers WHERE contains(lower(name), '#00000000')),
par AS (SELECT query_id, CASE WHEN query_id LIKE '%ring%' THEN (SELECT sid FROM first_supplier) END AS sf,
    CASE WHEN query_id LIKE '%bolt%' THEN 100 WHEN query_id LIKE '%gear%' THEN 20 ELSE 10 END AS k,
    CASE WHEN query_id LIKE '%gizmo%' THEN 1e0 ELSE 0.25e0 END AS w2 FROM ask),"""
       + positions_sql("v_products") + rank_sql(NAME_TERMS) + f"""
near AS (SELECT query_id, p.id, floor((list_cosine_similarity(p.embedding, vec)) * 1e10 + 0.5) / 1e10 AS sim,
    row_number() OVER (PARTITION BY query_id ORDER BY floor((list_cosine_similarity(p.embedding, vec)) * 1e10 + 0.5) / 1e10 DESC, p.id) AS n
  FROM ask JOIN par USING (query_id), v_products p WHERE p.embedding IS NOT NULL AND price >= 905
    AND (sf IS NULL OR p.supplier_id = sf) AND floor((list_cosine_similarity(p.embedding, vec)) * 1e10 + 0.5) / 1e10 > 0.1 QUALIFY n <= k),
text_top AS (SELECT h.query_id, h.id, h.rank, row_number() OVER (PARTITION BY h.query_id ORDER BY h.rank DESC, h.id) AS n
  FROM hit h JOIN par USING (query_id) JOIN v_products p USING (id) WHERE price >= 905 AND (sf IS NULL OR p.supplier_id = sf)
  QUALIFY n <= k),
both_top AS (SELECT coalesce(t.query_id, n.query_id) AS query_id, coalesce(t.id, n.id) AS id, coalesce(t.rank, 0) AS f,
    coalesce(n.sim, 0) AS s FROM text_top t FULL JOIN near n ON t.query_id = n.query_id AND t.id = n.id),
scaled AS (SELECT query_id, id, s, CASE WHEN max(f) OVER w > 0 THEN f / max(f) OVER w ELSE 0 END AS fn FROM both_top
  WINDOW w AS (PARTITION BY query_id)),
fused AS (SELECT query_id, id, {digits("fn * 0.5e0 + s * w2")} AS combined_score, k,
    row_number() OVER (PARTITION BY query_id ORDER BY {digits("fn * 0.5e0 + s * w2")} DESC, id) AS rank_no
  FROM scaled JOIN par USING (query_id))
SELECT query_id, id, rank_no, combined_score FROM fused WHERE rank_no <= k""")
def search_entry(v: Views) -> DataFrame:
    found = search(raw_requests(v), v.products(True), v.suppliers(), similarity_threshold=0.1).results
    return found.select("query_id", "id", "rank_no", "combined_score")


@query("assistant_search", HYBRID_BATCH_SQL + near_sql(0.1, 20) + fuse_sql(20) + """
SELECT query_id, f.id, p.description, s.name AS supplier_name, supplier_code, CAST(price AS DOUBLE) AS price, selling_uom, combined_score
FROM fused f JOIN v_products p ON p.id = f.id JOIN v_suppliers s ON s.id = p.supplier_id""")
def assistant(v: Views) -> DataFrame:
    return assistant_search(name_vectors(v), v.products(True), v.suppliers(), similarity_threshold=0.1)


# ---------------------------------------------------------------- catalogue


def with_category(v: Views) -> DataFrame:
    ids = v.categories().select(F.col("slug").alias("category_slug"), F.col("id").alias("category_id"))
    # products of the smallest packs have no category yet
    known = classify(v.products(), RULES)
    found = known.join(ids, "category_slug").drop("category_slug")
    return found.withColumn("category_id", F.when(F.col("selling_uom") != "1X1,5 L", F.col("category_id")))


def catalog_sql(where: str, order: str, limit: int, offset: int) -> str:
    return f"""
p AS (SELECT v.*, CASE WHEN selling_uom <> '1X1,5 L' THEN c.id END AS category_id
  FROM v_classified v JOIN v_categories c ON c.slug = v.category_slug),
f AS (SELECT p.id, p.supplier_id, s.name AS supplier_name, supplier_code, p.description, selling_uom, price, p.category_id,
    c.name AS category_name, c.slug AS category_slug, list_contains({words('p.description')}, 'bolt') AS has_bolt
  FROM p JOIN v_suppliers s ON s.id = p.supplier_id LEFT JOIN v_categories c ON c.id = p.category_id WHERE {where})
SELECT id, supplier_id, supplier_name, supplier_code, description, selling_uom, CAST(price AS DOUBLE) AS price, category_id,
  category_name, category_slug, (SELECT count(*) FROM f) AS total_count
FROM f ORDER BY {order}, id LIMIT {limit} OFFSET {offset}"""


@query("catalog_page", catalog_sql("true", "f.description", 24, 48))
def catalog_page(v: Views) -> DataFrame:
    return search_catalog(with_category(v), v.suppliers(), v.categories(), page_offset=48)


@query("catalog_price_desc", catalog_sql("p.price >= 950 AND p.category_id = 2", "price DESC NULLS LAST", 30, 5))
def catalog_price_desc(v: Views) -> DataFrame:
    return search_catalog(
        with_category(v), v.suppliers(), v.categories(), category_filter=2, price_min=950, sort_by="price_desc",
        page_size=30, page_offset=5,
    )


@query("catalog_price_asc", catalog_sql("p.supplier_id = 3", "price ASC NULLS LAST", 100, 0))
def catalog_price_asc(v: Views) -> DataFrame:
    return search_catalog(
        with_category(v), v.suppliers(), v.categories(), supplier_filter=3, sort_by="price_asc", page_size=100
    )


@query("catalog_text", catalog_sql("list_contains(" + words("p.description") + ", 'bolt') OR p.description ILIKE '%bolt%'",
                                   "f.description", 40, 0))
def catalog_text(v: Views) -> DataFrame:
    return search_catalog(with_category(v), v.suppliers(), v.categories(), "bolt", page_size=40)


@query("catalog_wildcard", catalog_sql("p.description ILIKE '%r_d%brand#1_%'", "f.id", 60, 0))
def catalog_wildcard(v: Views) -> DataFrame:
    return search_catalog(
        with_category(v), v.suppliers(), v.categories(), "r_d%brand#1_", sort_by="newest", page_size=60
    )


# ---------------------------------------------------------------- encoding

FIELDS = ["id", "supplier_name", "description", "missing"]
ENCODED = NAME_QUERIES + positions_sql("v_products") + rank_sql(NAME_TERMS) + """
best AS (SELECT h.query_id, p.id, s.name AS supplier_name, p.description,
    row_number() OVER (PARTITION BY h.query_id ORDER BY h.rank DESC, p.id) AS rank_no, result_limit
  FROM hit h JOIN ask USING (query_id) JOIN v_products p USING (id) JOIN v_suppliers s ON s.id = p.supplier_id
  WHERE p.price <= 905 QUALIFY rank_no <= result_limit),
n AS (SELECT a.query_id, count(b.id) AS c FROM ask a LEFT JOIN best b USING (query_id) GROUP BY a.query_id),
lines AS (
  SELECT query_id, 0 AS seq, '{"type":"metadata","query":"' || query_id || '","count":' || c || '}' AS line FROM n
  UNION ALL SELECT query_id, rank_no, '{"type":"result","data":{"id":' || id || ',"supplier_name":"' || supplier_name ||
    '","description":"' || description || '","missing":null}}' FROM best
  UNION ALL SELECT query_id, c + 1, '{"type":"done","count":' || c || '}' FROM n)"""


def cheap_hits(v: Views) -> tuple[DataFrame, DataFrame]:
    asks = name_queries(v).withColumn("price_max", F.lit(905.0))
    found = search_fts_batch(v.products(), v.suppliers(), asks)
    return asks, found.withColumn("missing", F.lit(None).cast("string"))


@query("result_ndjson", ENCODED + " SELECT query_id, seq, line FROM lines")
def result_ndjson(v: Views) -> DataFrame:
    return result_lines(*cheap_hits(v), FIELDS)


@query("result_envelope", ENCODED + """
SELECT n.query_id, '{"query":"' || n.query_id || '","count":' || c || ',"results":[' || coalesce(
  (SELECT string_agg('{"id":' || b.id || ',"supplier_name":"' || b.supplier_name || '","description":"' || b.description ||
    '","missing":null}', ',' ORDER BY rank_no) FROM best b WHERE b.query_id = n.query_id), '') || ']}' AS document FROM n""")
def result_envelope(v: Views) -> DataFrame:
    return result_documents(*cheap_hits(v), FIELDS)
