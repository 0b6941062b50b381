"""The registered queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larder.llm import decontaminate, embeddings, html, langid, licences, merkle, neardup, packing, pii, pii_sql, quality, repair, secrets, stock

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _query(name: str, oracle: str | None = None):
    def add(build):
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return add


@_query("op3_decontaminate")
def op3_decontaminate(spark, folder):
    """Every leak: the document, the item, its words, the similarity and the first word of the best window.

    Items of the same words leak together and are listed under their smallest id. Each other id of such a class has one row
    besides, without a document, whose same_as is that smallest id; same_as is null in the rows of leaks."""
    benchmark = _table(spark, folder, "benchmark")
    found = decontaminate.find_leaks(_table(spark, folder, "documents"), benchmark)
    leaks = found.selectExpr("id AS doc_id", "item AS item_id", "n_words", "similarity", "start_word", "CAST(NULL AS long) AS same_as")
    others = decontaminate.item_classes(benchmark).where("item <> class").selectExpr("item AS item_id", "class AS same_as")
    return leaks.unionByName(others, allowMissingColumns=True)


@_query("op4_licences", licences.oracle())
def op4_licences(spark, folder):
    return licences.summary(licences.scan_licences(_table(spark, folder, "documents")))


@_query("op6_near_duplicates")
def op6_near_duplicates(spark, folder):
    return neardup.near_duplicates(_table(spark, folder, "documents"))


@_query("op9_personal_data", pii_sql.oracle())
def op9_personal_data(spark, folder):
    return pii.digest(pii.find_personal(_table(spark, folder, "documents")))


@_query("op10_embedding_duplicates", embeddings.oracle())
def op10_embedding_duplicates(spark, folder):
    return embeddings.near_vectors(_table(spark, folder, "embeddings"))


@_query("op1_main_text")
def op1_main_text(spark, folder):
    return html.extract(_table(spark, folder, "pages"))


@_query("op2_language")
def op2_language(spark, folder):
    return langid.identify(_table(spark, folder, "documents"))


@_query("op7_quality")
def op7_quality(spark, folder):
    return quality.score(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@_query("op5_packing")
def op5_packing(spark, folder):
    return packing.pack_apart(_table(spark, folder, "documents"))


@_query("op8_secrets")
def op8_secrets(spark, folder):
    found = secrets.scan(_table(spark, folder, "documents"))
    return found.selectExpr("id AS doc_id", "start", "`end`", "kind", "sha2(value, 256) AS value_sha256", "score")


@_query("op12_merkle", merkle.oracle())
def op12_merkle(spark, folder):
    return merkle.manifest(_table(spark, folder, "documents"))


@_query("op13_token_packing")
def op13_token_packing(spark, folder):
    import public_tokenizers

    return stock.pack_tokens(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query("op11_conversation_repair")
def op11_conversation_repair(spark, folder):
    return repair.repair(_table(spark, folder, "conversations"))
