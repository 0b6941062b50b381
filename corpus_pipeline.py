"""The corpus pipeline: language, near-duplicates, benchmark leaks, secrets, packing, each a stage over the rows that the one before kept."""

from __future__ import annotations

from larder.llm import decontaminate, langid, neardup, packing, secrets
from larder.llm.common import durable


def identified(spark, docs, sf_dir):
    """Texts whose language is known."""
    return langid.keep_identified(docs)


def deduplicated(spark, docs, sf_dir):
    """One text of every group of near copies."""
    return neardup.keep_one(docs)


def decontaminated(spark, docs, sf_dir):
    """Texts without a passage of the benchmark."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def cleared(spark, docs, sf_dir):
    """All texts, their secrets blanked."""
    return secrets.redact(docs)


def packed(spark, docs, sf_dir):
    """Pieces of texts and the sequences they go into."""
    return packing.pack_documents(docs)


STAGES = [("language", identified), ("near_duplicates", deduplicated), ("decontamination", decontaminated), ("secrets", cleared), ("packing", packed)]

#: The stages need trained models, XXH64 and a best-fit search, which the SQL dialect lacks.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = durable(docs)
    return docs
