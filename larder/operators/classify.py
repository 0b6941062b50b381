"""Ordered-rule classification: the first matching pattern gives the category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FALLBACK = "altro"


def category_column(rules: list[tuple[int, str, str]], text: Column | str = "description", fallback: str = FALLBACK):
    """The slug of the first rule (priority, slug, pattern) found in the text, ignoring case.

    Patterns match anywhere in the text, not whole words. One CASE chain: no join, no shuffle, and
    later rules are not tried once one matched. ``u`` makes accented letters fold too.
    """
    text = F.col(text) if isinstance(text, str) else text
    chain = F
    for _, slug, pattern in sorted(rules):
        chain = chain.when(text.rlike(f"(?iu)(?:{pattern})"), slug)
    return chain.otherwise(fallback) if rules else F.lit(fallback)


def classify(products: DataFrame, rules: list[tuple[int, str, str]], text: str = "description") -> DataFrame:
    """Give every product a ``category_slug``."""
    return products.withColumn("category_slug", category_column(rules, text))


def fill_categories(
    products: DataFrame, categories: DataFrame, rules: list[tuple[int, str, str]], first_overrides: bool = True
) -> DataFrame:
    """Set ``category_id`` on a table that may already carry some.

    Rules fill only missing categories, except the first one, which overrides earlier labels
    (``first_overrides=False`` turns that off).
    """
    ids = categories.select(F.col("slug").alias("category_slug"), F.col("id").alias("_new_id"))
    found = classify(products, rules).join(ids, "category_slug", "left")
    first = min(rules)[1] if rules else None
    fresh = F.col("category_id").isNull()
    if first_overrides and first is not None:
        # a later rule may share the slug, so ask the first pattern itself
        fresh = fresh | F.col("description").rlike(f"(?iu)(?:{min(rules)[2]})")
    new = F.when(fresh, F.col("_new_id")).otherwise(F.col("category_id"))
    return found.withColumn("category_id", new).drop("_new_id", "category_slug")


def read_rules(spark, path: str) -> list[tuple[int, str, str]]:
    """Load a rule table (CSV with priority, slug, pattern); a rule set is a few dozen rows."""
    from larder.schemas import RULES

    rows = spark.read.schema(RULES).option("header", True).option("escape", '"').csv(path).limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1000 rules; merge patterns of the same category first")
    return [(r["priority"], r["slug"], r["pattern"]) for r in rows]


def category_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("category_slug").agg(F.count("*").alias("n_products"))


def coverage(classified: DataFrame, fallback: str = FALLBACK) -> DataFrame:
    """Share of products that got a real category."""
    known = F.when(F.col("category_slug") != fallback, 1.0).otherwise(0.0)
    return classified.agg(F.count("*").alias("n_products"), F.round(F.avg(known), 6).alias("coverage"))
