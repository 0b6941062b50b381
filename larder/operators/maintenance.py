"""Embedding backfill, cascading erasure, integrity checks, customer profiles and timestamps."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(dim: int = 64) -> Embedder:
    """Deterministic stand-in for a remote model: signed word hashes as a unit vector.

    Words of opposite sign can meet in one place and cancel. A text that is left without any component
    counts as one word; the zero vector stands for an empty or blank text only.
    """

    def add(row: np.ndarray, word: str) -> None:
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        row[h % dim] += 1.0 if (h >> 32) & 1 else -1.0

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for row, text in zip(out, texts):
            for word in text.lower().split():
                add(row, word)
            if text.strip(" ") and not row.any():
                add(row, text.lower())
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1.0)

    return embed


def embed_missing(products: DataFrame, embedder: Embedder, batch: int = 100) -> DataFrame:
    """Fill NULL embeddings; adds ``embed_error`` where the embedder failed (the vector stays NULL).

    Only (id, description) of the missing rows go to Python, in small calls; these rows alone are joined
    with their vectors, rows that have one pass by without a shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for start in range(0, len(rows), batch):
                part = rows.iloc[start : start + batch]
                try:
                    vectors, error = list(embedder(part["description"].tolist())), None
                except Exception as e:  # a failing call is reported per row, the job goes on
                    vectors, error = [None] * len(part), str(e)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "_new": vectors, "embed_error": error})

    id_type = products.schema["id"].dataType.simpleString()
    todo = products.where(F.col("embedding").isNull()).select("id", F.coalesce("description", F.lit("")).alias("description"))
    made = todo.mapInPandas(run, f"id {id_type}, _new array<float>, embed_error string")
    filled = products.where(F.col("embedding").isNull()).join(made, "id", "left").withColumn("embedding", F.col("_new")).drop("_new")
    done = products.where(F.col("embedding").isNotNull()).withColumn("embed_error", F.lit(None).cast("string"))
    return done.unionByName(filled)


def embed_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """processed, remaining and errors of a backfill."""
    was = before.where(F.col("embedding").isNull()).select("id")
    left = F.col("embedding").isNull().cast("long")
    return after.join(was, "id", "left_semi").agg(
        F.coalesce(F.sum(1 - left), F.lit(0)).alias("processed"),
        F.coalesce(F.sum(left), F.lit(0)).alias("remaining"),
        F.count("embed_error").alias("errors"),
    )


def text_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def invalidate_changed(products: DataFrame) -> DataFrame:
    """Drop the embedding where the description no longer matches ``embedded_hash``."""
    now = text_hash(F.col("description"))
    keep = F.col("embedded_hash").eqNullSafe(now)
    return products.withColumns({"embedding": F.when(keep, F.col("embedding")), "embedded_hash": now})


# Which table's rows disappear with which parent row.
CASCADES = [
    ("price_lists", "products", "price_list_id"),
    ("suppliers", "products", "supplier_id"),
    ("users", "customers", "auth_user_id"),
    ("customers", "chat_messages", "customer_id"),
]


def erase(tables: dict[str, DataFrame], table: str, ids: DataFrame) -> dict[str, DataFrame]:
    """Delete rows by id and everything that hangs on them; returns the surviving tables.

    ``ids`` has one column ``id``. Children are found by semi join and removed by anti join.
    """
    out = dict(tables)
    gone = {table: ids.select("id").distinct()}
    if table in out:
        out[table] = out[table].join(gone[table], "id", "left_anti")
    for parent, child, fk in CASCADES:
        if parent in gone and child in out:
            lost = gone[parent].select(F.col("id").alias(fk))
            dropped = out[child].join(lost, fk, "left_semi").select("id")
            gone[child] = gone[child].unionByName(dropped) if child in gone else dropped
            out[child] = out[child].join(lost, fk, "left_anti")
    return out


def erased_counts(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """Rows before and after per table."""
    parts = None
    for name in sorted(before):
        b = before[name].agg(F.count("*").alias("n_before"))
        row = b.select(F.lit(name).alias("table"), "n_before").withColumn(
            "n_after", after[name].agg(F.count("*")).scalar()
        )
        parts = row if parts is None else parts.unionByName(row)
    return parts


def violations(
    tables: dict[str, DataFrame],
    not_null: list[tuple[str, str, str]] = (),
    unique: list[tuple[str, list[str]]] = (),
    references: list[tuple[str, str, str, str]] = (),
    allowed: list[tuple[str, str, str, list]] = (),
) -> DataFrame:
    """(table, rule, key) of every broken constraint.

    not_null: (table, key column, column); unique: (table, columns); references: (table, key column,
    column, parent table with ``id``); allowed: (table, key column, column, values).
    """
    found = []

    def report(rows, table, rule, key):
        found.append(rows.select(F.lit(table).alias("table"), F.lit(rule).alias("rule"), key.cast("string").alias("key")))

    for table, key, column in not_null:
        report(tables[table].where(F.col(column).isNull()), table, f"not_null:{column}", F.col(key))
    for table, columns in unique:
        complete = tables[table].dropna(subset=columns)
        repeated = complete.groupBy(*columns).agg(F.count("*").alias("n")).where(F.col("n") > 1)
        report(repeated, table, f"unique:{','.join(columns)}", F.concat_ws(",", *columns))
    for table, key, column, parent in references:
        parents = tables[parent].select(F.col("id").alias(column))
        orphans = tables[table].where(F.col(column).isNotNull()).join(parents, column, "left_anti")
        report(orphans, table, f"references:{column}->{parent}", F.col(key))
    for table, key, column, values in allowed:
        report(tables[table].where(~F.col(column).isin(values)), table, f"allowed:{column}", F.col(key))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


# Profile fields a signup may carry.
PROFILE_FIELDS = ["company_name", "vat_number", "hotel_name", "hotel_address", "contact_person", "contact_role", "phone"]


def customers_from_signups(signups: DataFrame, fields: list[str] = PROFILE_FIELDS) -> DataFrame:
    """One customer per user from the first signup; missing profile fields become ''."""
    first = signups.groupBy("user_id").agg(F.min(F.struct("ts", "raw_user_meta_data")).alias("s"))
    meta = F.col("s.raw_user_meta_data")
    return first.select(
        F.col("user_id").alias("auth_user_id"),
        *[F.coalesce(F.get_json_object(meta, f"$.{f}"), F.lit("")).alias(f) for f in fields],
        F.col("s.ts").alias("created_at"),
        F.col("s.ts").alias("updated_at"),
    )


def touch(old: DataFrame, updates: DataFrame, key: str, columns: list[str], now: Column, only_changed: bool = False):
    """Apply updates by key and stamp ``updated_at``; every listed row counts as updated by default."""
    new = updates.select(key, *[F.col(c).alias(f"_n_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = old.join(new, key, "left")
    hit = F.coalesce("_hit", F.lit(False))
    if only_changed:
        differs = F.lit(False)
        for c in columns:
            differs = differs | ~F.col(c).eqNullSafe(F.col(f"_n_{c}"))
        hit = hit & differs
    changed = {c: F.when(hit, F.col(f"_n_{c}")).otherwise(F.col(c)) for c in columns}
    changed["updated_at"] = F.when(hit, now).otherwise(F.col("updated_at"))
    return joined.withColumns(changed).drop("_hit", *[f"_n_{c}" for c in columns])
