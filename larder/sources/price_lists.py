"""Price-list files in, catalogue products out."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder import schemas
from larder.functions.text import number, strip

# The layout of a supplier's sheet and its default currency.
SHEET_SKIP_ROWS = 7
SHEET_COLUMNS = 5
CURRENCY = "EUR"
BATCH_SIZE = 500


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Product records from JSON: files holding one array each, or JSON Lines (which also split)."""
    reader = spark.read.schema(schemas.IMPORT_JSON)
    return (reader if lines else reader.option("multiLine", True)).json(path)


def _sheet_rows(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [f"c{i}" for i in range(SHEET_COLUMNS)]
    for batch in files:
        for sheet, content in zip(batch["sheet"], batch["content"]):
            try:
                cells = pd.read_csv(
                    io.BytesIO(content), header=None, skiprows=SHEET_SKIP_ROWS, dtype=str, skip_blank_lines=False
                )
            except pd.errors.EmptyDataError:
                continue
            rows = cells.reindex(columns=range(SHEET_COLUMNS)).set_axis(names, axis=1)
            rows = rows.astype(object).where(rows.notna(), None)
            rows.insert(0, "line_no", range(SHEET_SKIP_ROWS + 1, SHEET_SKIP_ROWS + 1 + len(rows)))
            rows.insert(0, "sheet", sheet)
            yield rows


def read_sheets(spark: SparkSession, folder: str) -> DataFrame:
    """Raw cells of exported sheets laid out as ``folder/<sheet name>/*.csv``, everything as text.

    Each file is parsed by one task; files of one price list are small and there are many of them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    parent = F.element_at(F.split("path", "/"), -2)
    named = files.load(folder).select(F.url_decode(F.replace(parent, F.lit("+"), F.lit("%2B"))).alias("sheet"), "content")
    return named.mapInPandas(_sheet_rows, schemas.RAW_ROWS)


def unknown_sheets(raw: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Known suppliers without a sheet (``missing``) and sheets without a supplier (``unknown``)."""
    sheets = raw.select("sheet").distinct()
    names = suppliers.select(F.col("name").alias("sheet"))
    missing = names.join(sheets, "sheet", "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(sheets.join(names, "sheet", "left_anti").withColumn("problem", F.lit("unknown")))


def clean_rows(raw: DataFrame, suppliers: DataFrame, price_list_id) -> DataFrame:
    """Trim, drop rows without code or description, read the price, stamp list and supplier.

    A price that is no number stays NULL and the row is kept. Sheets of unknown suppliers drop out.
    """

    def text(name):
        return F.nullif(strip(name), F.lit(""))

    names = suppliers.select(F.col("name").alias("sheet"), F.col("id").alias("supplier_id"))
    typed = raw.select(
        "sheet",
        "line_no",
        text("c0").alias("supplier_code"),
        text("c1").alias("description"),
        text("c2").alias("selling_uom"),
        text("c3").alias("pricing_uom"),
        number("c4").try_cast("decimal(10,2)").alias("price"),
    )
    kept = typed.where(F.col("supplier_code").isNotNull() & F.col("description").isNotNull())
    return kept.join(names, "sheet").select(
        F.lit(price_list_id).alias("price_list_id"),
        "supplier_id",
        "supplier_code",
        "description",
        "selling_uom",
        "pricing_uom",
        "price",
        F.lit(CURRENCY).alias("currency"),
        "line_no",
    )


def import_summary(products: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Products per supplier, most first; an unknown supplier shows its id."""
    names = suppliers.select(F.col("id").alias("supplier_id"), "name")
    counts = products.groupBy("supplier_id").agg(F.count("*").alias("n_products"))
    return (
        counts.join(names, "supplier_id", "left")
        .select(F.coalesce("name", F.col("supplier_id").cast("string")).alias("supplier"), "n_products")
        .orderBy(F.desc("n_products"), F.asc("supplier"))
    )


def register_price_list(spark, list_id, hotel_name, price_valid_date, import_date, source_file=None, notes=None):
    """One metadata row, ready to append to ``price_lists``."""
    row = [(list_id, hotel_name, price_valid_date, import_date, source_file, notes)]
    return spark.createDataFrame(row, schemas.PRICE_LISTS)


def write_products(products: DataFrame, path: str) -> None:
    """Append products, one folder per price list, so reading one list prunes the others."""
    products.write.mode("append").partitionBy("price_list_id").parquet(path)
