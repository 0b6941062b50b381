"""Dimension rows a new catalogue starts with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larder import schemas

# The sixteen categories (name, slug, icon), in display order.
CATEGORIES = [
    ("Vini e Spumanti", "vini-spumanti", "Wine"),
    ("Birre", "birre", "Beer"),
    ("Liquori e Distillati", "liquori-distillati", "GlassWater"),
    ("Bevande Analcoliche", "bevande-analcoliche", "CupSoda"),
    ("Caffe e Te", "caffe-te", "Coffee"),
    ("Carne e Salumi", "carne-salumi", "Beef"),
    ("Pesce e Frutti di Mare", "pesce-frutti-mare", "Fish"),
    ("Latticini e Formaggi", "latticini-formaggi", "Milk"),
    ("Uova", "uova", "Egg"),
    ("Pasta, Riso e Cereali", "pasta-riso-cereali", "Wheat"),
    ("Pane e Prodotti da Forno", "pane-prodotti-forno", "Croissant"),
    ("Frutta e Verdura", "frutta-verdura", "Apple"),
    ("Dolci e Pasticceria", "dolci-pasticceria", "Cake"),
    ("Condimenti e Conserve", "condimenti-conserve", "Flame"),
    ("Pulizia e Monouso", "pulizia-monouso", "SprayCan"),
    ("Altro", "altro", "Package"),
]

# What chat messages and tool calls may carry.
CHAT_ROLES = ("user", "assistant", "tool")
TOOLS = ("search_products", "read_cart", "get_customer", "send_email")


def seed_categories(spark: SparkSession) -> DataFrame:
    """The category table; ids follow the display order."""
    rows = [(str(i), name, slug, icon, i) for i, (name, slug, icon) in enumerate(CATEGORIES, start=1)]
    return spark.createDataFrame(rows, schemas.CATEGORIES)


def seed_suppliers(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Supplier rows (id, name, account_number, depot, telesales) given by the caller."""
    return spark.createDataFrame(rows, schemas.SUPPLIERS)
