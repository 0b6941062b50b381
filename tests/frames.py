"""Small literal tables shared by the tests."""

from decimal import Decimal

SUPPLIERS = [("s1", "NORD SPA"), ("s2", "ALPI SPA"), ("s3", "50% OFF_SHOP")]

# id, supplier, code, description, selling_uom, pricing_uom, price, category, embedding
PRODUCTS = [
    ("p1", "s1", "A1", "PROSECCO DOC EXTRA DRY", "750 ml", "PZ", Decimal("4.30"), "1", [1.0, 0.0, 0.0, 0.0]),
    ("p2", "s2", "A2", "Prosecco superiore", "750 ml", "PZ", Decimal("8.00"), "1", [1.0, 1.0, 1.0, 1.0]),
    ("p3", "s1", "A3", "SALE FINO IODATO", "1 KG", "KG", None, None, None),
    ("p4", "s2", "A4", "CAFFÈ ARABICA", "6X1,5 L", "KG", Decimal("11.98"), "5", [0.0, 0.0, 0.0, 0.0]),
    ("p5", "s1", "A5", "doc extra prosecco", "750 ml", "PZ", Decimal("5.00"), "1", [-1.0, 0.0, 0.0, 0.0]),
    ("p6", "s3", "A6", "Detersivo piatti 100% verde", None, None, Decimal("2.50"), None, [0.0, 2.0, 0.0, 0.0]),
]


def suppliers(spark):
    return spark.createDataFrame(SUPPLIERS, "id string, name string")


def products(spark):
    return spark.createDataFrame(
        PRODUCTS,
        "id string, supplier_id string, supplier_code string, description string, selling_uom string, "
        "pricing_uom string, price decimal(10,2), category_id string, embedding array<float>",
    )


def texts(spark, rows):
    return spark.createDataFrame(
        [(i, "s1", i, t, None, None, None) for i, t in rows],
        "id string, supplier_id string, supplier_code string, description string, selling_uom string, "
        "pricing_uom string, price decimal(10,2)",
    )


def ids(df):
    return [r["id"] for r in df.collect()]
