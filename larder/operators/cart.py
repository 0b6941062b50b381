"""Cart actions hidden in replies, cart state from an action log, cart and profile lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marker around hidden cart actions and the fields of an action.
ACTION_BLOCK = r"<!--CART_ACTION(\[.*?\])-->"
ACTION = (
    "array<struct<action: string, id: string, description: string, supplier_name: string, "
    "price: decimal(10,2), selling_uom: string, qty: int>>"
)


def cart_actions(messages: DataFrame, text: str = "content", keys: list[str] = ("id",)) -> DataFrame:
    """One row per cart action in the texts, numbered by block and place."""
    blocks = F.regexp_extract_all(F.col(text), F.lit("(?s)" + ACTION_BLOCK), F.lit(1))
    opened = messages.select(
        *[F.col(k).alias("message_id" if k == "id" else k) for k in keys], F.posexplode(blocks).alias("block_no", "block")
    )
    return opened.select("*", F.posexplode(F.from_json("block", ACTION)).alias("action_no", "a")).select(
        *[c for c in opened.columns if c != "block"], "action_no", "a.*"
    )


def _latest(log: DataFrame, keys: list[str], condition: Column, name: str, pick=F.max) -> DataFrame:
    return log.where(condition).groupBy(*keys).agg(pick("seq").alias(name))


def _after(log: DataFrame, marks: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows later than their key's mark; keys without one keep all rows."""
    joined = log.join(marks, keys, "left")
    return joined.where(F.col(name).isNull() | (F.col("seq") > F.col(name))).drop(name)


def cart_state(log: DataFrame) -> DataFrame:
    """(cart_id, item_id, qty) after replaying an ordered log of cart_id, seq, action, item_id, qty.

    clear empties the cart, remove drops an item, update_qty sets the quantity of a present item, add
    inserts it or, where present, adds to its quantity (that last case is our choice).

    No key is replayed row by row: each cut-off is a max or min per key, computed with partial
    aggregates, and the joins back are left to AQE to split, so one busy cart is not one task.
    """
    item = ["cart_id", "item_id"]
    action = F.col("action")
    cleared = _latest(log, ["cart_id"], action == "clear", "cut")
    alive = _after(log.where(action != "clear"), cleared, ["cart_id"], "cut")
    alive = _after(alive, _latest(alive, item, action == "remove", "cut"), item, "cut")
    added = alive.where(action == "add").groupBy(*item).agg(F.min("seq").alias("first_add"))
    live = alive.join(added, item).where(F.col("seq") >= F.col("first_add"))
    last_set = live.where(action == "update_qty").groupBy(*item).agg(F.max(F.struct("seq", "qty")).alias("last_set"))
    counted = live.join(last_set, item, "left")
    later_add = (action == "add") & (F.col("last_set").isNull() | (F.col("seq") > F.col("last_set.seq")))
    return (
        counted.groupBy(*item)
        .agg(
            F.max("last_set.qty").alias("base"),
            F.sum(F.when(later_add, F.col("qty")).otherwise(0)).alias("extra"),
        )
        .select(*item, (F.coalesce("base", F.lit(0)) + F.col("extra")).cast("long").alias("qty"))
    )


def read_carts(requests: DataFrame, cart_sessions: DataFrame) -> DataFrame:
    """The items of each requested (customer_id, session_id) cart; a missing or NULL cart is empty."""
    found = requests.join(cart_sessions, ["customer_id", "session_id"], "left")
    return found.withColumn("items", F.coalesce("items", F.array()))


def read_customers(requests: DataFrame, customers: DataFrame) -> DataFrame:
    """The profile of each requested ``customer_id``; a missing one gets an ``error``."""
    known = customers.withColumn("_known", F.lit(True)).withColumnRenamed("id", "customer_id")
    error = F.when(F.col("_known").isNull(), "customer_not_found")
    return requests.join(known, "customer_id", "left").withColumn("error", error).drop("_known")


# Pack texts such as "6X1,5 L" or "12 x 75 CL".
PACK = r"(?i)^\s*(\d+)\s*x\s*\d"


def pack_count(uom: Column) -> Column:
    """Pieces in a pack text, 1 when it names none."""
    return F.coalesce(F.nullif(F.regexp_extract(uom, PACK, 1), F.lit("")).try_cast("int"), F.lit(1))


def decimal_comma(text: Column) -> Column:
    """A number written with a decimal comma and optional thousands points."""
    return F.replace(F.replace(F.trim(text), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def unit_price(price: Column, uom: Column) -> Column:
    """Price of one piece of a pack, to the cent; NULL for a pack of zero."""
    n = pack_count(uom)
    return F.when(n > 0, F.round(price.cast("decimal(10,2)") / n, 2).cast("decimal(10,2)"))
