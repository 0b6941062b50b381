"""Row visibility and write checks by principal.

A principal is an (auth_user_id, role) row. Visible rows are the OR of all rules of a table: rows
everyone may read, own rows, and all rows for role 'admin'. A NULL role is not admin.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ADMIN = "admin"
#: Helper columns beside a table's own, which may have a role or an owner too.
_OWNER, _STORED, _ROLE = "_owner", "_stored_owner", "_writer_role"


@dataclass(frozen=True)
class Policy:
    """``owner`` tells how a row reaches its user; the flags tell what owners may do."""

    owner: str
    read_all: bool = False
    own_insert: bool = False
    own_update: bool = False
    own_delete: bool = False


# The rules per table.
CATALOGUE = Policy("nobody", read_all=True)
POLICIES = {
    "price_lists": CATALOGUE,
    "suppliers": CATALOGUE,
    "products": CATALOGUE,
    "categories": CATALOGUE,
    "customers": Policy("auth_user_id", own_insert=True, own_update=True),
    "orders": Policy("customer", own_insert=True),
    "order_items": Policy("order", own_insert=True),
    "cart_sessions": Policy("customer", own_insert=True, own_update=True, own_delete=True),
    "chat_messages": Policy("customer", own_insert=True),
}


def _owners(policy: Policy, tables: dict[str, DataFrame]) -> tuple[str, DataFrame] | None:
    """(foreign key, owner table keyed by it) for a policy; None when the row names its user itself."""
    if policy.owner == "auth_user_id":
        return None
    users = tables["customers"].select(F.col("id").alias("customer_id"), F.col("auth_user_id").alias(_OWNER))
    if policy.owner == "customer":
        return "customer_id", users
    orders = tables["orders"].select(F.col("id").alias("order_id"), "customer_id")
    return "order_id", orders.join(users, "customer_id").drop("customer_id")


def with_owner(rows: DataFrame, policy: Policy, tables: dict[str, DataFrame]) -> DataFrame:
    """Rows plus ``_owner``, the user they belong to (NULL when nobody)."""
    if policy.owner == "nobody":
        return rows.withColumn(_OWNER, F.lit(None).cast("string"))
    link = _owners(policy, tables)
    if link is None:
        return rows.withColumn(_OWNER, F.col("auth_user_id"))
    key, owners = link
    return rows.join(owners, key, "left")


def visible_to(table: str, tables: dict[str, DataFrame], principal, role: str | None) -> DataFrame:
    """The rows of one table that one principal may read: chained semi joins from the user."""
    policy, rows = POLICIES[table], tables[table]
    if policy.read_all or role == ADMIN:
        return rows
    if policy.owner == "auth_user_id":
        return rows.where(F.col("auth_user_id") == F.lit(principal))
    own = tables["customers"].where(F.col("auth_user_id") == F.lit(principal)).select(F.col("id").alias("customer_id"))
    if policy.owner == "customer":
        return rows.join(own, "customer_id", "left_semi")
    orders = tables["orders"].join(own, "customer_id", "left_semi").select(F.col("id").alias("order_id"))
    return rows.join(orders, "order_id", "left_semi")


def visible_rows(table: str, tables: dict[str, DataFrame], principals: DataFrame) -> DataFrame:
    """Own rows of all non-admin principals at once: the table's columns plus ``principal``.

    Who sees a whole table is in ``sees_all``; listing the table once per such principal would only
    multiply it. A table that everyone may read has no own rows and is refused rather than answered empty.
    """
    policy = POLICIES[table]
    if policy.read_all:
        raise ValueError(f"everyone may read all rows of {table}: use sees_all, visible_to or visible_counts")
    users = principals.where(~F.col("role").eqNullSafe(ADMIN)).select(F.col("auth_user_id").alias(_OWNER))
    owned = with_owner(tables[table], policy, tables)
    return owned.join(users, _OWNER).withColumnRenamed(_OWNER, "principal")


def sees_all(table: str, principals: DataFrame) -> DataFrame:
    """Add ``sees_all``: whether a principal may read every row of the table."""
    return principals.withColumn("sees_all", F.lit(POLICIES[table].read_all) | F.col("role").eqNullSafe(ADMIN))


def visible_counts(table: str, tables: dict[str, DataFrame], principals: DataFrame) -> DataFrame:
    """How many rows of a table each principal may read."""
    counted = sees_all(table, principals).withColumn("n_all", tables[table].agg(F.count("*")).scalar())
    if POLICIES[table].read_all:
        return counted.select("auth_user_id", "role", F.col("n_all").alias("n_visible"))
    own = visible_rows(table, tables, principals).groupBy("principal").agg(F.count("*").alias("n_own"))
    return counted.join(own.withColumnRenamed("principal", "auth_user_id"), "auth_user_id", "left").select(
        "auth_user_id",
        "role",
        F.when(F.col("sees_all"), F.col("n_all")).otherwise(F.coalesce("n_own", F.lit(0))).alias("n_visible"),
    )


def write_check(
    table: str,
    proposed: DataFrame,
    tables: dict[str, DataFrame],
    principals: DataFrame,
    action: str = "insert",
    key: str = "id",
) -> DataFrame:
    """Add ``allowed`` to proposed rows, each carrying the ``principal`` who wants to write it.

    An insert must belong to its writer. An update must belong to the writer before and after, a delete before: the stored
    row is found by ``key``. A row that is not stored cannot be updated or deleted by its owner.
    """
    policy = POLICIES[table]
    roles = principals.select(F.col("auth_user_id").alias("principal"), F.col("role").alias(_ROLE))
    owned = with_owner(proposed, policy, tables)
    may_own = {"insert": policy.own_insert, "update": policy.own_update, "delete": policy.own_delete}[action]
    own = F.lit(may_own)
    if action != "delete":
        own = own & F.coalesce(F.col(_OWNER) == F.col("principal"), F.lit(False))
    if action != "insert" and may_own:
        stored = with_owner(tables[table], policy, tables).select(key, F.col(_OWNER).alias(_STORED))
        owned = owned.join(stored, key, "left")
        own = own & F.coalesce(F.col(_STORED) == F.col("principal"), F.lit(False))
    joined = owned.join(roles, "principal", "left")
    return joined.withColumn("allowed", F.col(_ROLE).eqNullSafe(ADMIN) | own).drop(_OWNER, _STORED, _ROLE)


def contracted_products(products: DataFrame, hotel_suppliers: DataFrame, hotels: DataFrame) -> DataFrame:
    """Products each hotel may see by its supplier contracts: products plus ``hotel_id``."""
    valid = hotel_suppliers.join(hotels.select(F.col("id").alias("hotel_id")), "hotel_id", "left_semi")
    return products.join(valid.select("hotel_id", "supplier_id").distinct(), "supplier_id")
