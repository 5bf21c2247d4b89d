"""The alert feed, and the user rows that scope it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmart.functions.columns import timestamp_text
from salesmart.model import Scope
from salesmart.operators.upsert import upsert

FEED_ROWS = 50


def _own_or_shared(column: str, value) -> Column:
    return F.col(column).isNull() | (F.col(column) == F.lit(value).cast("bigint"))


def visible(notifications: DataFrame, scope: Scope) -> DataFrame:
    """Shared ones and the caller's own; for a manager also only those of no store or of the own store."""
    seen = notifications.where(_own_or_shared("user_id", scope.user_id))
    return seen if scope.is_admin else seen.where(_own_or_shared("store_id", scope.store_id))


def feed(
    notifications: DataFrame, dim_store: DataFrame, scope: Scope, rows: int = FEED_ROWS, receipts: DataFrame | None = None
) -> DataFrame:
    """The newest notifications the caller may see, a page of ``rows``.

    The page is found first. Stores and receipts are reduced to those the page mentions,
    a semi join with its few ids, before they meet it.
    """
    newest = (F.col("created_at").desc(), F.col("notification_id"))
    page = visible(notifications, scope).orderBy(*newest).limit(rows)
    if receipts is not None:
        page = mark_read(page, receipts.join(page.select("notification_id"), "notification_id", "left_semi"))
    stores = dim_store.select("store_id", "store_name").join(page.select("store_id"), "store_id", "left_semi")
    named = page.join(stores, "store_id", "left")
    return named.orderBy(*newest).select(
        "notification_id",
        "type",
        "title",
        "message",
        "severity",
        "is_read",
        timestamp_text(F.col("created_at")).alias("created_at"),
        "store_name",
    )


def unread_count(notifications: DataFrame, scope: Scope, receipts: DataFrame | None = None) -> DataFrame:
    """Unread among all notifications the caller may see, not only those of a page."""
    unread = visible(notifications, scope).where(~F.col("is_read"))
    if receipts is not None:
        unread = unread.join(receipts.select("notification_id"), "notification_id", "left_anti")
    return unread.agg(F.count("*").alias("unread_count"))


def mark_read(notifications: DataFrame, receipts: DataFrame) -> DataFrame:
    """Read if stored so, or if a receipt (notification_id) exists, however many."""
    seen = receipts.select("notification_id").distinct().withColumn("_seen", F.lit(True))
    return (
        notifications.join(seen, "notification_id", "left")
        .withColumn("is_read", F.col("is_read") | F.col("_seen").isNotNull())
        .drop("_seen")
    )


def mark_all_read(notifications: DataFrame, user_id: int) -> DataFrame:
    """Everything shared or the caller's own becomes read, whatever its store."""
    return notifications.withColumn("is_read", F.col("is_read") | _own_or_shared("user_id", user_id))


def user_directory(users: DataFrame, dim_store: DataFrame) -> DataFrame:
    """All users with store name and city, newest first."""
    named = users.join(dim_store.select("store_id", "store_name", "city"), "store_id", "left")
    return named.orderBy(F.col("created_at").desc(), "user_id").select(
        "user_id",
        "username",
        "role",
        "store_id",
        "store_name",
        "city",
        timestamp_text(F.col("created_at")).alias("created_at"),
        timestamp_text(F.col("last_login")).alias("last_login"),
        "is_active",
    )


def scope_rows(dim_store: DataFrame) -> DataFrame:
    """One manager per store, and an admin bound to none."""
    managers = dim_store.select(
        F.concat(F.lit("store_"), F.col("store_id").cast("string")).alias("username"),
        F.lit("store_manager").alias("role"),
        "store_id",
    )
    admin = dim_store.sparkSession.range(1).select(
        F.lit("admin").alias("username"), F.lit("admin").alias("role"), F.lit(None).cast("bigint").alias("store_id")
    )
    return managers.unionByName(admin)


def upsert_scopes(users: DataFrame, scopes: DataFrame, now: Column) -> DataFrame:
    """Users after provisioning: role and store replaced, the user active again.

    A new user takes ``user_id`` from ``scopes`` if it has one, and ``now`` as its
    date of creation.
    """
    return upsert(
        users,
        scopes.withColumn("is_active", F.lit(True)),
        ["username"],
        ["role", "store_id", "is_active"],
        defaults={"created_at": now},
    )
