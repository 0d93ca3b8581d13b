"""Lookups, searches and pages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.functions.scalars import clamp, ntz


def search_like(df: DataFrame, column: str, query: str) -> DataFrame:
    """Case-folded substring search; % and _ in the query are wildcards, a blank query matches everything."""
    query = query.strip().lower()
    return df.where(F.lower(column).like(f"%{query}%")) if query else df


def search_either(df: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows with the query, case-folded, in any of the columns; nulls count as empty."""
    found = F.lit(False)
    for c in columns:
        found = found | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(query.lower())
    return df.where(found)


def by_json_key(df: DataFrame, column: str, key: str, value: str) -> DataFrame:
    return df.where(F.get_json_object(column, f"$.{key}") == value)


def offset_page(df: DataFrame, order: list, limit: int, offset: int, most: int = 200) -> DataFrame:
    """A page with the total and whether more follow; limit is held between 1 and most."""
    limit, offset = clamp(limit, 1, most), max(0, offset)
    total = df.agg(F.count("*").alias("total"))
    page = df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row
    return page.withColumn("has_more", F.col("total") > offset + limit)


def keyset_page(messages: DataFrame, conversation_id: int, limit: int, before: datetime | None = None) -> DataFrame:
    """The newest messages of a conversation (before a time), oldest first."""
    rows = messages.where(F.col("conversation_id") == conversation_id)
    if before is not None:
        rows = rows.where(F.col("created_at") < ntz(before))
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(clamp(limit, 1, 200)).orderBy("created_at", "id")


def poll(messages: DataFrame, conversation_id: int, after: datetime | None = None, limit: int = 200) -> DataFrame:
    """A conversation's messages that came later than a time, oldest first; without one, all up to limit."""
    rows = messages.where(F.col("conversation_id") == conversation_id)
    if after is not None:
        rows = rows.where(F.col("created_at") > ntz(after))
    return rows.orderBy("created_at", "id").limit(clamp(limit, 1, 200))


def first_per_group(df: DataFrame, group: list[str], order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("_n = 1").drop("_n")


def inbox(conversations: DataFrame, messages: DataFrame, accounts: DataFrame, channels: DataFrame) -> DataFrame:
    """Conversations with assignee, channel, message count and latest message, folded in one pass over messages."""
    last = messages.groupBy("conversation_id").agg(F.count("*").alias("messages"), F.max_by("content", F.struct("created_at", "id")).alias("last_message"), F.max("created_at").alias("last_at"))
    rows = conversations.join(last.withColumnRenamed("conversation_id", "id"), "id", "left")
    rows = rows.join(accounts.select(F.col("id").alias("assigned_user_id"), F.col("email").alias("assignee")), "assigned_user_id", "left")
    rows = rows.join(channels.select(F.col("id").alias("channel_id"), F.col("kind").alias("channel_kind")), "channel_id", "left")
    return rows.select("id", "customer_ref", "customer_name", "status", "assignee", "channel_kind", F.coalesce("messages", F.lit(0)).alias("messages"), "last_message", "last_at")


def products_with_variants(products: DataFrame, variants: DataFrame) -> DataFrame:
    """Products with their variants by name, in one array."""
    listed = variants.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("name", "stock", "price"))).alias("variants"), F.sum("stock").alias("stock"))
    return products.join(listed.withColumnRenamed("product_id", "id"), "id", "left")
