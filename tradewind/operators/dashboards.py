"""Dashboards: conditional counts, dense date axes, top intents."""

from __future__ import annotations

from datetime import datetime, time, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.functions.scalars import COST, count_where, in_month, ntz, since_days, total


def date_axis(spark: SparkSession, as_of: datetime, days: int = 14) -> DataFrame:
    first, last = (as_of - timedelta(days=days - 1)).date(), as_of.date()
    return spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("interval 1 day"))).alias("date"))


def totals(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """One row for each shop: conversations, handed over, replies by author, and the share of AI replies."""
    convs = conversations.groupBy("shop_id").agg(F.count("*").alias("conversations"), count_where(F.col("status").isin("needs_human", "human")).alias("handoff"))
    role = lambda r: count_where(F.col("role") == r)
    per = messages.groupBy("conversation_id").agg(role("ai").alias("ai"), role("agent").alias("agent"), role("customer").alias("customer"))
    msgs = conversations.select("id", "shop_id").join(per, F.col("id") == F.col("conversation_id")).groupBy("shop_id").agg(F.sum("ai").alias("ai_messages"), F.sum("agent").alias("human_replies"), F.sum("customer").alias("customer_messages"))
    out = convs.join(msgs, "shop_id", "left").na.fill(0, ["ai_messages", "human_replies", "customer_messages"])
    answered = F.col("ai_messages") + F.col("human_replies")
    return out.withColumn("ai_rate", F.when(answered > 0, F.floor(F.col("ai_messages") * 100 / answered + 0.5)).otherwise(0).cast("int"))


def reply_cost(usage: DataFrame, as_of: datetime) -> DataFrame:
    """Cost and whole-millisecond mean latency of this month's replies for each shop."""
    rows = usage.where((F.col("kind") == "ai_message") & in_month(F.col("created_at"), as_of)).groupBy("shop_id")
    return rows.agg(total(F.col("estimated_cost"), COST).alias("cost_month"), F.coalesce(F.avg("latency_ms"), F.lit(0)).cast("int").alias("avg_latency_ms"))


def message_series(conversations: DataFrame, messages: DataFrame, as_of: datetime, days: int = 14) -> DataFrame:
    """Messages by author for each shop and day, with zeros: counted first, then laid on the axis."""
    axis = date_axis(conversations.sparkSession, as_of, days)
    shops = conversations.select("shop_id").distinct()
    first = datetime.combine(as_of.date() - timedelta(days=days - 1), time())
    rows = messages.where(F.col("created_at").between(ntz(first), ntz(as_of))).join(conversations.select(F.col("id").alias("conversation_id"), "shop_id"), "conversation_id")
    role = lambda r: count_where(F.col("role") == r)
    counted = rows.groupBy("shop_id", F.to_date("created_at").alias("date")).agg(role("ai").alias("ai"), role("agent").alias("human"), role("customer").alias("customer"))
    laid = shops.crossJoin(F.broadcast(axis)).join(counted, ["shop_id", "date"], "left").na.fill(0, ["ai", "human", "customer"])  # axis: so many days
    return laid.select("shop_id", "date", F.date_format("date", "dd/MM").alias("day"), "ai", "human", "customer")


def platform_series(usage: DataFrame, as_of: datetime, days: int = 14) -> DataFrame:
    axis = date_axis(usage.sparkSession, as_of, days)
    counted = usage.where(since_days(F.col("created_at"), as_of, days)).groupBy(F.to_date("created_at").alias("date")).agg(count_where(F.col("kind") == "ai_message").alias("ai_messages"), total(F.col("estimated_cost"), COST).alias("cost"))
    laid = axis.join(counted, "date", "left")
    return laid.select(F.date_format("date", "dd/MM").alias("day"), F.coalesce("ai_messages", F.lit(0)).cast("long").alias("ai_messages"), F.coalesce("cost", F.lit(0)).cast(COST).alias("cost")).orderBy("day")


def top_intents(messages: DataFrame, as_of: datetime, limit: int = 6, unknown: str = "other") -> DataFrame:
    rows = messages.where((F.col("role") == "ai") & since_days(F.col("created_at"), as_of, 30))
    named = rows.groupBy(F.coalesce(F.get_json_object("meta", "$.intent"), F.lit(unknown)).alias("intent")).agg(F.count("*").alias("count"))
    return named.orderBy(F.desc("count"), "intent").limit(limit)


def platform_overview(organizations: DataFrame, shops: DataFrame, conversations: DataFrame, usage: DataFrame, as_of: datetime) -> DataFrame:
    month = usage.where(in_month(F.col("created_at"), as_of)).agg(count_where(F.col("kind") == "ai_message").alias("ai_messages_month"), total(F.col("estimated_cost"), COST).alias("cost_month"))
    out = organizations.agg(F.count("*").alias("tenants"))
    for df, name in ((shops, "shops"), (conversations, "conversations")):
        out = out.crossJoin(df.agg(F.count("*").alias(name)))  # one row each
    return out.crossJoin(month)
