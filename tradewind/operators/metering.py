"""Usage metering: tokens and cost by tenant, customer, day and model."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.functions.scalars import COST, count_where, estimated_tokens, in_month, since_days, token_cost, total

def _is_ai():
    return F.col("kind") == "ai_message"


def usage_summary(usage: DataFrame, as_of: datetime) -> DataFrame:
    """One row: this month's messages, tokens and cost."""
    return usage.where(in_month(F.col("created_at"), as_of)).agg(
        count_where(_is_ai()).alias("ai_messages"), *(total(F.col(c), "long").alias(c) for c in ("input_tokens", "output_tokens", "embedding_tokens")), total(F.col("estimated_cost"), COST).alias("total_cost")
    )


def usage_by_customer(usage: DataFrame, as_of: datetime, limit: int = 50) -> DataFrame:
    """The customers with most tokens this month."""
    rows = usage.where(_is_ai() & F.col("customer_ref").isNotNull() & in_month(F.col("created_at"), as_of))
    by = rows.groupBy("customer_ref").agg(F.count("*").alias("messages"), total(F.col("input_tokens") + F.col("output_tokens"), "long").alias("tokens"), total(F.col("estimated_cost"), COST).alias("cost"), F.max("created_at").alias("last_at"))
    return by.orderBy(F.desc("tokens"), "customer_ref").limit(limit)


def daily_report(usage: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    rows = usage.where(since_days(F.col("created_at"), as_of, days)).groupBy(F.to_date("created_at").alias("day"))
    return rows.agg(count_where(_is_ai()).alias("ai_messages"), total(F.col("input_tokens") + F.col("output_tokens"), "long").alias("tokens"), total(F.col("estimated_cost"), COST).alias("cost_usd")).orderBy("day")


def embedding_cost(chunks: DataFrame, by: str) -> DataFrame:
    """Tokens and cost of embedding each document's chunks."""
    per = chunks.groupBy(by).agg(F.sum(estimated_tokens(F.col("content"))).cast("long").alias("embedding_tokens"))
    return per.withColumn("cost", token_cost(F.lit(0), F.lit(0), F.col("embedding_tokens")))


def metered_replies(messages: DataFrame) -> DataFrame:
    """The usage rows that replies append: estimated tokens of the question before and of the answer, and the cost."""
    from pyspark.sql import Window

    before = F.lag("content").over(Window.partitionBy("conversation_id").orderBy("created_at", "id"))
    rows = messages.withColumn("question", before).where(F.col("role") == "ai")
    rows = rows.select("id", "conversation_id", F.lit("ai_message").alias("kind"), estimated_tokens(F.col("question")).alias("input_tokens"), estimated_tokens(F.col("content")).alias("output_tokens"))
    return rows.withColumn("estimated_cost", token_cost(F.col("input_tokens"), F.col("output_tokens"), F.lit(0)))
