"""Message events: windows of memory, latest conversations, transitions, staleness, handing over."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.functions.scalars import intent, stale

#: Hints for the synthetic corpus; callers pass their own language's.
ORDER_HINTS = ("order", "ship", "tracking", "delivery")
PRODUCT_HINTS = ("price", "size", "stock", "variant", "colour")


def classified(messages: DataFrame, order_hints=ORDER_HINTS, product_hints=PRODUCT_HINTS) -> DataFrame:
    return messages.withColumn("intent", intent(F.col("content"), order_hints, product_hints))


def memory_window(messages: DataFrame, last: int = 16) -> DataFrame:
    """The last messages of every conversation, with their place, oldest first (position 1)."""
    newest = Window.partitionBy("conversation_id").orderBy(F.desc("created_at"), F.desc("id"))
    kept = messages.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= last)
    oldest = Window.partitionBy("conversation_id").orderBy("created_at", "id")
    return kept.withColumn("position", F.row_number().over(oldest)).drop("_n")


def latest_conversation(conversations: DataFrame) -> DataFrame:
    """For every (channel, customer): its newest conversation, and its own name or else the latest known one."""
    key = ["channel_id", "customer_ref"]
    at = F.struct("created_at", "id")
    named = F.max_by("customer_name", F.when(F.col("customer_name").isNotNull(), at))
    return conversations.groupBy(*key).agg(F.max_by("id", at).alias("conversation_id"), F.coalesce(F.max_by("customer_name", at), named).alias("customer_name"), F.count("*").alias("conversations"))


def status_transitions(events: DataFrame) -> DataFrame:
    """Only the events (entity, at, id, status) whose status differs from the one before; a first status counts."""
    before = F.lag("status").over(Window.partitionBy("entity").orderBy("at", "id"))
    return events.withColumn("before", before).where(~F.col("status").eqNullSafe(F.col("before")))


def flagged_stale(events: DataFrame, window_s: int = 600) -> DataFrame:
    """All events (event_s, arrival_s), late ones flagged and not dropped."""
    return events.withColumn("stale", stale(F.col("event_s"), F.col("arrival_s").cast("double"), window_s))


def handoff(events: DataFrame) -> DataFrame:
    """needs_human: nothing found for an order or product question, unless the bot's flag (default true) is off."""
    wanted = F.col("intent").isin("product", "order") & (F.col("context_blocks") == 0)
    return events.withColumn("needs_human", wanted & F.coalesce(F.col("handoff_enabled"), F.lit(True)))
