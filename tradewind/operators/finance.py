"""Platform profit and loss: revenue, pending, comped, cost and margin, by tenant and by model."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.functions.scalars import COST, MODEL_UNKNOWN, MONEY, blank_to_null, count_where, in_month, total


def _paid() -> Column:
    """Money taken; plans that an administrator granted are no revenue."""
    return (F.col("status") == "paid") & (F.col("provider") != "admin_manual")


def _settled(as_of: datetime) -> Column:
    return in_month(F.coalesce("paid_at", "created_at"), as_of)


def totals(invoices: DataFrame, usage: DataFrame, invoices_as_of: datetime, as_of: datetime) -> DataFrame:
    """One row, each side read once."""
    amount = F.col("amount")
    rev = invoices.agg(
        total(amount, MONEY, _paid() & _settled(invoices_as_of)).alias("revenue_month"),
        total(amount, MONEY, _paid()).alias("revenue_all"),
        total(amount, MONEY, F.col("status").isin("pending", "submitted")).alias("pending"),
        count_where(_paid() & _settled(invoices_as_of)).alias("paid_invoices_month"),
        total(amount, MONEY, (F.col("provider") == "admin_manual") & _settled(invoices_as_of)).alias("comped_month"),
    )
    cost = usage.agg(total(F.col("estimated_cost"), COST, in_month(F.col("created_at"), as_of)).alias("cost_month"), total(F.col("estimated_cost"), COST).alias("cost_all"))
    profit = F.col("revenue_month") - F.col("cost_month")
    margin = F.when(F.col("revenue_month") > 0, F.round(profit.cast("double") / F.col("revenue_month").cast("double") * 100, 1))
    return rev.crossJoin(cost).withColumns({"profit_month": F.round(profit, 2).cast(MONEY), "margin_month": margin.cast("double")})


def by_model(usage: DataFrame, as_of: datetime) -> DataFrame:
    rows = usage.where((F.col("kind") == "ai_message") & in_month(F.col("created_at"), as_of)).groupBy(F.coalesce(blank_to_null(F.col("llm_model")), F.lit(MODEL_UNKNOWN)).alias("model"))
    return rows.agg(F.count("*").alias("messages"), total(F.col("input_tokens"), "long").alias("input_tokens"), total(F.col("output_tokens"), "long").alias("output_tokens"), total(F.col("estimated_cost"), COST).alias("cost")).orderBy(F.desc("cost"), "model")


def by_tenant(organizations: DataFrame, plans: DataFrame, invoices: DataFrame, usage: DataFrame, invoices_as_of: datetime, as_of: datetime) -> DataFrame:
    """Revenue against cost this month; invoices and usage are each summed once before they meet the tenants."""
    revenue = invoices.where(_paid() & _settled(invoices_as_of)).groupBy("organization_id").agg(F.sum("amount").alias("revenue"))
    cost = usage.where(in_month(F.col("created_at"), as_of)).groupBy("organization_id").agg(F.sum("estimated_cost").alias("cost"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    rows = organizations.withColumnRenamed("id", "organization_id").join(plans, "organization_id", "left").join(revenue, "organization_id", "left").join(cost, "organization_id", "left")
    money = F.coalesce("revenue", F.lit(0)).cast(MONEY)
    spent = F.coalesce("cost", F.lit(0)).cast(COST)
    return rows.select(
        F.col("organization_id").alias("id"), "name", F.coalesce("plan_code", F.lit("free")).alias("plan"), money.alias("revenue"), spent.alias("cost"), F.coalesce("input_tokens", F.lit(0)).cast("long").alias("input_tokens"), F.coalesce("output_tokens", F.lit(0)).cast("long").alias("output_tokens"), F.round(money - spent, 2).cast(MONEY).alias("profit")
    ).orderBy(F.desc("revenue"), F.desc("cost"), "id")


def tenant_overview(organizations: DataFrame, plans: DataFrame, shops: DataFrame, usage: DataFrame, as_of: datetime) -> DataFrame:
    """Each tenant with its plan, shops, and this month's messages, tokens and cost."""
    shop = shops.groupBy("organization_id").agg(F.count("*").alias("shops"))
    month = usage.where(in_month(F.col("created_at"), as_of)).groupBy("organization_id").agg(
        count_where(F.col("kind") == "ai_message").alias("ai_messages"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.sum("estimated_cost").alias("cost_month")
    )
    rows = organizations.withColumnRenamed("id", "organization_id")
    for side in (plans, shop, month):
        rows = rows.join(side, "organization_id", "left")
    zero = lambda c, kind="long": F.coalesce(c, F.lit(0)).cast(kind).alias(c)
    return rows.select(F.col("organization_id").alias("id"), "name", "status", F.coalesce("plan_code", F.lit("free")).alias("plan"), zero("shops"), zero("ai_messages"), zero("tokens"), zero("cost_month", COST))


def pending(invoices: DataFrame, organizations: DataFrame, limit: int = 200) -> DataFrame:
    rows = invoices.where(F.col("status").isin("pending", "submitted")).join(organizations.select(F.col("id").alias("organization_id"), F.col("name").alias("organization")), "organization_id")
    return rows.select("id", "organization", "plan_code", "amount", "status", "provider", "created_at").orderBy(F.desc("created_at"), "id").limit(limit)
