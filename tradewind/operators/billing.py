"""Entitlements, quotas, terms, renewal and bank-transfer reconciliation."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.functions.scalars import in_month, letters_and_digits, ntz
from tradewind.operators.scans import running_sums
from tradewind.sources.shared import staged

ENTITLEMENTS = "llm_mode string, billing_mode string, ai_tokens_month long, ai_messages_month long, overage_per_1k double, payg_per_1k double, channels_allowed array<string>, knowledge_docs long, max_file_mb long"
DAY_S = 86_400


def entitlements(accounts: DataFrame, subscriptions: DataFrame, plans: DataFrame, default_plan: str = "free") -> DataFrame:
    """Each account's plan and entitlements; without a subscription, the default plan's. Status and expiry play no part."""
    chosen = accounts.select(F.col("id").alias("account_id")).join(subscriptions.select("account_id", "plan_code"), "account_id", "left")
    chosen = chosen.withColumn("plan", F.coalesce("plan_code", F.lit(default_plan))).drop("plan_code")
    return chosen.join(plans.withColumnRenamed("code", "plan"), "plan").withColumn("e", F.from_json("entitlements", ENTITLEMENTS)).select(
        "account_id", "plan", F.col("name").alias("plan_name"), "price_month", F.coalesce("e.llm_mode", F.lit("byok")).alias("llm_mode"), F.coalesce("e.billing_mode", F.lit("subscription")).alias("billing_mode"),
        F.coalesce("e.ai_tokens_month", F.lit(0)).alias("tokens_included"), F.coalesce("e.ai_messages_month", F.lit(0)).alias("messages_limit"), F.coalesce("e.overage_per_1k", F.lit(0.0)).alias("overage_per_1k"),
        F.coalesce("e.channels_allowed", F.array(F.lit("website"))).alias("channels_allowed"), F.coalesce("e.knowledge_docs", F.lit(50)).alias("knowledge_docs"), F.coalesce("e.max_file_mb", F.lit(10)).alias("max_file_mb"),
    )


def channel_allowed(entitled: DataFrame, kinds: list[str]) -> DataFrame:
    """Which of the channel kinds each account may use."""
    return entitled.select("account_id", F.explode(F.array(*map(F.lit, kinds))).alias("kind"), "channels_allowed").select("account_id", "kind", F.array_contains("channels_allowed", F.col("kind")).alias("allowed"))


def _allowed(tokens: Column, messages: Column) -> Column:
    managed = (F.col("tokens_included") == 0) | (tokens < F.col("tokens_included")) | (F.col("overage_per_1k") > 0)
    return F.when(F.col("billing_mode") == "payg", True).when(F.col("llm_mode") == "managed", managed).otherwise((F.col("messages_limit") == 0) | (messages < F.col("messages_limit")))


def quota_state(entitled: DataFrame, month: DataFrame) -> DataFrame:
    """Whether each account may go on, given its tokens_used and messages_used this month (month, by account_id)."""
    rows = entitled.join(month, "account_id", "left").na.fill(0, ["tokens_used", "messages_used"])
    return rows.select("account_id", "plan", "tokens_used", "messages_used", _allowed(F.col("tokens_used"), F.col("messages_used")).alias("allowed"))


def quota_running(entitled: DataFrame, events: DataFrame) -> DataFrame:
    """For every metered event (id, account_id, kind, tokens, created_at), use before it in its month and the verdict.

    The running sums are scanned range by range, so an account with most of the events is spread over many tasks.
    """
    rows = events.select("id", "account_id", F.date_trunc("month", "created_at").alias("month"), "created_at", "tokens", F.when(F.col("kind") == "ai_message", 1).otherwise(0).alias("message"))
    rows = running_sums(rows, ["account_id", "month"], ["created_at", "id"], {"tokens_before": "tokens", "messages_before": "message"})
    return rows.join(entitled, "account_id").select("id", "account_id", "tokens_before", "messages_before", _allowed(F.col("tokens_before"), F.col("messages_before")).alias("allowed"))


def term_extension(subscriptions: DataFrame, payments: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """The period end after a payment for paid_plan: a running term is carried over, whichever plan it was for."""
    now, term = ntz(as_of), F.expr(f"interval '{days}' day")
    end = F.col("current_period_end")
    running = end.isNotNull() & (end > now)
    rows = payments.join(subscriptions, "account_id", "left")
    same = F.col("plan_code") == F.col("paid_plan")
    until = F.when(running & same, end + term).when(running, now + term + (end - now)).otherwise(now + term)
    return rows.select("account_id", "paid_plan", until.cast("timestamp_ntz").alias("period_end"))


def renewal_state(entitled: DataFrame, subscriptions: DataFrame, as_of: datetime) -> DataFrame:
    """Reminders of paid plans: days_left is cut to whole days towards zero."""
    rows = entitled.join(subscriptions.select("account_id", "current_period_end"), "account_id", "left")
    expires = (F.col("price_month") > 0) & F.col("current_period_end").isNotNull()
    seconds = F.timestamp_diff("SECOND", ntz(as_of), F.col("current_period_end"))
    days = seconds / DAY_S
    when = lambda x: F.when(expires, x)
    return rows.select("account_id", "plan", expires.alias("expires"), when(days.cast("long")).alias("days_left"), when(seconds < 0).alias("expired"), when((seconds >= 0) & (seconds <= 7 * DAY_S)).alias("expiring"))


def first_arrivals(transfers: DataFrame) -> DataFrame:
    """A transaction id is taken once, the earliest row of it (created_at, row_id); rows without an id are all taken.

    An id that is sent very often is reduced to one row in each task before it is moved.
    """
    rest = [c for c in transfers.columns if c not in ("txn_id", "created_at", "row_id")]
    first = transfers.where("txn_id IS NOT NULL").groupBy("txn_id").agg(F.min_by(F.struct("created_at", "row_id", *rest), F.struct("created_at", "row_id")).alias("first"))
    return first.select("txn_id", "first.*").select(*transfers.columns).unionByName(transfers.where("txn_id IS NULL"))


CODE_DIGITS = 8


def invoice_code(invoice_id: Column) -> Column:
    """The code that stands for an invoice in a memo: the last CODE_DIGITS hexadecimal digits of its id."""
    return F.lpad(F.hex(F.pmod(invoice_id.cast("long"), F.lit(16**CODE_DIGITS))), CODE_DIGITS, "0")


def _claims(arrivals: DataFrame, invoices: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """turn, invoice, account_id: the open invoices that each incoming transfer names, by the codes in its memo."""
    form = F.lit(f"(?=(?:{'|'.join(prefixes)})([0-9A-F]{{{CODE_DIGITS}}}))")
    codes = F.array_distinct(F.regexp_extract_all(letters_and_digits(F.col("memo")), form, F.lit(1)))
    incoming = arrivals.where(F.lower("transfer_type").isin("in", "")).select(F.struct("created_at", "row_id").alias("turn"), F.explode(codes).alias("code"))
    open_ = invoices.where(F.col("status").isin("pending", "submitted")).groupBy(invoice_code(F.col("id")).alias("code")).agg(F.min("id").alias("least"), F.max("id").alias("most"), F.first("account_id").alias("account_id"))
    one = F.when(F.col("least") == F.col("most"), F.col("least")).otherwise(F.raise_error(F.lit("open invoices share a code")).cast("long"))
    return incoming.join(open_.select("code", one.alias("invoice"), "account_id"), "code").drop("code")


def reconcile(transfers: DataFrame, invoices: DataFrame, prefixes: tuple[str, str] = ("QR", "INV")) -> DataFrame:
    """First arrivals (row_id, txn_id, amount, memo, transfer_type, created_at) matched to open invoices (id, account_id, status).

    Transfers count in order of arrival: each pays for the least invoice that its memo names and that is open by
    then, and a payment closes all that its account has open. Amounts are not compared, outgoing money pays nothing,
    and a transaction id that was seen before is no arrival at all. named_invoice is the least one that was open
    before any of them; matched_invoice the one that is paid. Open invoices that share a code stop the run.

    No transfer is held against every open invoice: codes are pulled out by their form and joined by equality. Then
    transfers propose to the account of their least invoice, every account holds on to its earliest proposal, and
    who is turned away goes on to its next invoice. Since all accounts rank transfers alike, this ends with what
    taking them one by one gives. A round is two aggregations; there is a further one only while somebody who was
    turned away has named another account.
    """
    arrivals = first_arrivals(transfers)
    claims = staged(_claims(arrivals, invoices, prefixes), "claims")
    named = claims.groupBy("turn").agg(F.min("invoice").alias("named_invoice"))
    live = claims
    while True:
        proposals = live.groupBy("turn").agg(F.min(F.struct("invoice", "account_id")).alias("p")).select("turn", "p.*")
        held = proposals.groupBy("account_id").agg(F.min(F.struct("turn", "invoice")).alias("h")).select("account_id", "h.*")
        held = staged(held, "held")
        turned_away = proposals.join(held.select("turn"), "turn", "left_anti").select("turn", "account_id")
        following = live.join(turned_away, ["turn", "account_id"], "left_anti")
        if following.join(turned_away.select("turn"), "turn", "left_semi").isEmpty():
            break
        live = staged(following, "claims")
    decided = named.join(held.select("turn", F.col("invoice").alias("matched_invoice")), "turn", "left").select("turn.row_id", "named_invoice", "matched_invoice")
    found = arrivals.join(decided, "row_id", "left")
    status = F.when(F.col("matched_invoice").isNotNull(), "activated").otherwise("received").alias("status")
    return found.select("row_id", "txn_id", "amount", "named_invoice", "matched_invoice", status)


def settled(invoices: DataFrame, matched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The invoices after matched transfers, and the payments (invoice_id, account_id, txn_id, amount).

    The invoice that was paid for becomes paid; its account's other open invoices become void.
    """
    paid = matched.where("matched_invoice IS NOT NULL").select(F.col("matched_invoice").alias("id"), F.struct("txn_id", "amount").alias("payment"))
    rows = invoices.join(paid, "id", "left")
    payments = rows.where("payment IS NOT NULL").select(F.col("id").alias("invoice_id"), "account_id", "payment.txn_id", "payment.amount")
    payers = payments.select("account_id", F.lit(True).alias("payer")).distinct()
    still_open = F.col("status").isin("pending", "submitted") & F.col("payer").isNotNull()
    status = F.when(F.col("payment").isNotNull(), "paid").when(still_open, "void").otherwise(F.col("status"))
    after = rows.join(payers, "account_id", "left").withColumn("status", status)
    return after.select(*invoices.columns), payments


def month_usage(events: DataFrame, as_of: datetime) -> DataFrame:
    """tokens_used and messages_used of the month, by account_id."""
    rows = events.where(in_month(F.col("created_at"), as_of))
    return rows.groupBy("account_id").agg(F.sum("tokens").cast("long").alias("tokens_used"), F.count(F.when(F.col("kind") == "ai_message", 1)).alias("messages_used"))


def resolve_config(names: DataFrame, platform: DataFrame, tenant: DataFrame, allow_tenant: bool, fallback: dict[str, str]) -> DataFrame:
    """Each setting's value: the tenant's where allowed, else the platform's, else the fallback."""
    rows = names.join(platform.select("name", F.col("value").alias("p")), "name", "left").join(tenant.select("name", F.col("value").alias("t")), "name", "left")
    default = F.lit(None).cast("string")
    for k, v in fallback.items():
        default = F.when(F.col("name") == k, F.lit(v)).otherwise(default)
    given = [F.col("p"), F.col("t")] if allow_tenant else [F.col("p")]
    return rows.select("name", F.coalesce(*given, default).alias("value"), F.when(F.col("p").isNotNull(), "platform").when(F.col("t").isNotNull() & F.lit(allow_tenant), "tenant").otherwise("default").alias("origin"))


def with_default_limits(plans: DataFrame, limits: dict[str, int], column: str = "entitlements") -> DataFrame:
    """Plans' JSON objects with the limits that they do not state (a stated null counts as stated); what is no object stays."""
    out = plans
    for key, value in limits.items():
        text = F.rtrim(column)
        keys = F.json_object_keys(column)
        added = F.concat(F.left(text, F.length(text) - 1), F.when(F.size(keys) > 0, ",").otherwise(""), F.lit(f'"{key}":{value}}}'))
        out = out.withColumn(column, F.when(~F.array_contains(keys, key), added).otherwise(F.col(column)))
    return out
