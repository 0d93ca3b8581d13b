"""Metering, dashboards, finance and billing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.operators import billing, dashboards, finance, ingest, metering
from tradewind.plans.catalog import Tables, query
from tradewind.plans.fixtures import AS_OF, CODE_BASE, INVOICES_AS_OF
from tradewind.sources import sinks, webhooks
from tradewind.tenancy import TenantContext, at_least

ORG = 1
MONTH = "created_at BETWEEN timestamp '2024-01-01' AND timestamp '2024-01-20 12:00:00'"
SETTLED = "coalesce(paid_at, created_at) BETWEEN timestamp '2001-07-01' AND timestamp '2001-07-20'"
PAID = "status = 'paid' AND provider <> 'admin_manual'"
#: An organization's plan: that of its first account with a subscription.
ORG_PLAN = "SELECT organization_id, min_by(plan_code, account_id) AS plan_code FROM v_subscription JOIN v_account ON id = account_id WHERE organization_id <> 3 GROUP BY organization_id"


def org_plans(t: Tables) -> DataFrame:
    rows = t.subscription.join(t.account.select(F.col("id").alias("account_id"), "organization_id"), "account_id").where("organization_id <> 3")
    return rows.groupBy("organization_id").agg(F.min_by("plan_code", "account_id").alias("plan_code"))


def entitled(t: Tables) -> DataFrame:
    return billing.entitlements(t.account, t.subscription, t.plan)


ENTITLED = """SELECT a.id AS account_id, p.code AS plan, p.name AS plan_name, p.price_month, coalesce(json_extract_string(entitlements, '$.llm_mode'), 'byok') AS llm_mode,
  coalesce(json_extract_string(entitlements, '$.billing_mode'), 'subscription') AS billing_mode, coalesce(cast(json_extract_string(entitlements, '$.ai_tokens_month') AS bigint), 0) AS tokens_included,
  coalesce(cast(json_extract_string(entitlements, '$.ai_messages_month') AS bigint), 0) AS messages_limit, coalesce(cast(json_extract_string(entitlements, '$.overage_per_1k') AS double), 0) AS overage_per_1k,
  cast(json_extract(entitlements, '$.channels_allowed') AS varchar[]) AS channels, coalesce(cast(json_extract_string(entitlements, '$.knowledge_docs') AS bigint), 50) AS knowledge_docs
  FROM v_account a LEFT JOIN v_subscription s ON s.account_id = a.id JOIN v_plan p ON p.code = coalesce(s.plan_code, 'free')"""
ALLOWED = "CASE WHEN billing_mode = 'payg' THEN true WHEN llm_mode = 'managed' THEN tokens_included = 0 OR {t} < tokens_included OR overage_per_1k > 0 ELSE messages_limit = 0 OR {m} < messages_limit END"
ACCOUNT_EVENTS = "SELECT id, id % 150 AS account_id, kind, input_tokens + output_tokens AS tokens, created_at FROM v_usage_event"


def account_events(t: Tables) -> DataFrame:
    return t.usage_event.select("id", (F.col("id") % 150).alias("account_id"), "kind", (F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), "created_at")


@query(f"""SELECT count(*) FILTER (WHERE kind = 'ai_message') AS ai_messages, cast(coalesce(sum(input_tokens), 0) AS bigint) AS input_tokens, cast(coalesce(sum(output_tokens), 0) AS bigint) AS output_tokens,
  cast(coalesce(sum(embedding_tokens), 0) AS bigint) AS embedding_tokens, cast(coalesce(sum(estimated_cost), 0) AS decimal(18,6)) AS total_cost FROM v_usage_event WHERE organization_id = {ORG} AND {MONTH}""")
def usage_summary(t: Tables) -> DataFrame:
    return metering.usage_summary(TenantContext(ORG).visible(t.usage_event), AS_OF)


@query(f"""SELECT customer_ref, count(*) AS messages, cast(sum(input_tokens + output_tokens) AS bigint) AS tokens, cast(sum(estimated_cost) AS decimal(18,6)) AS cost, max(created_at) AS last_at
  FROM v_usage_event WHERE organization_id = {ORG} AND kind = 'ai_message' AND customer_ref IS NOT NULL AND {MONTH} GROUP BY 1 ORDER BY tokens DESC, 1 LIMIT 50""")
def usage_by_customer(t: Tables) -> DataFrame:
    return metering.usage_by_customer(TenantContext(ORG).visible(t.usage_event), AS_OF)


@query("""SELECT cast(created_at AS date) AS day, count(*) FILTER (WHERE kind = 'ai_message') AS ai_messages, cast(sum(input_tokens + output_tokens) AS bigint) AS tokens, cast(sum(estimated_cost) AS decimal(18,6)) AS cost_usd
  FROM v_usage_event WHERE created_at BETWEEN timestamp '2024-01-20 12:00:00' - interval 30 day AND timestamp '2024-01-20 12:00:00' GROUP BY 1""")
def usage_daily_report(t: Tables) -> DataFrame:
    return metering.daily_report(t.usage_event, AS_OF)


@query("""WITH tok AS (SELECT conversation_id, cast(sum(greatest(1, length(content) // 4)) AS bigint) AS embedding_tokens FROM v_message GROUP BY 1)
  SELECT *, cast(embedding_tokens * cast(0.02 AS decimal(6,2)) / 1000000 AS decimal(18,6)) AS cost FROM tok""")
def embedding_cost(t: Tables) -> DataFrame:
    return metering.embedding_cost(t.message, "conversation_id")


@query("""WITH q AS (SELECT *, lag(content) OVER (PARTITION BY conversation_id ORDER BY created_at, id) AS question FROM v_message),
  r AS (SELECT id, conversation_id, 'ai_message' AS kind, greatest(1, length(coalesce(question, '')) // 4) AS input_tokens, greatest(1, length(content) // 4) AS output_tokens FROM q WHERE role = 'ai')
  SELECT *, cast((5 * input_tokens + 25 * output_tokens) * cast(0.000001 AS decimal(7,6)) AS decimal(18,6)) AS estimated_cost FROM r""")
def append_usage(t: Tables) -> DataFrame:
    return metering.metered_replies(t.message)


@query("""WITH m AS (SELECT shop_id, count(*) FILTER (WHERE role = 'ai') AS ai_messages, count(*) FILTER (WHERE role = 'agent') AS human_replies, count(*) FILTER (WHERE role = 'customer') AS customer_messages
    FROM v_message m JOIN v_conversation c ON c.id = m.conversation_id GROUP BY 1),
  c AS (SELECT shop_id, count(*) AS conversations, count(*) FILTER (WHERE status IN ('needs_human', 'human')) AS handoff FROM v_conversation GROUP BY 1)
  SELECT c.*, coalesce(ai_messages, 0) AS ai_messages, coalesce(human_replies, 0) AS human_replies, coalesce(customer_messages, 0) AS customer_messages,
  cast(CASE WHEN ai_messages + human_replies > 0 THEN floor(ai_messages * 100 / (ai_messages + human_replies) + 0.5) ELSE 0 END AS integer) AS ai_rate FROM c LEFT JOIN m USING (shop_id)""")
def dashboard_totals(t: Tables) -> DataFrame:
    return dashboards.totals(t.conversation, t.message)


@query(f"""SELECT shop_id, cast(sum(estimated_cost) AS decimal(18,6)) AS cost_month, cast(trunc(avg(latency_ms)) AS integer) AS avg_latency_ms FROM v_usage_event WHERE kind = 'ai_message' AND {MONTH} GROUP BY 1""")
def dashboard_cost(t: Tables) -> DataFrame:
    return dashboards.reply_cost(t.usage_event, AS_OF)


AXIS = "SELECT cast(d AS date) AS date FROM generate_series(date '2024-01-07', date '2024-01-20', interval 1 day) AS s(d)"


@query(f"""WITH axis AS ({AXIS}), shops AS (SELECT DISTINCT shop_id FROM v_conversation),
  n AS (SELECT shop_id, cast(m.created_at AS date) AS date, count(*) FILTER (WHERE role = 'ai') AS ai, count(*) FILTER (WHERE role = 'agent') AS human, count(*) FILTER (WHERE role = 'customer') AS customer
    FROM v_message m JOIN v_conversation c ON c.id = m.conversation_id WHERE m.created_at <= timestamp '2024-01-20 12:00:00' GROUP BY 1, 2)
  SELECT shop_id, date, strftime(date, '%d/%m') AS day, coalesce(ai, 0) AS ai, coalesce(human, 0) AS human, coalesce(customer, 0) AS customer FROM shops CROSS JOIN axis LEFT JOIN n USING (shop_id, date)""")
def daily_series(t: Tables) -> DataFrame:
    return dashboards.message_series(t.conversation, t.message, AS_OF)


@query(f"""WITH axis AS ({AXIS}), n AS (SELECT cast(created_at AS date) AS date, count(*) FILTER (WHERE kind = 'ai_message') AS a, sum(estimated_cost) AS c FROM v_usage_event WHERE created_at <= timestamp '2024-01-20 12:00:00' GROUP BY 1)
  SELECT strftime(date, '%d/%m') AS day, coalesce(a, 0) AS ai_messages, cast(coalesce(c, 0) AS decimal(18,6)) AS cost FROM axis LEFT JOIN n USING (date)""")
def platform_daily_series(t: Tables) -> DataFrame:
    return dashboards.platform_series(t.usage_event, AS_OF)


@query("""SELECT coalesce(json_extract_string(meta, '$.intent'), 'other') AS intent, count(*) AS count FROM v_message WHERE role = 'ai' AND created_at BETWEEN timestamp '2024-01-20 12:00:00' - interval 30 day AND timestamp '2024-01-20 12:00:00' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6""")
def top_intents(t: Tables) -> DataFrame:
    return dashboards.top_intents(t.message, AS_OF)


@query(f"""SELECT (SELECT count(*) FROM v_organization) AS tenants, (SELECT count(*) FROM v_shop) AS shops, (SELECT count(*) FROM v_conversation) AS conversations,
  (SELECT count(*) FROM v_usage_event WHERE kind = 'ai_message' AND {MONTH}) AS ai_messages_month, cast((SELECT sum(estimated_cost) FROM v_usage_event WHERE {MONTH}) AS decimal(18,6)) AS cost_month""")
def platform_overview(t: Tables) -> DataFrame:
    return dashboards.platform_overview(t.organization, t.shop, t.conversation, t.usage_event, AS_OF)


@query(f"""WITH r AS (SELECT cast(coalesce(sum(amount) FILTER (WHERE {PAID} AND {SETTLED}), 0) AS decimal(18,2)) AS revenue_month, cast(coalesce(sum(amount) FILTER (WHERE {PAID}), 0) AS decimal(18,2)) AS revenue_all,
    cast(coalesce(sum(amount) FILTER (WHERE status IN ('pending', 'submitted')), 0) AS decimal(18,2)) AS pending, count(*) FILTER (WHERE {PAID} AND {SETTLED}) AS paid_invoices_month,
    cast(coalesce(sum(amount) FILTER (WHERE provider = 'admin_manual' AND {SETTLED}), 0) AS decimal(18,2)) AS comped_month FROM v_invoice),
  c AS (SELECT cast(coalesce(sum(estimated_cost) FILTER (WHERE {MONTH}), 0) AS decimal(18,6)) AS cost_month, cast(sum(estimated_cost) AS decimal(18,6)) AS cost_all FROM v_usage_event)
  SELECT *, cast(round(revenue_month - cost_month, 2) AS decimal(18,2)) AS profit_month, CASE WHEN revenue_month > 0 THEN round(cast(revenue_month - cost_month AS double) / cast(revenue_month AS double) * 100, 1) END AS margin_month FROM r, c""")
def finance_totals(t: Tables) -> DataFrame:
    return finance.totals(t.invoice, t.usage_event, INVOICES_AS_OF, AS_OF)


@query(f"""SELECT coalesce(nullif(llm_model, ''), '—') AS model, count(*) AS messages, cast(sum(input_tokens) AS bigint) AS input_tokens, cast(sum(output_tokens) AS bigint) AS output_tokens, cast(sum(estimated_cost) AS decimal(18,6)) AS cost
  FROM v_usage_event WHERE kind = 'ai_message' AND {MONTH} GROUP BY 1""")
def finance_by_model(t: Tables) -> DataFrame:
    return finance.by_model(t.usage_event, AS_OF)


@query(f"""WITH p AS ({ORG_PLAN}), r AS (SELECT organization_id, sum(amount) AS revenue FROM v_invoice WHERE {PAID} AND {SETTLED} GROUP BY 1),
  c AS (SELECT organization_id, sum(estimated_cost) AS cost, sum(input_tokens) AS i, sum(output_tokens) AS o FROM v_usage_event WHERE {MONTH} GROUP BY 1)
  SELECT o.id, o.name, coalesce(plan_code, 'free') AS plan, cast(coalesce(revenue, 0) AS decimal(18,2)) AS revenue, cast(coalesce(cost, 0) AS decimal(18,6)) AS cost, cast(coalesce(i, 0) AS bigint) AS input_tokens, cast(coalesce(c.o, 0) AS bigint) AS output_tokens,
  cast(round(cast(coalesce(revenue, 0) AS decimal(18,2)) - cast(coalesce(cost, 0) AS decimal(18,6)), 2) AS decimal(18,2)) AS profit
  FROM v_organization o LEFT JOIN p ON p.organization_id = o.id LEFT JOIN r ON r.organization_id = o.id LEFT JOIN c ON c.organization_id = o.id""")
def finance_by_tenant(t: Tables) -> DataFrame:
    return finance.by_tenant(t.organization, org_plans(t), t.invoice, t.usage_event, INVOICES_AS_OF, AS_OF)


TENANTS = f"""WITH p AS ({ORG_PLAN}), s AS (SELECT organization_id, count(*) AS shops FROM v_shop GROUP BY 1),
  u AS (SELECT organization_id, count(*) FILTER (WHERE kind = 'ai_message') AS a, sum(input_tokens + output_tokens) AS t, sum(estimated_cost) AS c FROM v_usage_event WHERE {MONTH} GROUP BY 1)
  SELECT o.id, o.name, o.status, coalesce(plan_code, 'free') AS plan, coalesce(shops, 0) AS shops, coalesce(a, 0) AS ai_messages, cast(coalesce(t, 0) AS bigint) AS tokens, cast(coalesce(c, 0) AS decimal(18,6)) AS cost_month
  FROM v_organization o LEFT JOIN p ON p.organization_id = o.id LEFT JOIN s ON s.organization_id = o.id LEFT JOIN u ON u.organization_id = o.id"""


@query(TENANTS)
def tenant_overview(t: Tables) -> DataFrame:
    return finance.tenant_overview(t.organization, org_plans(t), t.shop, t.usage_event, AS_OF)


@query(f"SELECT * FROM ({TENANTS}) AS x ORDER BY cost_month DESC, id LIMIT 8")
def top_tenants(t: Tables) -> DataFrame:
    return finance.tenant_overview(t.organization, org_plans(t), t.shop, t.usage_event, AS_OF).orderBy(F.desc("cost_month"), "id").limit(8)


@query("""SELECT i.id, o.name AS organization, plan_code, amount, i.status, provider, created_at FROM v_invoice i JOIN v_organization o ON o.id = i.organization_id WHERE i.status IN ('pending', 'submitted') ORDER BY created_at DESC, i.id LIMIT 200""")
def pending_invoices(t: Tables) -> DataFrame:
    return finance.pending(t.invoice, t.organization)


@query("""SELECT i.id, 'invoice.activate' AS action, cast(i.id AS varchar) AS target, '{"plan_code":"' || plan_code || '","provider":"' || provider || '"}' AS detail, a.email AS actor, coalesce(paid_at, created_at) AS settled_at
  FROM v_invoice i LEFT JOIN v_account a ON a.id = i.account_id WHERE i.status = 'paid' ORDER BY settled_at DESC, i.id LIMIT 500""")
def audit_recent(t: Tables) -> DataFrame:
    at = F.coalesce("paid_at", "created_at").alias("settled_at")
    rows = t.invoice.where("status = 'paid'").join(t.account.select(F.col("id").alias("account_id"), "email"), "account_id", "left")
    rows = sinks.audit_rows(rows, "invoice.activate", F.col("id"), ["plan_code", "provider"], F.col("id"), F.col("email").alias("actor"), at)
    return rows.orderBy(F.desc("settled_at"), "id").limit(500)


@query(f"SELECT account_id, plan, plan_name, price_month, llm_mode, billing_mode, tokens_included, messages_limit, overage_per_1k, knowledge_docs FROM ({ENTITLED}) AS e")
def entitlements_resolve(t: Tables) -> DataFrame:
    return entitled(t).drop("channels_allowed", "max_file_mb")


@query(f"SELECT account_id, kind, list_contains(coalesce(channels, ['website']), kind) AS allowed FROM ({ENTITLED}) AS e, (VALUES ('website'), ('telegram'), ('whatsapp'), ('messenger')) AS k(kind)")
def entitlement_channels(t: Tables) -> DataFrame:
    return billing.channel_allowed(entitled(t), ["website", "telegram", "whatsapp", "messenger"])


@query(f"""WITH e AS ({ENTITLED}), v AS ({ACCOUNT_EVENTS}), u AS (SELECT account_id, sum(tokens) AS t, count(*) FILTER (WHERE kind = 'ai_message') AS m FROM v WHERE {MONTH} GROUP BY 1),
  x AS (SELECT e.*, cast(coalesce(t, 0) AS bigint) AS tokens_used, coalesce(m, 0) AS messages_used FROM e LEFT JOIN u USING (account_id))
  SELECT account_id, plan, tokens_used, messages_used, {ALLOWED.format(t="tokens_used", m="messages_used")} AS allowed FROM x""")
def quota_state(t: Tables) -> DataFrame:
    return billing.quota_state(entitled(t), billing.month_usage(account_events(t), AS_OF))


@query(f"""WITH e AS ({ENTITLED}), v AS ({ACCOUNT_EVENTS}), b AS (SELECT id, account_id, cast(coalesce(sum(tokens) OVER w, 0) AS bigint) AS tokens_before, cast(coalesce(sum(CASE WHEN kind = 'ai_message' THEN 1 ELSE 0 END) OVER w, 0) AS bigint) AS messages_before
    FROM v WINDOW w AS (PARTITION BY account_id, date_trunc('month', created_at) ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT id, account_id, tokens_before, messages_before, {ALLOWED.format(t="tokens_before", m="messages_before")} AS allowed FROM b JOIN e USING (account_id)""")
def quota_running(t: Tables) -> DataFrame:
    return billing.quota_running(entitled(t), account_events(t))


@query("""SELECT a.id AS account_id, 'growth' AS paid_plan, CASE WHEN current_period_end > timestamp '2024-01-20 12:00:00' AND plan_code = 'growth' THEN current_period_end + to_days(30)
  WHEN current_period_end > timestamp '2024-01-20 12:00:00' THEN timestamp '2024-01-20 12:00:00' + to_days(30) + (current_period_end - timestamp '2024-01-20 12:00:00') ELSE timestamp '2024-01-20 12:00:00' + to_days(30) END AS period_end
  FROM v_account a LEFT JOIN v_subscription s ON s.account_id = a.id""")
def term_extension(t: Tables) -> DataFrame:
    return billing.term_extension(t.subscription, t.account.select(F.col("id").alias("account_id"), F.lit("growth").alias("paid_plan")), AS_OF)


@query(f"""WITH e AS ({ENTITLED}), x AS (SELECT e.account_id, plan, price_month > 0 AND current_period_end IS NOT NULL AS expires, epoch(current_period_end - timestamp '2024-01-20 12:00:00') AS s FROM e LEFT JOIN v_subscription b USING (account_id))
  SELECT account_id, plan, expires, CASE WHEN expires THEN cast(trunc(s / 86400) AS bigint) END AS days_left, CASE WHEN expires THEN s < 0 END AS expired, CASE WHEN expires THEN s >= 0 AND s <= 604800 END AS expiring FROM x""")
def renewal_state(t: Tables) -> DataFrame:
    return billing.renewal_state(entitled(t), t.subscription, AS_OF)


@query("""SELECT row_id, txn_id, amount, memo FROM (SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY created_at, row_id) AS n FROM v_transfer) AS x WHERE txn_id IS NULL OR n = 1""")
def dedupe_transfers(t: Tables) -> DataFrame:
    return billing.first_arrivals(t.transfer).select("row_id", "txn_id", "amount", "memo")


#: Transfers are taken one after another in order of arrival: each pays for its least invoice that is still open, and
#: whatever else its account has open is void from then on.
MATCHED = f"""n AS (SELECT *, regexp_replace(upper(memo), '[^A-Z0-9]', '', 'g') AS m FROM v_transfer QUALIFY row_number() OVER (PARTITION BY txn_id ORDER BY created_at, row_id) = 1),
  o AS (SELECT id + {CODE_BASE} AS id, account_id, status FROM v_invoice),
  code AS (SELECT DISTINCT row_id, created_at, unnest(regexp_extract_all(m, '(?:QR|INV)([0-9A-F]{{8}})', 1)) AS code FROM n WHERE transfer_type IN ('in', '')),
  claim AS (SELECT row_id, created_at, list(struct_pack(inv := o.id, acc := account_id) ORDER BY o.id) AS c FROM code JOIN o ON o.status IN ('pending', 'submitted') AND format('{{:08X}}', o.id) = code GROUP BY ALL),
  turn AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY created_at, row_id) AS i FROM claim),
  taken AS (SELECT cast(0 AS bigint) AS i, cast(NULL AS bigint) AS row_id, cast(NULL AS bigint) AS inv, cast([] AS bigint[]) AS accounts
    UNION ALL SELECT i, row_id, p.inv, CASE WHEN p IS NULL THEN accounts ELSE list_append(accounts, p.acc) END
    FROM (SELECT turn.i, turn.row_id, accounts, list_filter(c, lambda x: NOT list_contains(accounts, x.acc))[1] AS p FROM taken JOIN turn ON turn.i = taken.i + 1) AS step),
  r AS (SELECT n.row_id, txn_id, amount, c[1].inv AS named_invoice, inv AS matched_invoice, CASE WHEN inv IS NOT NULL THEN 'activated' ELSE 'received' END AS status
    FROM n LEFT JOIN turn USING (row_id) LEFT JOIN taken USING (row_id))"""


def coded_invoices(t: Tables) -> DataFrame:
    return t.invoice.select((F.col("id") + CODE_BASE).alias("id"), "account_id", "status")


@query(f"WITH RECURSIVE {MATCHED} SELECT * FROM r")
def reconcile_transfers(t: Tables) -> DataFrame:
    return billing.reconcile(t.transfer, coded_invoices(t))


def transfer_bodies(t: Tables) -> DataFrame:
    """The transfers as the bank posts them: half as JSON, half as forms."""
    fields = {"id": "txn_id", "transferAmount": "amount", "content": "memo", "transferType": "transfer_type"}
    body = F.to_json(F.struct(*(F.col(c).alias(k) for k, c in fields.items())))
    form = F.concat_ws("&", *(F.concat(F.lit(f"{k}="), F.url_encode(F.col(c).cast("string"))) for k, c in fields.items()))
    return t.transfer.select("row_id", "created_at", F.when(F.col("row_id") % 2 == 0, body).otherwise(form).alias("body"))


@query(f"WITH RECURSIVE {MATCHED} SELECT row_id, txn_id, amount::double AS amount, named_invoice, matched_invoice, status FROM r")
def reconcile_webhooks(t: Tables) -> DataFrame:
    return billing.reconcile(webhooks.transfers(transfer_bodies(t)), coded_invoices(t))


@query(f"""WITH RECURSIVE {MATCHED}, y AS (SELECT DISTINCT account_id FROM o JOIN r ON matched_invoice = id)
  SELECT o.id, account_id, CASE WHEN id IN (SELECT matched_invoice FROM r WHERE matched_invoice IS NOT NULL) THEN 'paid' WHEN status IN ('pending', 'submitted') AND account_id IN (SELECT account_id FROM y) THEN 'void' ELSE status END AS status FROM o""")
def settle_invoices(t: Tables) -> DataFrame:
    return billing.settled(coded_invoices(t), billing.reconcile(t.transfer, coded_invoices(t)))[0]


@query(f"WITH RECURSIVE {MATCHED} SELECT matched_invoice AS invoice_id, account_id, txn_id, amount FROM r JOIN o ON o.id = matched_invoice")
def settle_payments(t: Tables) -> DataFrame:
    return billing.settled(coded_invoices(t), billing.reconcile(t.transfer, coded_invoices(t)))[1]


DELTA = "SELECT id + CASE WHEN id % 2 = 0 THEN 0 ELSE 1000000000 END AS id, plan_code, amount + 1 AS amount FROM v_invoice WHERE organization_id = 2"
INVOICE3 = ["id", "plan_code", "amount"]


def invoice_delta(t: Tables) -> DataFrame:
    rows = t.invoice.where("organization_id = 2")
    return rows.select((F.col("id") + F.when(F.col("id") % 2 == 0, 0).otherwise(1_000_000_000)).alias("id"), "plan_code", (F.col("amount") + 1).cast("decimal(12,2)").alias("amount"))


@query(f"WITH d AS ({DELTA}) SELECT id, plan_code, cast(amount AS decimal(12,2)) AS amount FROM d UNION ALL SELECT id, plan_code, amount FROM v_invoice WHERE id NOT IN (SELECT id FROM d)")
def upsert_merge(t: Tables) -> DataFrame:
    return sinks.upsert(t.invoice.select(*INVOICE3), invoice_delta(t), ["id"])


@query(f"WITH d AS ({DELTA}) SELECT id, plan_code, amount FROM v_invoice UNION ALL SELECT id, plan_code, cast(amount AS decimal(12,2)) AS amount FROM d WHERE id NOT IN (SELECT id FROM v_invoice)")
def insert_ignore(t: Tables) -> DataFrame:
    return sinks.insert_ignore(t.invoice.select(*INVOICE3), invoice_delta(t), ["id"])


@query("SELECT id, CASE WHEN status = 'pending' AND account_id % 2 = 0 THEN 'void' ELSE status END AS status, CASE WHEN status = 'pending' AND account_id % 2 = 0 THEN cast(0 AS decimal(12,2)) ELSE amount END AS amount FROM v_invoice")
def update_rewrite(t: Tables) -> DataFrame:
    return sinks.update(t.invoice.select("id", "status", "amount", "account_id"), F.expr("status = 'pending' AND account_id % 2 = 0"), {"status": F.lit("void"), "amount": F.lit(0)}).drop("account_id")


@query("SELECT id, conversation_id, role FROM v_message WHERE conversation_id NOT IN (SELECT id FROM v_conversation WHERE status = 'closed')")
def cascade_delete(t: Tables) -> DataFrame:
    convs = t.conversation
    return sinks.delete_cascade(convs, t.message.select("id", "conversation_id", "role"), convs.where("status = 'closed'"), "conversation_id")[1]


@query("""WITH k AS (SELECT DISTINCT p_type AS name FROM part), p AS (SELECT p_type AS name, min(p_brand) AS value FROM part WHERE p_type LIKE '%M%' GROUP BY 1), t AS (SELECT p_type AS name, max(p_brand) AS value FROM part WHERE p_type LIKE 'E%' GROUP BY 1)
  SELECT name, coalesce(p.value, t.value, CASE WHEN name = 'SMALL' THEN 'fallback' END) AS value, CASE WHEN p.value IS NOT NULL THEN 'platform' WHEN t.value IS NOT NULL THEN 'tenant' ELSE 'default' END AS origin FROM k LEFT JOIN p USING (name) LEFT JOIN t USING (name)""")
def config_precedence(t: Tables) -> DataFrame:
    part = t.raw("part")
    at = lambda like, f: part.where(F.col("p_type").like(like)).groupBy(F.col("p_type").alias("name")).agg(f("p_brand").alias("value"))
    return billing.resolve_config(part.select(F.col("p_type").alias("name")).distinct(), at("%M%", F.min), at("E%", F.max), True, {"SMALL": "fallback"})


@query("""SELECT id, CASE WHEN list_contains(json_keys(meta), 'intent') THEN meta WHEN meta = '{}' THEN '{"intent":0}' ELSE left(meta, length(meta) - 1) || ',"intent":0}' END AS meta FROM v_message""")
def json_defaults(t: Tables) -> DataFrame:
    """Message metadata, with a default where the key is not there."""
    return billing.with_default_limits(t.message, {"intent": 0}, "meta").select("id", "meta")


@query(f"SELECT id, organization_id, kind FROM v_usage_event WHERE organization_id = {ORG}")
def tenant_isolation(t: Tables) -> DataFrame:
    return TenantContext(ORG).visible(t.usage_event).select("id", "organization_id", "kind")


@query("SELECT id, organization_id, kind FROM v_usage_event")
def superuser_view(t: Tables) -> DataFrame:
    """What a platform administrator sees: every tenant's rows."""
    return TenantContext(admin=True).visible(t.usage_event).select("id", "organization_id", "kind")


@query("SELECT id, kind, CASE WHEN bot_id IN (SELECT id FROM v_bot WHERE shop_id < 5) THEN NULL ELSE bot_id END AS bot_id FROM v_channel")
def set_null(t: Tables) -> DataFrame:
    """Channels after some bots are gone: they stay, without a bot."""
    return sinks.set_null(t.channel.select("id", "kind", "bot_id"), t.bot.where("shop_id < 5").select("id"), "bot_id")


@query("SELECT id, role, coalesce(CASE role WHEN 'viewer' THEN 0 WHEN 'agent' THEN 1 WHEN 'admin' THEN 2 WHEN 'owner' THEN 3 END, -1) >= 1 AS may_reply FROM v_account")
def rbac_rank(t: Tables) -> DataFrame:
    return t.account.select("id", "role", at_least(F.col("role"), "agent").alias("may_reply"))


@query(f"""WITH e AS ({ENTITLED}), d AS (SELECT id, id % 150 AS account_id, row_number() OVER (PARTITION BY id % 150 ORDER BY id) * 5 AS nth, octet_length(encode(content)) * 2048 AS bytes FROM v_document)
  SELECT d.id, d.account_id, CASE WHEN knowledge_docs > 0 AND nth > knowledge_docs THEN 'count' WHEN bytes > least(25, 10) * 1048576 THEN 'size' END AS blocked FROM d JOIN e USING (account_id)""")
def ingest_limits(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    docs = t.document.select("id", (F.col("id") % 150).alias("account_id"), (F.octet_length("content").cast("long") * 2048).alias("bytes"))
    docs = docs.withColumn("nth", F.row_number().over(Window.partitionBy("account_id").orderBy("id")) * 5)
    return ingest.blocked(docs, entitled(t).select("account_id", "knowledge_docs", "max_file_mb")).select("id", "account_id", "blocked")
