"""The logical tables of the domain over the raw test tables, as one text for Spark and for DuckDB."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

AS_OF = datetime(2024, 1, 20, 12)
INVOICES_AS_OF = datetime(2001, 7, 20)
#: Memos name invoices by the code of their id and this number.
CODE_BASE = 900_000_000
BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Spark:
    ts = staticmethod(lambda s: f"timestamp_ntz'{s}'")
    json = staticmethod(lambda c, k: f"get_json_object({c}, '$.{k}')")
    days = staticmethod(lambda n: f"make_dt_interval({n})")
    hours = staticmethod(lambda n: f"make_dt_interval(0, {n})")
    minutes = staticmethod(lambda n: f"make_dt_interval(0, 0, {n})")
    code = staticmethod(lambda c: f"format_string('%08X', {c})")
    text = "string"


class Duck:
    ts = staticmethod(lambda s: f"timestamp '{s}'")
    json = staticmethod(lambda c, k: f"json_extract_string({c}, '$.{k}')")
    days = staticmethod(lambda n: f"to_days(cast({n} as integer))")
    hours = staticmethod(lambda n: f"to_hours({n})")
    minutes = staticmethod(lambda n: f"to_minutes({n})")
    code = staticmethod(lambda c: f"format('{{:08X}}', {c})")
    text = "varchar"


PLANS = """(VALUES
  ('free', 'Free', cast(0 as decimal(10,2)), '{"llm_mode":"byok","billing_mode":"subscription","ai_messages_month":200,"channels_allowed":["website"],"knowledge_docs":20}'),
  ('starter', 'Starter', cast(19 as decimal(10,2)), '{"llm_mode":"byok","billing_mode":"subscription","ai_messages_month":20000,"channels_allowed":["website","telegram"],"knowledge_docs":200}'),
  ('growth', 'Growth', cast(99 as decimal(10,2)), '{"llm_mode":"managed","billing_mode":"subscription","ai_tokens_month":5000000,"overage_per_1k":0.02,"channels_allowed":["website","telegram","whatsapp"],"knowledge_docs":2000}'),
  ('payg', 'Pay as you go', cast(0 as decimal(10,2)), '{"llm_mode":"managed","billing_mode":"payg","payg_per_1k":0.03,"channels_allowed":["website","telegram","whatsapp"]}'),
  ('trial', 'Trial', cast(5 as decimal(10,2)), '{"llm_mode":"managed","billing_mode":"subscription","ai_tokens_month":1000}')
) AS p(code, name, price_month, entitlements)"""


def _tables(d) -> dict[str, str]:
    k = f"cast({d.json('props', 'k')} as integer)"
    ai = "event_type IN ('click', 'view', 'purchase')"
    return {
        "organization": "SELECT r_regionkey AS id, r_name AS name, CASE WHEN r_regionkey = 4 THEN 'suspended' ELSE 'active' END AS status FROM region",
        "shop": "SELECT n_nationkey AS id, n_regionkey AS organization_id, n_name AS name FROM nation",
        "usage_event": f"""SELECT event_id AS id, cast(user_id % 5 as integer) AS organization_id, cast(user_id % 25 as integer) AS shop_id,
  CASE WHEN event_id % 10 <> 0 THEN 'c' || cast(user_id as {d.text}) END AS customer_ref, CASE WHEN {ai} THEN 'ai_message' ELSE 'embedding' END AS kind,
  CASE {k} % 4 WHEN 0 THEN 'small' WHEN 1 THEN '' WHEN 2 THEN 'large' END AS llm_model, CASE WHEN {ai} THEN 10 * {k} ELSE 0 END AS input_tokens, CASE WHEN {ai} THEN {k} ELSE 0 END AS output_tokens,
  CASE WHEN {ai} THEN 0 ELSE 7 * {k} END AS embedding_tokens, cast(floor(value) as integer) AS latency_ms,
  cast(cast(75 * {k} as decimal(12,0)) * cast(0.000001 as decimal(7,6)) as decimal(12,6)) AS estimated_cost, ts AS created_at
  FROM events""",
        "invoice": f"""SELECT o_orderkey AS id, cast(o_custkey % 5 as integer) AS organization_id, o_custkey AS account_id, CASE o_orderkey % 3 WHEN 0 THEN 'starter' WHEN 1 THEN 'growth' ELSE 'payg' END AS plan_code,
  cast(o_totalprice as decimal(12,2)) AS amount, CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'pending' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'submitted' ELSE 'void' END END AS status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'card' WHEN '2-HIGH' THEN 'wallet' WHEN '3-MEDIUM' THEN 'gateway' WHEN '4-NOT SPECIFIED' THEN 'admin_manual' ELSE 'bank' END AS provider,
  o_orderdate AS created_at, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate + {d.days(1)} END AS paid_at FROM orders""",
        "plan": f"SELECT * FROM {PLANS}",
        "account": f"SELECT c_custkey AS id, c_name AS name, cast(c_custkey % 5 as integer) AS organization_id, 'a' || cast(c_custkey as {d.text}) || '@example.com' AS email, CASE c_custkey % 5 WHEN 0 THEN 'viewer' WHEN 1 THEN 'agent' WHEN 2 THEN 'admin' WHEN 3 THEN 'owner' ELSE 'guest' END AS role FROM customer",
        "subscription": f"""SELECT c_custkey AS account_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'free' WHEN 'AUTOMOBILE' THEN 'starter' WHEN 'MACHINERY' THEN 'growth' WHEN 'HOUSEHOLD' THEN 'payg' ELSE 'trial' END AS plan_code,
  CASE WHEN c_custkey % 9 = 0 THEN 'canceled' ELSE 'active' END AS status, CASE WHEN c_custkey % 5 <> 0 THEN {d.ts(AS_OF)} + {d.hours("(c_custkey % 50 - 15) * 17")} END AS current_period_end
  FROM customer WHERE c_custkey % 7 <> 0""",
        "product": f"""SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 6 <> 0 THEN p_brand || ' ' || p_type END AS description, CASE WHEN p_partkey % 8 <> 0 THEN 'SKU-' || cast(p_partkey as {d.text}) END AS sku,
  cast(p_retailprice as decimal(12,2)) AS price, p_size AS size, cast(p_partkey % 25 as integer) AS shop_id FROM part""",
        "product_variant": f"SELECT l_partkey AS product_id, 'v' || cast(l_orderkey as {d.text}) || '-' || cast(l_linenumber as {d.text}) AS name, cast(l_extendedprice as decimal(12,2)) AS price, cast(l_quantity as integer) AS stock FROM lineitem",
        "conversation": f"""SELECT conv_id AS id, cast(conv_id % 25 as integer) AS shop_id, cast(conv_id % 4 as integer) AS channel_id, 'u' || cast(conv_id % 30 as {d.text}) AS customer_ref, CASE WHEN conv_id % 3 <> 0 THEN 'Name ' || cast(conv_id as {d.text}) END AS customer_name,
  CASE conv_id % 5 WHEN 0 THEN 'needs_human' WHEN 1 THEN 'human' WHEN 2 THEN 'closed' ELSE 'ai' END AS status, {d.ts("2024-01-01 00:00:00")} + {d.hours("conv_id")} AS created_at, CASE WHEN conv_id % 4 = 0 THEN conv_id % 40 END AS assigned_user_id
  FROM (SELECT DISTINCT conv_id FROM conversations) AS c""",
        "message": f"""SELECT conv_id * 1000 + turn AS id, conv_id AS conversation_id, CASE role WHEN 'user' THEN 'customer' WHEN 'assistant' THEN 'ai' ELSE 'agent' END AS role, text AS content,
  {d.ts("2024-01-01 00:00:00")} + {d.hours("conv_id")} + {d.minutes("turn")} AS created_at, CASE WHEN turn % 4 = 3 THEN '{{}}' ELSE '{{"intent":"' || CASE turn % 3 WHEN 0 THEN 'order' WHEN 1 THEN 'product' ELSE 'knowledge' END || '"}}' END AS meta
  FROM conversations""",
        "channel": f"""SELECT s_suppkey AS id, s_name AS name, cast(s_nationkey as integer) AS shop_id, CASE s_suppkey % 4 WHEN 0 THEN 'website' WHEN 1 THEN 'telegram' WHEN 2 THEN 'whatsapp' ELSE 'messenger' END AS kind,
  CASE WHEN s_suppkey % 3 = 0 THEN 'degraded' ELSE 'connected' END AS status, '{{"page_id":"pg' || cast(s_suppkey as {d.text}) || '","phone_id":"ph' || cast(s_suppkey % 17 as {d.text}) || '"}}' AS config, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 25 END AS bot_id FROM supplier""",
        "bot": "SELECT n_nationkey AS id, cast(n_nationkey % 10 as integer) AS shop_id, n_name AS name FROM nation",
        "document": f"""SELECT d.doc_id AS id, cast(d.doc_id % 25 as integer) AS shop_id, 'Doc ' || cast(d.doc_id as {d.text}) AS title, d.text AS content, d.source AS source, coalesce(l.quality = 1, true) AS active, CASE WHEN d.doc_id % 3 <> 0 THEN cast(d.doc_id % 10 as integer) END AS bot_id
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
        "vector": "SELECT vec_id AS id, CASE WHEN vec_id % 17 <> 0 THEN embedding END AS embedding, nullif(label, 0) AS bot_id, cast(vec_id % 25 as integer) AS shop_id, vec_id % 11 <> 0 AS active FROM embeddings",
        "transfer": f"""SELECT o_orderkey - o_orderkey % 20 % 3 AS txn_id, o_orderkey AS row_id, cast(o_totalprice as decimal(12,2)) AS amount, CASE o_orderkey % 7 WHEN 0 THEN 'out' WHEN 1 THEN '' ELSE 'in' END AS transfer_type,
  CASE WHEN o_orderkey % 5 = 0 THEN 'thanks ' || o_orderpriority ELSE 'pay ' || CASE WHEN o_orderkey % 2 = 0 THEN 'qr-' ELSE 'INV ' END || {d.code('o_orderkey + ' + str(CODE_BASE))} || '.ref' || CASE WHEN o_orderkey % 6 = 2 THEN ' or INV ' || {d.code('o_orderkey - 2 + ' + str(CODE_BASE))} ELSE '' END END AS memo, o_orderdate AS created_at FROM orders""",
    }


def logical(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A logical table; only the raw tables that it names are opened."""
    sql = _tables(Spark)[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE if re.search(rf"\b(FROM|JOIN) {t}\b", sql)}
    if not used:
        return spark.sql(sql)
    escaped = sql.replace("{", "{{").replace("}", "}}")
    for t in used:
        escaped = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", escaped)
    return spark.sql(escaped, **used)


def duck(sql: str) -> str:
    """The oracle's text with the logical tables that it names in front."""
    texts = _tables(Duck)
    used = [t for t in texts if re.search(rf"\bv_{t}\b", sql)]
    with_ = ", ".join(f"v_{t} AS ({texts[t]})" for t in used)
    body = sql.strip()
    if with_ and body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {with_}, {body[15:]}"
    if with_ and body[:5].upper() == "WITH ":
        return f"WITH {with_}, {body[5:]}"
    return f"WITH {with_} {body}" if with_ else body
