"""Webhook payloads of four chat platforms and of bank transfers as canonical event rows, for batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Payload schemas; every value that may come as number or text is read as text.
META = "object string, entry array<struct<id: string, messaging: array<struct<sender: struct<id: string>, timestamp: string, message: struct<text: string>>>>>"
TELEGRAM_MESSAGE = "struct<chat: struct<id: string>, text: string, date: string, from: struct<first_name: string, last_name: string, username: string>>"
TELEGRAM = f"message {TELEGRAM_MESSAGE}, edited_message {TELEGRAM_MESSAGE}"
WHATSAPP = "entry array<struct<changes: array<struct<value: struct<metadata: struct<phone_number_id: string>, contacts: array<struct<wa_id: string, profile: struct<name: string>>>, messages: array<struct<`from`: string, timestamp: string, text: struct<body: string>>>>>>>>"
ZALO = "event_name string, recipient struct<id: string>, sender struct<id: string>, message struct<text: string>, timestamp string"
TRANSFER = "id long, gateway string, accountNumber string, transferType string, transferAmount double, content string, description string, referenceCode string"
EVENT = ["kind", "route_key", "customer_ref", "text", "customer_name", "event_ts"]


def _has(c: str) -> Column:
    return F.length(F.coalesce(F.col(c), F.lit(""))) > 0


def _seconds(ms: Column) -> Column:
    return ms.try_cast("double") / 1000


def meta(raw: DataFrame) -> DataFrame:
    e = raw.select(F.explode(F.from_json("payload", META)["entry"]).alias("e")).select("e.id", F.explode("e.messaging").alias("m"))
    rows = e.select(F.lit("meta").alias("kind"), F.coalesce("id", F.lit("")).alias("route_key"), F.col("m.sender.id").alias("customer_ref"), F.col("m.message.text").alias("text"), F.lit(None).cast("string").alias("customer_name"), _seconds(F.col("m.timestamp")).alias("event_ts"))
    return rows.where(_has("customer_ref") & _has("text"))


def telegram(raw: DataFrame) -> DataFrame:
    m = raw.select(F.col("route_key") if "route_key" in raw.columns else F.lit(None).cast("string").alias("route_key"), F.from_json("payload", TELEGRAM).alias("p")).select("route_key", F.coalesce("p.message", "p.edited_message").alias("m"))
    full = F.trim(F.concat_ws(" ", F.nullif(F.col("m.from.first_name"), F.lit("")), F.nullif(F.col("m.from.last_name"), F.lit(""))))
    name = F.coalesce(F.nullif(full, F.lit("")), F.concat(F.lit("@"), F.nullif(F.col("m.from.username"), F.lit(""))))
    rows = m.select(F.lit("telegram").alias("kind"), "route_key", F.col("m.chat.id").alias("customer_ref"), F.col("m.text").alias("text"), name.alias("customer_name"), F.col("m.date").try_cast("double").alias("event_ts"))
    return rows.where(F.col("customer_ref").isNotNull() & _has("text"))


def whatsapp(raw: DataFrame) -> DataFrame:
    v = raw.select(F.explode(F.from_json("payload", WHATSAPP)["entry"]).alias("e")).select(F.explode("e.changes").alias("c")).select("c.value.*").select(F.col("metadata.phone_number_id").alias("route_key"), "contacts", F.explode("messages").alias("m"))
    name = F.get(F.filter("contacts", lambda c: c["wa_id"] == F.col("m.from")), F.lit(0))["profile"]["name"]
    rows = v.select(F.lit("whatsapp").alias("kind"), "route_key", F.col("m.from").alias("customer_ref"), F.col("m.text.body").alias("text"), F.coalesce(name, F.lit("")).alias("customer_name"), F.col("m.timestamp").try_cast("double").alias("event_ts"))
    return rows.where(_has("route_key") & _has("customer_ref") & _has("text"))


def zalo(raw: DataFrame) -> DataFrame:
    p = raw.select(F.from_json("payload", ZALO).alias("p")).where("p.event_name = 'user_send_text'")
    rows = p.select(F.lit("zalo").alias("kind"), F.col("p.recipient.id").alias("route_key"), F.col("p.sender.id").alias("customer_ref"), F.col("p.message.text").alias("text"), F.lit(None).cast("string").alias("customer_name"), _seconds(F.col("p.timestamp")).alias("event_ts"))
    return rows.where(_has("customer_ref") & _has("text"))


NORMALISERS = {"meta": meta, "telegram": telegram, "whatsapp": whatsapp, "zalo": zalo}


def normalised(raw: DataFrame) -> DataFrame:
    """Event rows of raw (kind, payload); payloads that are no JSON or lack sender or text give none."""
    out = None
    for kind, read in NORMALISERS.items():
        rows = read(raw.where(F.col("kind") == kind))
        out = rows if out is None else out.unionByName(rows)
    return out.select(*EVENT)


def transfers(raw: DataFrame) -> DataFrame:
    """Bank transfers of raw (body, and row_id and created_at if there): JSON objects, else form bodies, else an empty row; never an error."""
    form = lambda k: F.nullif(F.try_url_decode(F.regexp_replace(F.regexp_extract("body", rf"(?:^|&){k}=([^&]*)", 1), r"\+", " ")), F.lit(""))
    json = F.from_json("body", TRANSFER)
    is_json = F.coalesce(F.trim("body"), F.lit("")).startswith("{")
    either = lambda k, kind="string": F.when(is_json, F.col(f"j.{k}")).otherwise(form(k).try_cast(kind))
    rows = raw.withColumn("j", json)
    return rows.select(
        *(c for c in ("row_id", "created_at") if c in raw.columns), either("id", "long").alias("txn_id"), F.coalesce(either("transferAmount", "double"), F.lit(0.0)).alias("amount"), F.coalesce(F.nullif(either("content"), F.lit("")), either("description"), F.lit("")).alias("memo"),
        F.lower(F.coalesce(either("transferType"), F.lit(""))).alias("transfer_type"), F.coalesce(either("gateway"), F.lit("")).alias("gateway"), F.coalesce(either("accountNumber"), F.lit("")).alias("account"), F.coalesce(either("referenceCode"), F.lit("")).alias("reference"),
    )
