"""Lookup, retrieval, ingestion and event queries."""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.functions.scalars import estimated_tokens
from tradewind.functions.text import DIM, bound, bucket, cosine, fitted, tokens, vector_text
from tradewind.operators import cells, conversations, ingest, lookups, retrieval
from tradewind.operators.scans import first_hit_windows
from tradewind.plans.catalog import Tables, query
from tradewind.plans.office import OFFICE
from tradewind.functions.signatures import callback_signed, hmac_sha256, hmac_sha512, sorted_query, timed_signed, webhook_signed
from tradewind.sources import readers, sinks, webhooks
from tradewind.sources.shared import scratch, staged
from tradewind.streaming import events

#: Fixed queries of the lookups.
WORDS = r"[\p{L}\p{N}]+"
SEQUENCE = "flatten(list_transform(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))"
BUCKET = "cast(cast('0x' || substr(md5({0}), 1, 16) AS ubigint) % 384 AS integer)"
SPARSE = "SELECT id, bucket, n / sqrt(cast(sum(n * n) OVER (PARTITION BY id) AS double)) AS weight FROM (SELECT id, " + BUCKET.format("tok") + " AS bucket, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(lower({1}), '" + WORDS.replace("{", "{{").replace("}", "}}") + "')) AS tok FROM {0}) AS t GROUP BY 1, 2) AS c"
#: Searches are asked for every hundredth benchmark item, against all rows.
ASKED = "SELECT item_id AS id, text FROM benchmark WHERE item_id % 100 = 0"
PRODUCT_TEXT = "coalesce(name, '') || ' ' || coalesce(description, '') || ' ' || coalesce(sku, '')"


def asked(t: Tables) -> DataFrame:
    return t.raw("benchmark").where("item_id % 100 = 0").select(F.col("item_id").alias("id"), "text")


def product_items(t: Tables) -> DataFrame:
    """Products as lexical items; benchmark words are no product words, so product queries are names of every hundredth product."""
    return t.product.select("id", F.expr(PRODUCT_TEXT).alias("text"))


def product_queries(t: Tables) -> DataFrame:
    return t.product.where("id % 100 = 0").select("id", F.concat_ws(" ", "name", "sku").alias("text"))


PRODUCT_QUERIES = "SELECT id, concat_ws(' ', name, sku) AS text FROM v_product WHERE id % 100 = 0"

# --- lookups ---------------------------------------------------------------------------------------------------


@query("SELECT id, name, cast(price * 2 AS decimal(14,2)) AS double_price FROM v_product WHERE price > 950 AND size BETWEEN 5 AND 15")
def scan_project_filter(t: Tables) -> DataFrame:
    return t.product.where((F.col("price") > 950) & F.col("size").between(5, 15)).select("id", "name", (F.col("price") * 2).cast("decimal(14,2)").alias("double_price"))


@query("SELECT id, name, kind FROM v_channel WHERE id = 7")
def point_lookup(t: Tables) -> DataFrame:
    return t.channel.where("id = 7").select("id", "name", "kind")


@query("SELECT id, name FROM v_product p WHERE EXISTS (SELECT 1 FROM v_product_variant v WHERE v.product_id = p.id AND stock >= 49) AND NOT EXISTS (SELECT 1 FROM v_product_variant v WHERE v.product_id = p.id AND stock = 1)")
def semi_exists(t: Tables) -> DataFrame:
    v = t.product_variant.withColumnRenamed("product_id", "id").select("id", "stock")
    return t.product.select("id", "name").join(v.where("stock >= 49"), "id", "left_semi").join(v.where("stock = 1"), "id", "left_anti")


@query("SELECT id, kind FROM v_channel WHERE json_extract_string(config, '$.phone_id') = 'ph3'")
def route_by_json_key(t: Tables) -> DataFrame:
    return lookups.by_json_key(t.channel, "config", "phone_id", "ph3").select("id", "kind")


@query("SELECT id, name FROM v_account WHERE lower(name) LIKE '%r#0000000_1%'")
def tenant_search(t: Tables) -> DataFrame:
    return lookups.search_like(t.account, "name", " R#0000000_1 ").select("id", "name")


@query("SELECT id, name, sku FROM v_product WHERE contains(lower(name), 'blue') OR contains(lower(coalesce(sku, '')), 'blue')")
def product_search(t: Tables) -> DataFrame:
    return lookups.search_either(t.product, ["name", "sku"], "Blue").select("id", "name", "sku")


@query("SELECT id, role, content, created_at FROM (SELECT * FROM v_message WHERE conversation_id = 3 AND created_at < timestamp '2024-01-01 03:04:00' ORDER BY created_at DESC, id DESC LIMIT 3) AS x")
def keyset_page(t: Tables) -> DataFrame:
    from datetime import datetime

    return lookups.keyset_page(t.message, 3, 3, datetime(2024, 1, 1, 3, 4)).select("id", "role", "content", "created_at")


@query("SELECT id, name, (SELECT count(*) FROM v_product) AS total, (SELECT count(*) FROM v_product) > 120 AS has_more FROM v_product ORDER BY name, id LIMIT 20 OFFSET 100")
def offset_page(t: Tables) -> DataFrame:
    return lookups.offset_page(t.product.select("id", "name"), ["name", "id"], 20, 100)


@query("SELECT d.id, title, source, active, s.name AS shop, length(content) AS char_count, (SELECT count(*) FROM v_message m WHERE m.conversation_id = d.id) AS mentions FROM v_document d JOIN v_shop s ON s.id = d.shop_id")
def document_listing(t: Tables) -> DataFrame:
    mentions = t.message.groupBy(F.col("conversation_id").alias("id")).agg(F.count("*").alias("mentions"))
    rows = t.document.join(t.shop.select(F.col("id").alias("shop_id"), F.col("name").alias("shop")), "shop_id").join(mentions, "id", "left")
    return rows.select("id", "title", "source", "active", "shop", F.length("content").cast("long").alias("char_count"), F.coalesce("mentions", F.lit(0)).alias("mentions"))


@query("""SELECT c.id, c.customer_ref, c.customer_name, c.status, a.email AS assignee, ch.kind AS channel_kind, m.n AS messages, m.last_message, m.last_at FROM v_conversation c
  LEFT JOIN (SELECT conversation_id, count(*) AS n, arg_max(content, id) AS last_message, max(created_at) AS last_at FROM v_message GROUP BY 1) m ON m.conversation_id = c.id
  LEFT JOIN v_account a ON a.id = c.assigned_user_id LEFT JOIN v_channel ch ON ch.id = c.channel_id""")
def inbox_listing(t: Tables) -> DataFrame:
    return lookups.inbox(t.conversation, t.message, t.account, t.channel)


@query("SELECT a.id, email, role, o.name AS organization FROM v_account a JOIN v_organization o ON o.id = a.organization_id WHERE role <> 'guest'")
def member_roster(t: Tables) -> DataFrame:
    orgs = t.organization.select(F.col("id").alias("organization_id"), F.col("name").alias("organization"))
    return t.account.where("role <> 'guest'").join(orgs, "organization_id").select("id", "email", "role", "organization")


@query("SELECT c.id, c.name, kind, c.status, b.name AS bot FROM v_channel c LEFT JOIN v_bot b ON b.id = c.bot_id")
def channel_listing(t: Tables) -> DataFrame:
    return t.channel.join(t.bot.select(F.col("id").alias("bot_id"), F.col("name").alias("bot")), "bot_id", "left").select("id", "name", "kind", "status", "bot")


@query("SELECT p.id, p.name, string_agg(v.name || ':' || v.stock, ',' ORDER BY v.name, v.stock) AS variants FROM v_product p LEFT JOIN v_product_variant v ON v.product_id = p.id GROUP BY 1, 2")
def product_with_variants(t: Tables) -> DataFrame:
    rows = lookups.products_with_variants(t.product, t.product_variant)
    return rows.select("id", "name", F.array_join(F.transform("variants", lambda v: F.concat(v["name"], F.lit(":"), v["stock"].cast("string"))), ",").alias("variants"))


@query("SELECT product_id, cast(sum(stock) AS bigint) AS stock FROM v_product_variant GROUP BY 1")
def stock_total(t: Tables) -> DataFrame:
    return t.product_variant.groupBy("product_id").agg(F.sum("stock").cast("long").alias("stock"))


# --- retrieval -------------------------------------------------------------------------------------------------


@query(f"SELECT id, len(regexp_extract_all(lower(content), '{WORDS}')) AS n_tokens, array_to_string(regexp_extract_all(lower(content), '{WORDS}'), ' ') AS tokens FROM v_document")
def tokenise(t: Tables) -> DataFrame:
    found = tokens(F.col("content"))
    return t.document.select("id", F.size(found).cast("long").alias("n_tokens"), F.array_join(found, " ").alias("tokens"))


@query(f"SELECT tok AS token, {BUCKET.format('tok')} AS bucket, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(content), '{WORDS}')) AS tok FROM v_document) AS t GROUP BY 1, 2")
def hash_buckets(t: Tables) -> DataFrame:
    return t.document.select(F.explode(tokens(F.col("content"))).alias("token")).groupBy("token").agg(F.count("*").alias("n")).select("token", bucket(F.col("token")).alias("bucket"), "n")


@query(f"SELECT id, bucket, round(weight, 6) AS weight FROM ({SPARSE.format('v_document', 'content')}) AS s")
def hash_embedding(t: Tables) -> DataFrame:
    return retrieval.hash_embedding(t.document, "id", "content").withColumn("weight", F.round("weight", 6))


@query("""WITH e AS (SELECT id, list_transform(list_concat(embedding, list_transform(range(320), lambda i: 0::FLOAT)), lambda x: cast(x AS double)) AS v FROM v_vector WHERE embedding IS NOT NULL), n AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e)
  SELECT id, list_sum(list_transform(v, lambda x: round(x / n, 6)))::double AS total, round(v[1] / n, 6) AS first, round(v[384] / n, 6) AS last FROM n""")
def embedding_fit(t: Tables) -> DataFrame:
    said = lambda v: F.struct(F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("total"), v[0].alias("first"), v[DIM - 1].alias("last"))
    return t.vector.where("embedding IS NOT NULL").select("id", bound(fitted(F.col("embedding"), DIM), said).alias("s")).select("id", "s.*")


@query("SELECT id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.6f', cast(x AS double))), ',') || ']' AS text FROM v_vector")
def embedding_text(t: Tables) -> DataFrame:
    return t.vector.select("id", vector_text(F.col("embedding")).alias("text"))


@query("SELECT v.id, round(list_cosine_similarity(cast(v.embedding AS double[]), cast(o.embedding AS double[])), 6) AS score FROM v_vector v, v_vector o WHERE o.id = 1 AND v.embedding IS NOT NULL")
def cosine_score(t: Tables) -> DataFrame:
    """Every vector against one."""
    one = t.vector.where("id = 1").select(F.col("embedding").alias("other"))
    rows = t.vector.where("embedding IS NOT NULL").crossJoin(F.broadcast(one))  # one row
    return rows.select("id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("score"))


DENSE = """SELECT q.id AS query, v.id AS id, list_cosine_similarity(cast(q.embedding AS double[]), cast(v.embedding AS double[])) AS score FROM v_vector q, v_vector v WHERE q.id % 100 = 0 AND q.embedding IS NOT NULL AND v.embedding IS NOT NULL"""
TOP = "SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) - 1 AS rank FROM ({0}) AS s{1} QUALIFY rank < {2}"


@query(f"SELECT query, id, round(score, 6) AS score, cast(rank AS integer) AS rank FROM ({TOP.format(DENSE, '', 20)}) AS x")
def vector_topk(t: Tables) -> DataFrame:
    v = t.vector
    return retrieval.dense_topk(v.where("id % 100 = 0"), v).select("query", "id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@query(f"SELECT query, id, round(score, 6) AS score, cast(rank AS integer) AS rank FROM ({TOP.format(DENSE + ' AND v.shop_id % 5 = 2 AND v.active AND (v.bot_id IS NULL OR v.bot_id = 3)', '', 20)}) AS x")
def scoped_retrieval(t: Tables) -> DataFrame:
    v = t.vector
    scoped = retrieval.in_scope(v.withColumn("shop_id", F.when(F.col("shop_id") % 5 == 2, 2).otherwise(0)), 2, 3)
    return retrieval.dense_topk(v.where("id % 100 = 0"), scoped).select("query", "id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@query(f"SELECT query, id, round(score, 6) AS score, cast(rank AS integer) AS rank FROM ({TOP.format(DENSE, '', 20)}) AS x")
def vector_cells(t: Tables) -> DataFrame:
    """The same by an index of cells, of which only those are read that can hold one of the nearest."""
    index = cells.build(t.vector, scratch(t.spark, "vector-cells"))
    return cells.search(t.spark, index, t.vector.where("id % 100 = 0"))[0].select("query", "id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@query(f"SELECT query, id, round(score, 6) AS score, cast(rank AS integer) AS rank FROM ({TOP.format(DENSE + ' AND v.shop_id % 5 = 2 AND v.active AND (v.bot_id IS NULL OR v.bot_id = 3)', '', 20)}) AS x")
def vector_cells_scoped(t: Tables) -> DataFrame:
    """An index of all shops' rows, filtered inside."""
    index = cells.build(t.vector, scratch(t.spark, "vector-cells"))
    scope = F.expr("shop_id % 5 = 2 AND active AND (bot_id IS NULL OR bot_id = 3)")
    return cells.search(t.spark, index, t.vector.where("id % 100 = 0"), where=scope)[0].select("query", "id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@query(f"""WITH g AS (SELECT id, name, list_distinct({SEQUENCE.format('name')}) AS s FROM v_product), p AS (SELECT q.id AS query, g.id, len(list_intersect(q.s, g.s)) AS n, len(q.s) AS a, len(g.s) AS b FROM g q, g WHERE q.id % 100 = 0),
  x AS (SELECT query, id, n / (a + b - n) AS score FROM p WHERE n > 0) SELECT query, id, round(score, 6) AS score, cast(rank AS integer) AS rank FROM ({TOP.format('SELECT * FROM x', '', 10)}) AS y""")
def trigram_jaccard(t: Tables) -> DataFrame:
    items = t.product.select("id", F.col("name").alias("text"))
    return retrieval.jaccard_topk(items.where("id % 100 = 0"), items, 10).select("query", "id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


#: Word similarity: the best stretch begins and ends on a trigram of the query (h holds those places).
LEXICAL = f"""SELECT query, id, list_max(list_transform(h, lambda i: list_max(list_transform(list_filter(h, lambda j: j >= i), lambda j: len(list_intersect(a, t[i:j])) / len(list_distinct(list_concat(a, t[i:j])))))))::double AS score
  FROM (SELECT *, list_filter(range(1, len(t) + 1), lambda i: list_contains(a, t[i])) AS h FROM (SELECT q.id AS query, p.id AS id, q.a, p.t FROM (SELECT id, list_distinct({SEQUENCE.format('text')}) AS a FROM ({PRODUCT_QUERIES}) AS q0) AS q,
  (SELECT id, {SEQUENCE.format("text")} AS t FROM (SELECT id, {PRODUCT_TEXT} AS text FROM v_product) AS p0) AS p) AS pair) AS placed"""


@query(f"SELECT query, id, round(score, 6) AS score, cast(rank AS integer) AS rank FROM ({TOP.format(LEXICAL, ' WHERE score > 0.1', 20)}) AS x")
def lexical_topk(t: Tables) -> DataFrame:
    return retrieval.lexical_topk(product_queries(t), product_items(t)).select("query", "id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


HYBRID = f"""q AS ({PRODUCT_QUERIES}), p AS (SELECT id, {PRODUCT_TEXT} AS text FROM v_product), qs AS ({SPARSE.format('q', 'text')}), ps AS ({SPARSE.format('p', 'text')}),
  c AS (SELECT qs.id AS query, ps.id AS id, round(sum(qs.weight * ps.weight), 9) AS score FROM qs JOIN ps USING (bucket) GROUP BY 1, 2), d AS ({TOP.format('SELECT * FROM c', '', 20)}), l AS MATERIALIZED ({TOP.format(LEXICAL, ' WHERE score > 0.1', 20)}),
  f AS (SELECT coalesce(d.query, l.query) AS query, coalesce(d.id, l.id) AS id, d.rank AS vr, l.rank AS kr, coalesce(d.score, 0) AS vscore, coalesce(l.score, 0) AS kwscore, l.score IS NOT NULL AS kw, coalesce(1 / (61 + d.rank), 0) + coalesce(1 / (61 + l.rank), 0) AS score FROM d FULL JOIN l ON d.query = l.query AND d.id = l.id),
  h AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vr NULLS LAST, kr NULLS LAST) AS place FROM f QUALIFY place <= 4), g AS (SELECT * FROM h WHERE vscore >= 0.05 OR (kw AND kwscore >= 0.35))"""


def hybrid(t: Tables) -> DataFrame:
    q, p = product_queries(t), product_items(t)
    return retrieval.gated(retrieval.fused(retrieval.hashed_topk(q, p), retrieval.lexical_topk(q, p)))


@query(f"WITH {HYBRID} SELECT query, id, cast(place AS integer) AS place, round(score, 6) AS score, round(vscore, 6) AS vscore, round(kwscore, 6) AS kwscore, kw FROM g")
def hybrid_rrf(t: Tables) -> DataFrame:
    return hybrid(t).select("query", "id", F.col("place").cast("int").alias("place"), F.round("score", 6).alias("score"), F.round("vscore", 6).alias("vscore"), F.round("kwscore", 6).alias("kwscore"), "kw")


@query(f"""WITH {HYBRID}, v AS (SELECT product_id, string_agg(name || '=' || stock, ',' ORDER BY name, stock) AS variants FROM v_product_variant GROUP BY 1)
  SELECT query, g.id, p.name, round(score, 4) AS score, round(vscore, 4) AS vscore, round(kwscore, 4) AS kwscore, p.price, variants FROM g JOIN v_product p ON p.id = g.id LEFT JOIN v ON v.product_id = g.id""")
def rag_response(t: Tables) -> DataFrame:
    rows = hybrid(t).join(lookups.products_with_variants(t.product, t.product_variant).select("id", "name", "price", "variants"), "id")
    listed = F.array_join(F.transform("variants", lambda v: F.concat(v["name"], F.lit("="), v["stock"].cast("string"))), ",")
    return rows.select("query", "id", "name", F.round("score", 4).alias("score"), F.round("vscore", 4).alias("vscore"), F.round("kwscore", 4).alias("kwscore"), "price", listed.alias("variants"))


#: Word similarity of every pair that shares enough: from each trigram of the query on, running counts of different trigrams, the query's and others.
LEXICAL_ROWS = f"""qg AS MATERIALIZED (SELECT id AS query, g, count(*) OVER (PARTITION BY id) AS n FROM (SELECT DISTINCT id, unnest({SEQUENCE.format('text')}) AS g FROM q) AS q1),
  pg AS MATERIALIZED (SELECT id, g, pos, coalesce(lag(pos) OVER (PARTITION BY id, g ORDER BY pos), 0) AS prev FROM (SELECT id, unnest(s) AS g, generate_subscripts(s, 1) AS pos FROM (SELECT id, {SEQUENCE.format('text')} AS s FROM p) AS p1) AS p2),
  near AS MATERIALIZED (SELECT query, id, min(n) AS n FROM qg JOIN (SELECT DISTINCT id, g FROM pg) AS d USING (g) GROUP BY 1, 2 HAVING count(*) > 0.1 * min(n)),
  place AS MATERIALIZED (SELECT a.query, a.id, a.n, pos, prev, qg.g IS NOT NULL AS hit FROM near a JOIN pg ON pg.id = a.id LEFT JOIN qg ON qg.query = a.query AND qg.g = pg.g),
  counts AS (SELECT s.query, s.id, s.n, count(*) FILTER (e.hit AND e.prev < s.pos) OVER w AS m, count(*) FILTER (NOT e.hit AND e.prev < s.pos) OVER w AS x
    FROM place s JOIN place e ON e.query = s.query AND e.id = s.id AND e.pos >= s.pos WHERE s.hit WINDOW w AS (PARTITION BY s.query, s.id, s.pos ORDER BY e.pos)),
  lexical AS MATERIALIZED (SELECT query, id, max(m / (n + x)) AS score FROM counts GROUP BY 1, 2)"""

def chunk_items(t: Tables) -> DataFrame:
    """Chunks of active documents as search items; an id names the document and the chunk's place in it."""
    active = t.document.where("active").withColumn("document_id", F.col("id"))
    rows = ingest.chunk_rows(active, ["document_id", "title"], F.col("content"), separator="\n")
    return rows.select((F.col("document_id") * 1_000_000 + F.col("ordinal")).alias("id"), F.col("content").alias("text"), "title")


def chunk_search(items: DataFrame, asking: DataFrame) -> DataFrame:
    """items (id, text) are read several times, so they should be staged."""
    return retrieval.gated(retrieval.fused(retrieval.hashed_topk(asking, items), retrieval.lexical_topk(asking, items)))


def chunk_hybrid_sql(asking: str) -> str:
    """Needs FOLD before it; ends with g, the hits over the gate."""
    return f"""q AS ({asking}), p AS MATERIALIZED (SELECT document_id * 1000000 + ordinal AS id, chunks.content AS text, title FROM chunks JOIN v_document d ON d.id = document_id WHERE active), {LEXICAL_ROWS},
  qs AS MATERIALIZED ({SPARSE.format('q', 'text')}), ps AS MATERIALIZED ({SPARSE.format('p', 'text')}), c AS (SELECT qs.id AS query, ps.id AS id, round(sum(qs.weight * ps.weight), 9) AS score FROM qs JOIN ps USING (bucket) GROUP BY 1, 2),
  d AS ({TOP.format('SELECT * FROM c', '', 20)}), l AS ({TOP.format('SELECT * FROM lexical', ' WHERE score > 0.1', 20)}),
  f AS (SELECT coalesce(d.query, l.query) AS query, coalesce(d.id, l.id) AS id, d.rank AS vr, l.rank AS kr, coalesce(d.score, 0) AS vscore, coalesce(l.score, 0) AS kwscore, l.score IS NOT NULL AS kw, coalesce(1 / (61 + d.rank), 0) + coalesce(1 / (61 + l.rank), 0) AS score FROM d FULL JOIN l ON d.query = l.query AND d.id = l.id),
  h AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vr NULLS LAST, kr NULLS LAST) AS place FROM f QUALIFY place <= 4), g AS (SELECT * FROM h WHERE vscore >= 0.05 OR (kw AND kwscore >= 0.35))"""


def knowledge_blocks(t: Tables, asking: DataFrame) -> DataFrame:
    """Blocks of retrieved knowledge, after all product blocks."""
    items = staged(chunk_items(t), "knowledge")
    hits = chunk_search(items, asking).select("query", "id", (F.col("place") + 100).alias("place"))
    return hits.join(items, "id").select("query", "place", F.lit("knowledge").alias("source"), "title", F.col("text").alias("body"))


def hybrid_blocks(t: Tables, *more: str) -> DataFrame:
    p = t.product.select("id", *more, F.col("name").alias("title"), F.coalesce("description", F.lit("")).alias("body"))
    return hybrid(t).join(p, "id").select("query", "place", F.lit("product").alias("source"), "title", "body", *more)


@query("""WITH x AS (SELECT product_id, name, name || ' (in stock ' || stock || ', ' || printf('%g', cast(price AS double)) || ')' AS txt FROM v_product_variant), v AS (SELECT product_id, string_agg(txt, ', ' ORDER BY name, txt) AS v FROM x GROUP BY 1)
  SELECT id, 'product' AS source, name AS title, trim('Price ' || printf('%g', cast(price AS double)) || '. ' || coalesce(description, '') || coalesce(' Variants: ' || v || '.', '')) AS body FROM v_product LEFT JOIN v ON product_id = id""")
def product_context(t: Tables) -> DataFrame:
    return retrieval.product_context(t.product, t.product_variant)


@query(f"""WITH {HYBRID}, b AS (SELECT query, list(p.name ORDER BY place) AS n, list(coalesce(p.description, '') ORDER BY place) AS d FROM g JOIN v_product p ON p.id = g.id GROUP BY 1),
  a AS (SELECT q.id AS query, CASE WHEN n IS NULL THEN 'A colleague will get back to you.' ELSE n[1] || ' - ' || d[1] || '.' || CASE WHEN len(n) > 1 THEN ' See also: ' || array_to_string(n[2:3], '; ') || '.' ELSE '' END END AS answer FROM q LEFT JOIN b ON b.query = q.id)
  SELECT *, greatest(1, length(answer) // 4) AS output_tokens FROM a""")
def stub_answer(t: Tables) -> DataFrame:
    return retrieval.stub_answer(product_queries(t).select("id"), hybrid_blocks(t))


# --- ingestion -------------------------------------------------------------------------------------------------

FOLD = r"""lines AS (SELECT id, p, row_number() OVER (PARTITION BY id ORDER BY i) AS i FROM (SELECT id, regexp_replace(unnest(string_split(content, chr(10))), '^\s+|\s+$', '', 'g') AS p, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM v_document) AS l WHERE p <> ''),
  fold AS (SELECT id, cast(0 AS bigint) AS i, '' AS buf, cast(NULL AS varchar) AS done FROM v_document
    UNION ALL SELECT f.id, l.i, CASE WHEN length(buf) + length(p) + 1 <= 800 THEN CASE WHEN buf = '' THEN p ELSE buf || chr(10) || p END ELSE substring(p, 1, 800) END, CASE WHEN length(buf) + length(p) + 1 > 800 AND buf <> '' THEN buf END FROM fold f JOIN lines l ON l.id = f.id AND l.i = f.i + 1),
  pieces AS (SELECT id, i, done AS content FROM fold WHERE done IS NOT NULL UNION ALL SELECT id, max(i) + 1, arg_max(buf, i) FROM fold GROUP BY id HAVING arg_max(buf, i) <> ''),
  chunks AS (SELECT id AS document_id, cast(row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS integer) AS ordinal, content FROM pieces)"""


def fixture_chunks(t: Tables) -> DataFrame:
    """The texts have no blank lines, so their lines are the paragraphs."""
    return ingest.chunked(t.document, separator="\n")


@query(f"WITH RECURSIVE {FOLD} SELECT * FROM chunks")
def chunk_documents(t: Tables) -> DataFrame:
    return fixture_chunks(t)


@query(f"WITH RECURSIVE {FOLD}, {chunk_hybrid_sql(ASKED)} SELECT query, id // 1000000 AS document_id, cast(id % 1000000 AS integer) AS ordinal, cast(place AS integer) AS place, round(score, 6) AS score, round(vscore, 6) AS vscore, round(kwscore, 6) AS kwscore, kw FROM g")
def chunk_hybrid(t: Tables) -> DataFrame:
    """Every hundredth benchmark passage asked of all chunks of active documents, by both rankers."""
    hits = chunk_search(staged(chunk_items(t).select("id", "text"), "chunks"), asked(t))
    return hits.select("query", F.expr("id div 1000000").alias("document_id"), (F.col("id") % 1_000_000).cast("int").alias("ordinal"), F.col("place").cast("int").alias("place"), *(F.round(c, 6).alias(c) for c in ("score", "vscore", "kwscore")), "kw")


@query(f"WITH RECURSIVE {FOLD}, q AS ({ASKED}), p AS MATERIALIZED (SELECT document_id * 1000000 + ordinal AS id, content AS text FROM chunks), {LEXICAL_ROWS} SELECT query, id, round(score, 6) AS score, cast(rank AS integer) AS rank FROM ({TOP.format('SELECT * FROM lexical', ' WHERE score > 0.1', 20)}) AS x")
def chunk_lexical(t: Tables) -> DataFrame:
    """Every hundredth benchmark passage: the chunks, of all documents, that hold most of its trigrams in one stretch."""
    items = fixture_chunks(t).select((F.col("document_id") * 1_000_000 + F.col("ordinal")).alias("id"), F.col("content").alias("text"))
    return retrieval.lexical_topk(asked(t), items).select("query", "id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@query(f"""WITH RECURSIVE {FOLD}, kg AS MATERIALIZED (WITH {chunk_hybrid_sql(PRODUCT_QUERIES)} SELECT g.query, g.place, p.title, p.text FROM g JOIN p USING (id)), pg AS MATERIALIZED (WITH {HYBRID} SELECT g.query, g.place, g.id FROM g),
  b AS (SELECT query, place, 'product' AS source, v.name AS title, coalesce(v.description, '') AS body FROM pg JOIN v_product v ON v.id = pg.id UNION ALL SELECT query, 100 + place, 'knowledge', title, text FROM kg)
  SELECT query, string_agg('- [' || source || '] ' || title || ': ' || body, chr(10) ORDER BY place) AS context FROM b GROUP BY 1""")
def context_union(t: Tables) -> DataFrame:
    """What a question's answer is made from: the product blocks that pass the gate, then the blocks of knowledge that do."""
    return retrieval.rendered(hybrid_blocks(t).unionByName(knowledge_blocks(t, product_queries(t))))


#: The same after lines have been cut into pieces of at most 800 characters.
LOSSLESS = FOLD.replace("lines AS (SELECT id, p, row_number() OVER (PARTITION BY id ORDER BY i) AS i FROM (", "lines AS (SELECT id, substring(p, cast(800 * j + 1 AS integer), 800) AS p, row_number() OVER (PARTITION BY id ORDER BY i, j) AS i FROM (SELECT id, i, p, unnest(range((length(p) - 1) // 800 + 1)) AS j FROM (").replace("AS l WHERE p <> '')", "AS l WHERE p <> '') AS r)")


@query(f"WITH RECURSIVE {LOSSLESS} SELECT * FROM chunks")
def chunk_documents_lossless(t: Tables) -> DataFrame:
    return ingest.chunked(t.document, separator="\n", lossless=True)


@query(f"WITH RECURSIVE {FOLD} SELECT document_id, ordinal, s.id AS base_id FROM chunks JOIN v_document d ON d.id = document_id JOIN v_shop s ON s.id = d.shop_id WHERE d.active AND s.organization_id = 2 AND (d.bot_id IS NULL OR d.bot_id = 3)")
def chunk_scope(t: Tables) -> DataFrame:
    """Chunks by document by knowledge base: a shop stands for a base, its organization for the scope."""
    bases = t.shop.select("id", F.col("organization_id").alias("shop_id"))
    documents = t.document.select("id", F.col("shop_id").alias("base_id"), "bot_id", "active")
    return ingest.scoped_chunks(fixture_chunks(t), documents, bases, 2, 3).select("document_id", "ordinal", "base_id")


@query("SELECT id, role, created_at FROM v_message WHERE conversation_id = 7 AND created_at > timestamp '2024-01-01 07:02:00' ORDER BY created_at, id LIMIT 200")
def poll_messages(t: Tables) -> DataFrame:
    return lookups.poll(t.message, 7, datetime(2024, 1, 1, 7, 2)).select("id", "role", "created_at")


@query(f"WITH RECURSIVE {FOLD} SELECT document_id, left(string_agg(content, chr(10) || chr(10) ORDER BY ordinal), 200000) AS text FROM chunks GROUP BY 1")
def document_text(t: Tables) -> DataFrame:
    return ingest.document_text(fixture_chunks(t))


@query(f"WITH RECURSIVE {FOLD} SELECT document_id, ordinal, greatest(1, length(content) // 4) AS tokens FROM chunks WHERE (document_id + ordinal) % 3 <> 0")
def pending_embeddings(t: Tables) -> DataFrame:
    chunks = fixture_chunks(t)
    index = chunks.where("(document_id + ordinal) % 3 = 0").select("document_id", "ordinal", F.array(F.lit(0.0)).alias("embedding"))
    return ingest.pending(chunks, index).select("document_id", "ordinal", estimated_tokens(F.col("content")).alias("tokens"))


@query(f"WITH RECURSIVE {FOLD} SELECT * FROM chunks WHERE document_id % 10 <> 0 UNION ALL SELECT id, 0, left(upper(title), 800) FROM v_document WHERE id % 10 = 0")
def reindex(t: Tables) -> DataFrame:
    changed = t.document.where("id % 10 = 0").select("id", F.upper("title").alias("content"))
    return ingest.reindexed(fixture_chunks(t), changed)


@query(r"SELECT id, status, error, length(content) AS char_count FROM (SELECT id, CASE WHEN id % 9 = 0 THEN '  ' ELSE content END AS content, CASE WHEN id % 9 = 0 THEN 'error' ELSE 'ready' END AS status, CASE WHEN id % 9 = 0 THEN 'no text found in the file' END AS error FROM v_document) AS d")
def ingest_status(t: Tables) -> DataFrame:
    rows = t.document.withColumn("content", F.when(F.col("id") % 9 == 0, "  ").otherwise(F.col("content")))
    return ingest.with_status(rows).select("id", "status", "error", F.col("char_count").cast("long").alias("char_count"))


@query(r"SELECT id, regexp_replace(content, '^\s+|\s+$', '', 'g') AS text FROM v_document")
def ingest_text(t: Tables) -> DataFrame:
    files = t.document.select("id", F.concat(F.lit("a"), F.col("id").cast("string"), F.lit(".txt")).alias("path"), F.encode("content", "UTF-8").alias("content"))
    return readers.extracted(files).select("id", "text")


@query("""SELECT event_id, '{' || chr(10) || '  "k": ' || json_extract_string(props, '$.k') || chr(10) || '}' AS text FROM events""")
def ingest_json(t: Tables) -> DataFrame:
    return t.raw("events").select("event_id", readers.pretty_json(F.col("props")).alias("text"))


@query()
def html_text(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", readers.text_of_html(F.col("html")).alias("text"))


@query("SELECT id, concat_ws(' ', nullif(name, ''), nullif(description, ''), nullif(sku, ''), 'size:' || size) AS text FROM v_product")
def product_embedding_text(t: Tables) -> DataFrame:
    return t.product.select("id", ingest.product_text(t.product).alias("text"))


# --- events ----------------------------------------------------------------------------------------------------


def payloads(t: Tables, *more: str) -> DataFrame:
    """Webhook bodies of the four platforms, one for each message; every seventh lacks its text."""
    m = t.message.withColumns({"s": (F.unix_timestamp(F.col("created_at").cast("timestamp"))).cast("long"), "u": F.concat(F.lit("u"), F.col("conversation_id").cast("string")), "x": F.when(F.col("id") % 7 != 0, F.col("content")), "k": (F.col("id") % 4).cast("int")})
    ms = (F.col("s") * 1000).cast("string")
    meta = F.to_json(F.struct(F.lit("page").alias("object"), F.array(F.struct(F.lit("p1").alias("id"), F.array(F.struct(F.struct(F.col("u").alias("id")).alias("sender"), ms.alias("timestamp"), F.struct(F.col("x").alias("text")).alias("message"))).alias("messaging"))).alias("entry")))
    telegram = F.to_json(F.struct(F.struct(F.struct(F.col("u").alias("id")).alias("chat"), F.col("x").alias("text"), F.col("s").alias("date"), F.struct(F.lit("Ann").alias("first_name")).alias("from")).alias("message")))
    wa_message = F.struct(F.col("u").alias("from"), F.col("s").cast("string").alias("timestamp"), F.struct(F.col("x").alias("body")).alias("text"))
    wa_value = F.struct(F.struct(F.lit("n1").alias("phone_number_id")).alias("metadata"), F.array(F.struct(F.col("u").alias("wa_id"), F.struct(F.lit("Bo").alias("name")).alias("profile"))).alias("contacts"), F.array(wa_message).alias("messages"))
    whatsapp = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(wa_value.alias("value"))).alias("changes"))).alias("entry")))
    zalo = F.to_json(F.struct(F.lit("user_send_text").alias("event_name"), F.struct(F.lit("o1").alias("id")).alias("recipient"), F.struct(F.col("u").alias("id")).alias("sender"), F.struct(F.col("x").alias("text")).alias("message"), ms.alias("timestamp")))
    kind = F.element_at(F.array(*map(F.lit, ("meta", "telegram", "whatsapp", "zalo"))), F.col("k") + 1)
    return m.select(*more, kind.alias("kind"), F.when(F.col("k") == 0, meta).when(F.col("k") == 1, telegram).when(F.col("k") == 2, whatsapp).otherwise(zalo).alias("payload"))


NORMALISED = """SELECT CASE id % 4 WHEN 0 THEN 'meta' WHEN 1 THEN 'telegram' WHEN 2 THEN 'whatsapp' ELSE 'zalo' END AS kind, CASE id % 4 WHEN 0 THEN 'p1' WHEN 2 THEN 'n1' WHEN 3 THEN 'o1' END AS route_key, 'u' || conversation_id AS customer_ref, content AS text,
  CASE id % 4 WHEN 1 THEN 'Ann' WHEN 2 THEN 'Bo' END AS customer_name, cast(epoch(created_at) AS double) AS event_ts FROM v_message WHERE id % 7 <> 0"""


@query(NORMALISED)
def normalize_events(t: Tables) -> DataFrame:
    return webhooks.normalised(payloads(t))


KEY = "shared secret"
PADS = ["".join(f"\\x{b ^ pad:02X}" for b in KEY.encode().ljust(64, b"\0")) for pad in (0x36, 0x5C)]


@query(f"SELECT id, id % 3 <> 0 AS signed, 'sha256=' || sha256('{PADS[1]}'::BLOB || unhex(sha256('{PADS[0]}'::BLOB || encode(content)))) AS signature FROM v_message")
def webhook_signature(t: Tables) -> DataFrame:
    """Message bodies with their signatures; every third header is wrong and refused."""
    right = F.concat(F.lit("sha256="), hmac_sha256(KEY.encode(), F.col("content")))
    sent = t.message.select("id", "content", right.alias("signature"), F.when(F.col("id") % 3 != 0, right).otherwise(F.lit("sha256=0")).alias("header"))
    return sent.select("id", webhook_signed(KEY, F.col("content"), F.col("header")).alias("signed"), "signature")


@query("SELECT id, id % 3 <> 0 AS timed, id % 4 <> 0 AS redirected, 'a=1+%2A~%2F&b=' || id AS query FROM v_message")
def signed_callbacks(t: Tables) -> DataFrame:
    """Timed signatures of message bodies and HMAC-SHA512 of redirects; every third or fourth one is wrong and refused."""
    at = F.col("id").cast("string")
    timed = F.concat(F.lit("v1="), hmac_sha256(KEY.encode(), F.concat(at, F.lit("."), F.col("content"))), F.lit(",t="), F.when(F.col("id") % 3 == 0, "never").otherwise(at))
    params = F.create_map(F.lit("b"), at, F.lit("a"), F.lit("1 *~/"))
    signature = F.when(F.col("id") % 4 != 0, F.upper(hmac_sha512(KEY.encode(), F.concat(F.lit("a=1+%2A~%2F&b="), at))))
    return t.message.select("id", timed_signed(KEY, F.col("content"), timed).alias("timed"), callback_signed(KEY, params, signature).alias("redirected"), sorted_query(params).alias("query"))


def office_files(t: Tables) -> DataFrame:
    """Documents as files of four kinds: a paragraph, a slide's paragraph or a row for each line, or of an unknown kind."""
    kind = F.element_at(F.array(*map(F.lit, ("docx", "pptx", "xlsx", "dat"))), (F.col("id") % 4 + 1).cast("int"))

    @F.pandas_udf("binary")
    def written(kinds: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([OFFICE[k](text or "") for k, text in zip(kinds, texts, strict=True)])

    return t.document.select("id", F.concat(F.col("id").cast("string"), F.lit("."), kind).alias("path"), written(kind, F.col("content")).alias("content"))


@query(r"""WITH l AS (SELECT id, content, array_to_string(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '\S')), chr(10)) AS lines FROM v_document)
  SELECT id, CASE WHEN id % 4 = 2 THEN '# S' || chr(10) || rtrim(regexp_replace(lines, '\s+$', '')) ELSE regexp_replace(CASE WHEN id % 4 = 3 THEN content ELSE lines END, '^\s+|\s+$', '', 'g') END AS text FROM l""")
def office_text(t: Tables) -> DataFrame:
    return readers.extracted(office_files(t)).select("id", "text")


@query("SELECT id, title, cast(length(content) AS varchar) AS chars FROM v_document")
def csv_export(t: Tables) -> DataFrame:
    """A report written as CSV and read back."""
    path = scratch(t.spark, "report")
    sinks.write_csv(t.document.select("id", "title", F.length("content").cast("string").alias("chars")), path)
    return t.spark.read.option("header", True).schema("id long, title string, chars string").csv(path)


@query("SELECT id, role FROM v_message UNION ALL SELECT id, role FROM v_message WHERE id % 2 = 0")
def append_rows(t: Tables) -> DataFrame:
    """Two appends to one table, read back."""
    path = scratch(t.spark, "append")
    rows = t.message.select("id", "role")
    sinks.append(rows, path, ["role"])
    sinks.append(rows.where("id % 2 = 0"), path, ["role"])
    return t.spark.read.schema("id long, role string").parquet(path)


@query("""SELECT id, CASE WHEN regexp_matches(lower(content), 'order|ship|tracking|delivery') THEN 'order' WHEN regexp_matches(lower(content), 'price|size|stock|variant|colour') THEN 'product' ELSE 'knowledge' END AS intent FROM v_message""")
def intent_classify(t: Tables) -> DataFrame:
    return conversations.classified(t.message).select("id", "intent")


@query("""SELECT id, conversation_id, role, cast(row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, id) AS integer) AS position
  FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, id DESC) AS n FROM v_message) AS x WHERE n <= 16""")
def memory_window(t: Tables) -> DataFrame:
    return conversations.memory_window(t.message, 16).select("id", "conversation_id", "role", "position")


@query("""SELECT channel_id, customer_ref, arg_max(id, created_at) AS conversation_id, coalesce(arg_max_null(customer_name, created_at), arg_max(customer_name, created_at)) AS customer_name, count(*) AS conversations FROM v_conversation GROUP BY 1, 2""")
def latest_conversation(t: Tables) -> DataFrame:
    return conversations.latest_conversation(t.conversation)


@query("SELECT id, shop_id, name FROM v_bot QUALIFY row_number() OVER (PARTITION BY shop_id ORDER BY id) = 1")
def first_per_group(t: Tables) -> DataFrame:
    return lookups.first_per_group(t.bot, ["shop_id"], ["id"]).select("id", "shop_id", "name")


@query("""SELECT entity, id, status FROM (SELECT user_id AS entity, event_id AS id, CASE WHEN event_type = 'error' THEN 'degraded' ELSE 'connected' END AS status, lag(CASE WHEN event_type = 'error' THEN 'degraded' ELSE 'connected' END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) AS x WHERE status IS DISTINCT FROM before""")
def status_transitions(t: Tables) -> DataFrame:
    rows = t.raw("events").select(F.col("user_id").alias("entity"), F.col("event_id").alias("id"), F.col("ts").alias("at"), F.when(F.col("event_type") == "error", "degraded").otherwise("connected").alias("status"))
    return conversations.status_transitions(rows).select("entity", "id", "status")


@query("SELECT event_id AS id, CASE WHEN event_id % 13 = 0 OR event_id % 17 = 0 THEN false ELSE value * 4 > 600 END AS stale FROM events")
def stale_messages(t: Tables) -> DataFrame:
    sent = F.when(F.col("event_id") % 13 == 0, F.lit(None)).when(F.col("event_id") % 17 == 0, F.lit("soon")).otherwise((1_000_000 - F.col("value") * 4).cast("string"))
    rows = t.raw("events").select(F.col("event_id").alias("id"), sent.alias("event_s"), F.lit(1_000_000).alias("arrival_s"))
    return conversations.flagged_stale(rows).select("id", "stale")


@query("""SELECT id, (CASE id % 3 WHEN 0 THEN 'order' WHEN 1 THEN 'product' ELSE 'knowledge' END) IN ('order', 'product') AND id % 5 = 0 AND coalesce(CASE id % 4 WHEN 0 THEN false WHEN 1 THEN true END, true) AS needs_human FROM v_message""")
def handoff_policy(t: Tables) -> DataFrame:
    named = F.element_at(F.array(*map(F.lit, ("order", "product", "knowledge"))), (F.col("id") % 3 + 1).cast("int"))
    rows = t.message.select("id", named.alias("intent"), (F.col("id") % 5).alias("context_blocks"), F.when(F.col("id") % 4 == 0, False).when(F.col("id") % 4 == 1, True).alias("handoff_enabled"))
    return conversations.handoff(rows).select("id", "needs_human")


def windows_sql(limit: int, seconds: int) -> str:
    return f"""WITH RECURSIVE w AS (SELECT user_id, min(ts) AS s FROM events GROUP BY 1 UNION ALL SELECT w.user_id, min(e.ts) FROM w JOIN events e ON e.user_id = w.user_id AND e.ts >= w.s + to_seconds({seconds}) GROUP BY w.user_id, w.s)
  SELECT w.user_id, w.s AS window_start, count(*) AS hits, least(count(*), {limit}) AS allowed FROM w JOIN events e ON e.user_id = w.user_id AND e.ts >= w.s AND e.ts < w.s + to_seconds({seconds}) GROUP BY 1, 2"""


@query(windows_sql(2, 6 * 3600))
def rate_limit_windows(t: Tables) -> DataFrame:
    """A coarse limit that the events of the fixture do run into."""
    return first_hit_windows(t.raw("events"), 2, 6 * 3600)


@query(windows_sql(30, 60))
def rate_limit_widget(t: Tables) -> DataFrame:
    return first_hit_windows(t.raw("events"), 30, 60)


@query(windows_sql(10, 300))
def rate_limit_login(t: Tables) -> DataFrame:
    return first_hit_windows(t.raw("events"), 10, 300)


@query("SELECT event_id, user_id, event_type, ts, cast(json_extract_string(props, '$.k') AS integer) AS k FROM events WHERE event_type <> 'error'")
def stream_ingest(t: Tables) -> DataFrame:
    stream = events.table_stream(t.spark, t.sf_dir, "events", t.raw("events").schema)
    rows = stream.where("event_type <> 'error'").select("event_id", "user_id", "event_type", "ts", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return events.run_to_table(rows, "stream-ingest")
