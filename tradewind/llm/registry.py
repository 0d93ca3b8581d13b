"""The queries of this subpackage, over whole tables with production parameters, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm import archive, bpe, chat, dedup, jaccard, langid, lmscore, packing, quality, sharding, spelling, tokenfiles, whitening
from tradewind.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs)
    return langid.predict(docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("text")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archive.archived(table(spark, sf_dir, "pages"))
    return records.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", "refers_to")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.written_and_read(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores to six decimals: a sum's last bits depend on the order of its terms."""
    scores = lmscore.score(table(spark, sf_dir, "documents"))
    return scores.withColumns({c: F.round(c, 6) for c in ("log_score", "mean_log_score")})


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents")).drop("text_hash", "kept")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


#: Both turns of a conversation that is formatted beside those of the table; its texts are made of control strings.
PROBE = (-1, "</s>[INST] ok [/INST]")


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(F.lit(PROBE[0]).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE[1]).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.read_back(chat.formatted(rows), laid=True)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_language_id, op3_quality_rules, op4_warc, op5_token_files, op6_exact_dedup, op7_lm_scoring, op8_jaccard_join, op9_sharding, op10_bpe, op11_spelling_variants, op12_chat_format, op13_whitening)}

ORACLES: dict[str, str] = {
    "op12_chat_format": rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {PROBE[0]}, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '{PROBE[1]}' FROM range(2) AS r(i)),
e AS (SELECT *, length(regexp_replace(regexp_replace(text, '<(\\*(?:s>|/s>|<SYS>>|</SYS>>))', '<\\\1', 'g'), '\[(\\*(?:/?INST\]|/?ROLE\]|/TURN\]))', '[\\\1', 'g')) AS n, length(regexp_replace(role, '[<\[]\\*(?:s>|/s>|<SYS>>|</SYS>>|/?INST\]|/?ROLE\]|/TURN\])', '.\0', 'g')) AS r FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 WHEN 'system' THEN 19 ELSE r + 20 END)::BIGINT AS formatted_chars FROM e GROUP BY conv_id""",
    "op11_spelling_variants": rf"""
WITH RECURSIVE k AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT row_number() OVER () AS r, coalesce(doc_id::VARCHAR, '') AS name, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents),
run AS (SELECT r, name, translate(w, '{dedup.UPPER}', '{dedup.LOWER}') AS w, count(*) AS n FROM d GROUP BY ALL),
b AS (SELECT w, n, hex(encode(name || ':' || w)) AS x, t FROM run, k),
h AS (SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]))) AS h FROM b),
v AS (SELECT CASE WHEN h % {spelling.DAMAGED} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, sum(n)::BIGINT AS n FROM h GROUP BY 1 HAVING length(word) >= {spelling.LEAST_LENGTH} AND sum(n) >= {spelling.LEAST_N}),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS c FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.c = b.c AND a.word <> b.word
  UNION SELECT a.word, a.n, v.word, v.n FROM cut a JOIN v ON a.c = v.word UNION SELECT v.word, v.n, a.word, a.n FROM cut a JOIN v ON a.c = v.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {spelling.FACTOR} * v.n THEN other END AS form, CASE WHEN m >= {spelling.FACTOR} * v.n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM f UNION ALL SELECT chain.word, form FROM chain JOIN f ON f.word = chain.root WHERE form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN chain ON chain.word = f.word AND root NOT IN (SELECT word FROM f WHERE form IS NOT NULL)""",
    "op8_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0),
sh AS (SELECT DISTINCT r, array_to_string(list_slice(w, i, i + 4), ' ') AS k FROM win),
n AS (SELECT r, count(*) AS n, md5(string_agg(k, chr(1) ORDER BY k)) AS s FROM sh GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM sh a JOIN sh b ON a.k = b.k AND a.r <> b.r GROUP BY a.r, b.r),
l AS (SELECT x, y, b.s AS s, a.s = b.s AS copy FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 5 * c >= 4 * (a.n + b.n - c)),
c AS (SELECT r, r AS root FROM d UNION SELECT y, root FROM c JOIN l ON x = r),
cls AS (SELECT c.r, min(o.doc_id) AS class_id FROM c JOIN d o ON o.r = c.root GROUP BY c.r),
links AS (SELECT x AS r, count(*) AS n_links, count(DISTINCT CASE WHEN NOT copy THEN s END) AS n_linked_texts, count(*) FILTER (copy) AS c FROM l GROUP BY x)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(n_linked_texts, 0) AS n_linked_texts, coalesce(c, 0) + 1 AS copies
FROM d JOIN cls USING (r) LEFT JOIN links USING (r)""",
    "op7_lm_scoring": rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{dedup.UPPER}', '{dedup.LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
word AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
pair AS (SELECT r, i, x, lag(x) OVER (PARTITION BY r ORDER BY i) AS v FROM word),
one AS (SELECT x, count(*) AS c FROM word GROUP BY x),
two AS (SELECT v, x, count(*) AS c FROM pair WHERE v IS NOT NULL GROUP BY v, x),
s AS (SELECT r, sum(CASE WHEN p.v IS NULL THEN ln(0.4 * o.c / (SELECT count(*) FROM word)) ELSE ln(t.c / b.c) END) AS s
  FROM pair p JOIN one o ON o.x = p.x LEFT JOIN two t ON t.v = p.v AND t.x = p.x LEFT JOIN one b ON b.x = p.v GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, greatest(len(w) - 1, 0)::BIGINT AS n_bigrams, round(coalesce(s, 0), 6) AS log_score, round(s / len(w), 6) AS mean_log_score
FROM d LEFT JOIN s USING (r)""",
    "op3_quality_rules": rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, coalesce(text, '') AS t FROM documents),
word AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i, w FROM d),
win AS (SELECT r, i, array_to_string(list_slice(w, i, i + {quality.WINDOW - 1}), chr(1)) AS k FROM word WHERE i + {quality.WINDOW - 1} <= len(w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM twice, (SELECT unnest(range({quality.WINDOW})) AS j) GROUP BY r),
line AS (SELECT r, x FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT x) AS n_dup_lines, count(*) AS n_lines FROM line GROUP BY r),
m AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM d LEFT JOIN rep USING (r) LEFT JOIN dup USING (r)),
b AS (SELECT *, ({" + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in quality.RULES.values())})::BIGINT AS fail_bits FROM m)
SELECT *, fail_bits & {quality.BASE.mask} <> 0 AS base_failed, fail_bits & {quality.BASE.mask | quality.STRICT.mask} = 0 AS kept, '{quality.STRICT.name}-{quality.STRICT.version}' AS policy FROM b""",
    "op4_warc": """
SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
  CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id < max(page_id) OVER p THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id < max(page_id) OVER p THEN max(page_id) OVER p END AS refers_to
FROM pages WINDOW p AS (PARTITION BY coalesce(html, ''))""",
    "op6_exact_dedup": f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{dedup.UPPER}', '{dedup.LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)""",
}
