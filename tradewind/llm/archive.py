"""A content-addressed WARC archive: payload bytes once by digest, exact record headers apart, joined on reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm.common import scratch_path, staged

CRLF = "\r\n"
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_URN = "urn:x-page:"


#: A digest with more records than this is split: into as many parts as it has such lots.
LOT = 1000
#: There are fewer digests of more than n / SPLIT records than this, so what names them can be broadcast.
SPLIT = 1000


def lot_of(n: int) -> int:
    return max(LOT, -(-n // SPLIT))


def _payloads(pages: DataFrame, id_col: str, url_col: str, body_col: str) -> DataFrame:
    body = F.coalesce(F.col(body_col).cast("string"), F.lit("")).cast("binary")
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), body.alias("payload")).withColumns(
        {"digest": F.sha2("payload", 256), "sha1": F.sha1("payload"), "length": F.octet_length("payload").cast("long")}
    )


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", *, least_shared: int = 1000, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes one record for each row of pages under path/payloads and path/records.

    Equal payloads (SHA-256, cross-checked by SHA-1 and length) are stored once. Of records with equal payloads of
    at least least_shared bytes the one with the largest id is a response and the others are revisits of it; all
    smaller payloads are responses. Of rows that repeat the largest id one is the response; a row without an id
    revisits any that has one. Null bodies are empty; null urls are empty; line breaks in a url are escaped. Payloads
    are whole, however long; an empty table gives an empty archive; other columns of pages are not read.
    Copies are folded before the shuffle, so a payload with very many copies is moved once for each task, and records
    without a copy meet nothing in a join.
    """
    rows = _payloads(pages, id_col, url_col, body_col)
    store = rows.groupBy("digest").agg(
        F.first("payload").alias("payload"), F.min("sha1").alias("sha1"), F.max("sha1").alias("_sha1"), F.min("length").alias("length"), F.max("length").alias("_length")
    )
    sound = (F.col("sha1") == F.col("_sha1")) & (F.col("length") == F.col("_length"))
    store = store.withColumn("sha1", F.when(sound, F.col("sha1")).otherwise(F.raise_error(F.lit("payloads of one digest differ"))))
    store.drop("_sha1", "_length").write.option("compression", "zstd").parquet(f"{path}/payloads")

    record = staged(rows.select("page_id", "url", "digest", "sha1", "length").withColumn("row", F.monotonically_increasing_id()), "warc-rows")
    shared = record.where(F.col("length") >= least_shared)
    held = shared.groupBy("digest").agg(F.max(F.struct("page_id", "row")).alias("first"), F.count("*").alias("copies"))
    held, lot = staged(held.where("copies > 1"), "warc-held"), lot_of(record.count())
    many = F.broadcast(held.where(F.col("copies") > lot).drop("copies"))  # fewer than SPLIT rows of a digest and an id
    few = shared.join(many.select("digest"), "digest", "left_anti").join(held.where(F.col("copies") <= lot).drop("copies"), "digest", "left")
    shared = shared.join(many, "digest").unionByName(few)
    record = shared.unionByName(record.where(F.col("length") < least_shared), allowMissingColumns=True)
    record = record.withColumn("holder", F.col("first.page_id"))
    is_revisit = F.coalesce(F.col("first.row") != F.col("row"), F.lit(False))
    urn = lambda c: F.concat(F.lit(f"<{RECORD_URN}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Target-URI", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(is_revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn(F.col("holder"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(is_revisit, F.lit(0)).otherwise(F.col("length")).cast("string")),
        F.lit(CRLF),
    )
    record.select("digest", header.cast("binary").alias("header")).write.option("compression", "zstd").parquet(f"{path}/records")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive, with header fields parsed and the full payload joined by digest.

    Columns: page_id, record_type, refers_to, url, header, payload (of a revisit: what it refers to), digest.
    A payload that no longer matches its SHA-256 stops the read. Records of one digest may be very many: they are
    dealt to parts of about a lot, each of which meets a copy of the payload, so no task holds them all.
    """
    payloads = spark.read.parquet(f"{path}/payloads").select("digest", "payload")
    checked = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload does not match its digest")).cast("binary"))
    records = spark.read.parquet(f"{path}/records").withColumn("_text", F.decode("header", "UTF-8"))
    field = lambda name: F.nullif(F.regexp_extract("_text", rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))
    number = lambda name: F.regexp_extract("_text", rf"\r\n{name}: <{RECORD_URN}(-?\d*)>\r\n", 1)
    parsed = records.select(
        "digest", "header", number("WARC-Record-ID").try_cast("long").alias("page_id"), field("WARC-Type").alias("record_type"), number("WARC-Refers-To").try_cast("long").alias("refers_to"), field("WARC-Target-URI").alias("url")
    )
    lot = lot_of(records.count())
    hot = parsed.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > lot).select("digest", F.ceil(F.col("n") / lot).cast("int").alias("parts"))
    hot = F.broadcast(hot)  # fewer than SPLIT rows
    dealt = parsed.join(hot, "digest", "left").withColumn("part", F.pmod(F.xxhash64("header", "page_id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    copied = payloads.withColumn("payload", checked).join(hot, "digest", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(copied, ["digest", "part"]).drop("part")


def record_bytes(records: DataFrame) -> DataFrame:
    """read_archive's rows with `record`: the bytes of the WARC record as it stands in a .warc file."""
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return records.withColumn("record", F.concat("header", block, F.lit(b"\r\n\r\n")))


def archived(pages: DataFrame, **options) -> DataFrame:
    """pages written to a fresh archive in the shared folder and read back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archive(pages, path, **options)
    return read_archive(pages.sparkSession, path)
