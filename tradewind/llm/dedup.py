"""Exact deduplication as a stateful stream: keyed state on disk that never expires, and a full comparison on hits.

The state is a versioned table in the shared folder rather than Spark's RocksDB store: that one keeps an open
database with a preallocated 4 MB manifest for every shuffle partition, however few keys there are.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm.common import bytes_of, scratch_path, session_settings, staged, text_hash
from tradewind.llm.members import member_test

ENTRY = "digest binary, holder struct<doc_id: bigint, locator: string, `row`: bigint>, group_size bigint"
#: Only these letters are folded.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Null is empty; A-Z are lower-cased; nothing else changes."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


def sha256(content: Column) -> Column:
    return F.unhex(F.sha2(content.cast("binary"), 256))


def folded(arrivals: DataFrame) -> DataFrame:
    """Arrivals (digest, doc_id, row, locator) as one entry for each digest.

    Copies are counted and reduced to the holder (the largest doc_id, then locator and row) before the shuffle, so a digest
    with very many copies is one row for each task.
    """
    return arrivals.groupBy("digest").agg(F.max(F.struct("doc_id", "locator", "row")).alias("holder"), F.count("*").alias("group_size"))


class KeyedState:
    """Entries by digest on the shared disk, kept for good: each micro-batch adds a version of those it changed.

    A version is a Parquet folder named by its batch, so a batch that is run again replaces what it wrote before.
    After every `compact` versions they are written anew as one. Which versions count is read from the folder, so a
    state opened on the same path goes on where another ended. Nothing is held in executors or in the driver between
    batches.
    """

    def __init__(self, spark: SparkSession, path: str, compact: int = 8):
        self.spark, self.path, self.compact = spark, path, compact

    def _folder(self, path: str):
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jpath, jpath.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        jpath, files = self._folder(path)
        return [s.getPath().getName() for s in files.listStatus(jpath)] if files.exists(jpath) else []

    def _finished(self) -> dict[str, list[int]]:
        """The numbers of the finished versions in the folder, by kind."""
        found: dict[str, list[int]] = {"batch": [], "until": []}
        for name in self._names(self.path):
            kind, _, number = name.partition("-")
            if kind in found:
                jpath, files = self._folder(f"{self.path}/{name}/_SUCCESS")
                if files.exists(jpath):
                    found[kind].append(int(number))
        return found

    def _numbers(self) -> dict[tuple[str, int], int]:
        """The version of each micro-batch (source, n) that was ever begun."""
        found = (name.split("-") for name in self._names(f"{self.path}/numbers"))
        return {(source, int(n)): int(number) for number, source, n in found}

    def begin(self, source: str) -> None:
        """A source can be begun only when no other one was stopped within a micro-batch: its version would lack what comes between."""
        numbers = self._numbers()
        if numbers and (last := max(numbers, key=numbers.get))[0] != source and numbers[last] not in self._finished()["batch"]:
            raise ValueError("an earlier run was stopped within a micro-batch; run it again first")

    def take(self, source: str, arrivals: DataFrame, n: int) -> None:
        """Micro-batch n of a source: gets its version's number before it is worked on, and is passed over if that is there."""
        numbers = self._numbers()
        number = numbers.get((source, n))
        if number is None:
            number = max(numbers.values(), default=-1) + 1
            jpath, files = self._folder(f"{self.path}/numbers/{number}-{source}-{n}")
            files.mkdirs(jpath)
        if number not in self._finished()["batch"]:
            self.update(arrivals, number)

    def versions(self, before: float = float("inf")) -> list[str]:
        """The versions that make up the state before a micro-batch: the last whole one and the batches after it."""
        found = self._finished()
        whole = max((n for n in found["until"] if n < before), default=None)
        batches = sorted(n for n in found["batch"] if n < before and (whole is None or n > whole))
        return [f"{self.path}/until-{whole}"] * (whole is not None) + [f"{self.path}/batch-{n}" for n in batches]

    def entries(self, versions: list[str] | None = None) -> DataFrame:
        """The latest entry of each digest: the one with most members."""
        versions = versions or self.versions()
        found = self.spark.read.schema(ENTRY).parquet(*versions)
        if len(versions) == 1:
            return found
        return found.groupBy("digest").agg(F.max(F.struct("group_size", "holder")).alias("v")).select("digest", "v.holder", "v.group_size")

    def update(self, arrivals: DataFrame, number: int) -> None:
        """Folds the arrivals of micro-batch `number` and merges them with the entries that they hit."""
        new = folded(arrivals)
        target = f"{self.path}/batch-{number}"
        versions = self.versions(before=number)
        if versions:
            new = staged(new, "dedup-batch")
            maybe = member_test(new, "digest")
            hit = self.entries(versions).where(maybe(F.col("digest"))).select("digest", F.col("holder").alias("before"), F.col("group_size").alias("size_before"))
            holder = F.when(F.col("before") > F.col("holder"), F.col("before")).otherwise(F.col("holder"))
            new = new.join(hit, "digest", "left").select("digest", holder.alias("holder"), (F.col("group_size") + F.coalesce("size_before", F.lit(0))).alias("group_size"))
        new.write.mode("overwrite").option("compression", "zstd").parquet(target)
        versions.append(target)
        if len(versions) > self.compact:
            whole = f"{self.path}/until-{number}"
            self.entries(versions).write.mode("overwrite").option("compression", "zstd").parquet(whole)


#: A micro-batch takes a quarter of the arrivals, and no more than so many rows however many there are.
BATCHES, ROWS_PER_BATCH = 4, 50_000_000
#: A digest with more than this share of all rows is answered by a broadcast: there are at most so many of them.
HEAVY = 10_000


def rows_per_batch(n: int) -> int:
    return max(1, min(ROWS_PER_BATCH, -(-n // BATCHES)))


def run_stream(arrivals: DataFrame, files_per_batch: int | None = None, path: str | None = None) -> DataFrame:
    """Streams a staged table of arrivals through the keyed state, in micro-batches, and returns its entries.

    A micro-batch takes so many bytes as rows_per_batch of the rows have, or files_per_batch files if that is given.
    With a path the state is durable: it is kept for later runs, and the stream's progress beside it. A run that was
    stopped goes on with the batch that it was at, so every file of a folder counts once; another folder's files are
    new arrivals.
    """
    spark = arrivals.sparkSession
    path = path or scratch_path(spark, "dedup-state")
    state = KeyedState(spark, path)
    files = arrivals.inputFiles()
    if files:
        folder, n = files[0].rsplit("/", 1)[0], arrivals.count()
        source = hashlib.sha256(folder.encode()).hexdigest()[:16]
        state.begin(source)
        share = {"maxBytesPerTrigger": max(1, bytes_of(arrivals) * rows_per_batch(n) // max(1, n))} if files_per_batch is None else {"maxFilesPerTrigger": files_per_batch}
        stream = spark.readStream.schema(arrivals.schema).options(**share).parquet(folder)
        with session_settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
            query = stream.writeStream.option("checkpointLocation", f"{path}/progress-{source}").trigger(availableNow=True).foreachBatch(lambda rows, k: state.take(source, rows, k)).start()
            query.awaitTermination()
    versions = state.versions()
    if not versions:
        return folded(arrivals)
    return state.entries(versions) if len(versions) == 1 else staged(state.entries(versions), "dedup-entries")


def placed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with a struct `place` (locator, row): the file and the row in it, if docs are read from files.

    Otherwise there is no place to go back to; then rows are told apart by a number that holds for one pass only.
    """
    try:
        meta = docs.metadataColumn("_metadata")
        return docs.withColumn("place", F.struct(meta["file_path"].alias("locator"), meta["row_index"].alias("row"))), True
    except AnalysisException:
        return docs.withColumn("place", F.struct(F.lit("").alias("locator"), F.monotonically_increasing_id().alias("row"))), False


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> DataFrame:
    """Every row's group: doc_id, text_hash, digest, keep_id, group_size, kept.

    Rows are equal when their normalised texts are, byte by byte (null is empty; very long texts are compared whole):
    a digest only finds the hits. Each hit's contents are read again and compared in full, and the content at the
    locator that the state holds must be among them. Digests whose texts turn out to differ are grouped anew by the
    text itself, so even a weak digest gives right groups. The locator is a file and a row in it where docs are read
    from files; of other tables only the id is held against the content that is read again. The row with the largest id stays (null ids lose; of
    repeated rows one stays). An empty table gives no rows; other columns of docs, whatever their names, are not read.

    Rows whose digest has no second one meet nothing in a join; digests with very many rows are answered by a
    broadcast that is bounded by HEAVY, so none of them lands in one task.
    """
    own, located = placed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    content = normalised(F.col("text"))
    narrow = own.select("doc_id", digest(content).alias("digest"), text_hash(F.col("text")).alias("text_hash"), "place.*")
    arrivals = staged(narrow, "dedup-arrivals", rows_per_batch(docs.count()))
    state = run_stream(arrivals)

    hits = state.where("group_size > 1")
    maybe = member_test(hits, "digest")
    place = ("doc_id", "locator", "row") if located else ("doc_id",)
    texts = own.select("doc_id", content.alias("content"), "place.*").withColumn("digest", digest(F.col("content"))).where(maybe(F.col("digest")))
    read = texts.groupBy("digest").agg((F.min("content") == F.max("content")).alias("equal"), F.max(F.struct(*place)).alias("last"))
    there = F.col("last").eqNullSafe(F.struct(*(F.col(f"holder.{c}").alias(c) for c in place)))
    differing = staged(read.join(hits, "digest").where(~(F.col("equal") & there)).select("digest"), "dedup-differing")

    wanted = ["doc_id", "text_hash", "digest", "keep_id", "group_size", "kept"]
    single = F.col("holder").isNull()
    decided = {
        "keep_id": F.when(single, F.col("doc_id")).otherwise(F.col("holder.doc_id")),
        "group_size": F.coalesce("group_size", F.lit(1).cast("long")),
        "kept": single | F.col("holder").eqNullSafe(F.struct("doc_id", "locator", "row")),
    }
    least = arrivals.count() // HEAVY + 1
    heavy = F.broadcast(hits.where(F.col("group_size") > least))  # HEAVY rows at most
    asked = arrivals.where(maybe(F.col("digest")))
    light = asked.join(heavy.select("digest"), "digest", "left_anti").join(hits.where(F.col("group_size") <= least), "digest", "left")
    alone = arrivals.where(~maybe(F.col("digest"))).select(*wanted[:3], F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    entries = asked.join(heavy, "digest").unionByName(light).withColumns(decided).select(*wanted)
    if not differing.isEmpty():  # a digest of different texts
        entries = entries.join(differing, "digest", "left_anti").unionByName(_regrouped(docs, differing, id_col, text_col, digest).select(*wanted))
    return alone.unionByName(entries)


def _regrouped(docs: DataFrame, differing: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    content = normalised(F.col(text_col))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"), content.alias("content"))
    texts = texts.withColumn("digest", digest(F.col("content"))).join(differing, "digest", "left_semi")
    texts = staged(texts.withColumn("row", F.monotonically_increasing_id()), "dedup-texts")
    found = texts.groupBy("content").agg(F.max(F.struct("doc_id", "row")).alias("h"), F.count("*").alias("group_size"))
    return texts.join(found, "content").withColumns({"keep_id": F.col("h.doc_id"), "kept": F.col("row") == F.col("h.row")})
