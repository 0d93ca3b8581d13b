"""A log of jobs that a stream works off: failures become statuses and dead letters, and a batch that is run again counts once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.operators.ingest import chunk_rows
from tradewind.sources.readers import extracted
from tradewind.streaming.outbox import Outbox

JOB = "job_id long, kind string, document_id long, attempt int"
STATUS = "job_id long, document_id long, attempt int, status string, error string, char_count long"
CHUNK = "job_id long, document_id long, ordinal int, content string"
#: The kinds of work, and what is said of a job whose file is not there.
INGEST, EMBED = "ingest_document", "embed_document"
GONE = "the uploaded file was not found"


class JobLog:
    """A queue under path (a Parquet file for every lot of jobs that was put in) and an outbox of statuses and chunks.

    A micro-batch writes both tables, puts its failed jobs back into the queue under its own number, and sets its
    mark last. A batch that was stopped before its mark is run again over the same jobs and replaces what it had
    written. So every attempt of a job counts once, whatever is lost in between.
    """

    def __init__(self, spark: SparkSession, path: str, attempts: int = 3):
        self.spark, self.path, self.attempts = spark, path, attempts
        self.out = Outbox(spark, path)

    def enqueue(self, jobs: DataFrame) -> None:
        """job_id, kind, document_id: pending from now on."""
        rows = jobs.select(F.col("job_id").cast("long").alias("job_id"), "kind", F.col("document_id").cast("long").alias("document_id"), F.lit(1).alias("attempt"))
        rows.write.mode("append").parquet(f"{self.path}/queue/new")

    def stored(self, files: DataFrame) -> DataFrame:
        """files dealt by document_id into a bucketed table, so that no batch shuffles their content again."""
        name = f"files_{uuid.uuid4().hex}"
        buckets = max(16, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        files.repartition(buckets, "document_id").write.bucketBy(buckets, "document_id").option("path", f"{self.path}/{name}").saveAsTable(name)
        return self.spark.table(name)

    def _worked(self, jobs: DataFrame, files: DataFrame) -> DataFrame:
        """jobs with text and error. files: document_id, name, content and the attempt from which on they are there."""
        there = files.select("document_id", "name", "content", F.col("from_attempt"))
        rows = jobs.hint("shuffle_hash").join(there, "document_id", "left")  # a lot's jobs are small, files are not
        known = F.coalesce(F.col("kind").isin(INGEST, EMBED), F.lit(False))
        missing = F.col("content").isNull() | (F.coalesce("from_attempt", F.lit(1)) > F.col("attempt"))
        refused = F.when(~known, F.concat(F.lit("unknown job kind: "), F.coalesce("kind", F.lit("")))).when(missing, GONE)
        rows = rows.withColumn("refused", refused)
        read = extracted(rows.where("refused IS NULL"), "name", "content")
        kept = ["job_id", "kind", "document_id", "attempt"]
        return read.select(*kept, "text", "error").unionByName(rows.where("refused IS NOT NULL").select(*kept, F.lit(None).cast("string").alias("text"), F.col("refused").alias("error")))

    def work(self, jobs: DataFrame, files: DataFrame, batch: int) -> None:
        """One micro-batch: its chunks, statuses and what is tried again, then its mark."""
        out = self._worked(jobs.dropDuplicates(["job_id", "attempt"]), files).persist()
        status = out.select("job_id", "document_id", "attempt", F.when(F.col("error").isNull(), "ready").otherwise("error").alias("status"), F.left("error", F.lit(500)).alias("error"), F.length("text").cast("long").alias("char_count"))
        chunks = chunk_rows(out.where("error IS NULL"), ["job_id", "document_id"], F.col("text"))
        self.out.write(batch, {"status": status, "chunks": chunks})
        again = out.where(F.col("error").isNotNull() & (F.col("attempt") < self.attempts)).select("job_id", "kind", "document_id", (F.col("attempt") + 1).alias("attempt"))
        again.write.mode("overwrite").parquet(f"{self.path}/queue/again-{batch}")
        out.unpersist()
        self.out.mark(batch)

    def run(self, files: DataFrame, files_per_batch: int | None = None) -> int:
        """Works off what is in the queue now, in one batch or so many files a batch, in the order of arrival; returns the number of finished batches."""
        limit = {"maxFilesPerTrigger": files_per_batch} if files_per_batch else {}
        stream = self.spark.readStream.schema(JOB).options(**limit).parquet(f"{self.path}/queue/*")
        query = stream.writeStream.option("checkpointLocation", f"{self.path}/progress").trigger(availableNow=True).foreachBatch(lambda rows, n: self.work(rows, files, n)).start()
        query.awaitTermination()
        return len(self.out.marked())

    def drain(self, files: DataFrame, files_per_batch: int | None = None) -> None:
        """Runs until no attempt is left; `attempts` runs are enough, since each one works off all that the one before put back."""
        for _ in range(self.attempts):
            self.run(files, files_per_batch)

    def tries(self) -> DataFrame:
        """Every finished attempt: job_id, document_id, attempt, status, error, char_count, batch."""
        return self.out.read("status", STATUS)

    def chunks(self) -> DataFrame:
        return self.out.read("chunks", CHUNK)

    def queue(self) -> DataFrame:
        return self.spark.read.schema(JOB).parquet(f"{self.path}/queue/*")

    def status(self) -> DataFrame:
        """Every job with its last status; pending, if it was never tried."""
        last = self.tries().groupBy("job_id").agg(F.max_by(F.struct("attempt", "status", "error", "char_count"), "attempt").alias("s"))
        jobs = self.queue().where("attempt = 1").select("job_id", "kind", "document_id").dropDuplicates(["job_id"])
        return jobs.join(last, "job_id", "left").select("job_id", "kind", "document_id", F.coalesce("s.attempt", F.lit(0)).alias("attempts"), F.coalesce("s.status", F.lit("pending")).alias("status"), "s.error", "s.char_count")

    def dead(self) -> DataFrame:
        """Jobs that failed as often as they may be tried."""
        return self.status().where((F.col("status") == "error") & (F.col("attempts") >= self.attempts))

    def history(self) -> DataFrame:
        """job_id, step, status: pending, then processing and its outcome for every attempt that was made."""
        pending = self.queue().where("attempt = 1").select("job_id", F.lit(0).alias("step"), F.lit("pending").alias("status")).distinct()
        made = self.tries().select("job_id", F.inline(F.array(F.struct((2 * F.col("attempt") - 1).alias("step"), F.lit("processing").alias("status")), F.struct((2 * F.col("attempt")).alias("step"), F.col("status").alias("status")))))
        return pending.unionByName(made)
