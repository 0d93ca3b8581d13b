"""What the operators of this subpackage share: table access, staged tables, row numbering."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradewind.llm.members import member_test


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"file://{tempfile.mkdtemp(prefix='tradewind-')}"
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; it is removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


@contextmanager
def session_settings(spark: SparkSession, values: dict[str, object]):
    """The session's settings, changed for what is run inside."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def staged(df: DataFrame, label: str, rows_per_file: int = 0) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: a cut in the lineage that outlives executors.

    The shuffle files of the write are removed when it has ended, since nothing reads them again. rows_per_file
    bounds the files (0: a file a task).
    """
    path = scratch_path(df.sparkSession, label)
    with session_settings(df.sparkSession, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bytes_of(df: DataFrame) -> int:
    """The size of a staged table's files."""
    spark, total = df.sparkSession, 0
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        total += jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(jpath).getLength()
    return total


def drop_staged(df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def text_hash(text: Column) -> Column:
    """With its id, a row's name across two reads of a table."""
    return F.xxhash64(text.cast("string"))


def unused(*frames: DataFrame, stem: str = "made") -> str:
    """A column name that none of the frames has, in any case."""
    taken = {c.lower() for f in frames for c in f.columns}
    return next(name for i in itertools.count() if (name := f"{stem}_{i}") not in taken)


def kept_rows(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that decided (doc_id, text_hash, kept) keeps; of repeated rows with one kept, one.

    Rows whose id has none that go are passed on as they are read; only the others meet decided in a join. What the
    join needs has names that docs does not use, so columns of docs may have any names.
    """
    maybe = member_test(decided.where("NOT kept"), "doc_id")
    key = F.col(id_col).cast("long")
    own, seen = unused(docs, decided, stem="own"), unused(docs, decided, stem="seen")
    stay = decided.where("kept").select(F.struct("doc_id", "text_hash").alias(seen))
    rest = docs.where(maybe(key)).withColumn(own, F.struct(key.alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash")))
    rest = rest.join(stay, F.col(own).eqNullSafe(F.col(seen)), "left_semi").dropDuplicates([own])
    return docs.where(~maybe(key)).unionByName(rest.drop(own))


def numbered(df: DataFrame, order: Sequence[str], label: str, weight: Column | None = None) -> DataFrame:
    """df staged in ascending order with row_number (from 0) and weight_before, the sum of weight over all earlier rows.

    Rows are range partitioned and sorted; each partition keeps its own running position, and only one total for
    each partition meets in a window. Equal order keys get neighbouring numbers in no fixed order.
    """
    w = F.coalesce(weight, F.lit(0)).cast("long") if weight is not None else F.lit(0).cast("long")
    laid = df.withColumn("_weight", w).repartitionByRange(*order).sortWithinPartitions(*order)
    laid = staged(laid.withColumn("_at", F.monotonically_increasing_id()), label)
    laid = laid.withColumn("_part", F.shiftright("_at", 33)).withColumn("_index", F.col("_at").bitwiseAND((1 << 33) - 1))
    by_part = laid.groupBy("_part").agg(F.count("*").alias("_n"), F.sum("_weight").alias("_w"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_w0"))
    out = laid.join(F.broadcast(offsets), "_part").withColumn("row_number", F.col("_n0") + F.col("_index"))  # one row a partition
    if weight is None:
        return out.drop("_weight", "_at", "_part", "_index", "_n0", "_w0")
    inside = Window.partitionBy("_part").orderBy("_index").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("weight_before", F.col("_w0") + F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
    return out.drop("_weight", "_at", "_part", "_index", "_n0", "_w0")
