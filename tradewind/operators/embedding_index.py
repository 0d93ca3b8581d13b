"""Vectors stored by the digest of what they embed: a text is embedded once, wherever and however often it stands."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.operators.retrieval import hash_vectors


class EmbeddingIndex:
    """Two kinds of bucketed tables under path, both dealt by content digest: chunk tables and the vectors.

    Since they are dealt alike, chunks meet vectors bucket by bucket without a shuffle; the only one is that which
    stores a chunk table. A bucket is a task, so by default there are several for every core.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.buckets = buckets or max(16, 4 * spark.sparkContext.defaultParallelism)
        self.vectors = f"vectors_{uuid.uuid4().hex}"
        self._save(spark.createDataFrame([], "digest string, embedding array<double>, run int").coalesce(1), self.vectors)

    def _save(self, rows: DataFrame, name: str, mode: str = "error") -> None:
        """Not sorted: a bucket that was added to has several files, which a join sorts by itself, without the columns that it does not need."""
        rows.write.mode(mode).bucketBy(self.buckets, "digest").option("path", f"{self.path}/{name}").saveAsTable(name)

    def store(self, chunks: DataFrame) -> str:
        """Chunks (document_id, ordinal, content) as a table; returns its name."""
        name = f"chunks_{uuid.uuid4().hex}"
        rows = chunks.select(F.sha2(F.col("content"), 256).alias("digest"), "document_id", "ordinal", "content")
        self._save(rows.repartition(self.buckets, "digest"), name)
        return name

    def pending(self, chunks: str, where: str = "true") -> DataFrame:
        """digest, content of the chunk table's contents that have no vector, each once; with a condition, of such rows."""
        rows = self.spark.table(chunks).where(where).join(self.spark.table(self.vectors).select("digest").hint("merge"), "digest", "left_anti")
        return rows.groupBy("digest").agg(F.first("content").alias("content"))

    def embed(self, chunks: str, run: int, where: str = "true") -> int:
        """Embeds what is pending and adds it to the vectors; returns how many contents that were."""
        made = hash_vectors(self.pending(chunks, where), "digest", "content", kind="string", blank=True)
        before = self.spark.table(self.vectors).count()
        self._save(made.select(F.col("id").alias("digest"), "embedding", F.lit(run).alias("run")), self.vectors, "append")
        return self.spark.table(self.vectors).count() - before

    def embedded(self, chunks: str, **of_vector: Column) -> DataFrame:
        """Every chunk with its vector (null for texts without a token) and the run that made it; or with what is stated
        of a vector in its place, which is worked out once a vector and before the join, so that no vector is sorted."""
        vectors = self.spark.table(self.vectors)
        if of_vector:
            vectors = vectors.select("digest", "run", *(c.alias(k) for k, c in of_vector.items()))
        return self.spark.table(chunks).join(vectors.hint("merge"), "digest")

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
