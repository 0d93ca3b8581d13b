"""Several tables written by one stream in one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tradewind.sources.shared import hadoop_path


class Outbox:
    """A folder for each table, in it a folder for each micro-batch, and a mark for every batch whose folders are whole.

    Readers see marked batches only, of all tables alike. A batch that was stopped before its mark replaces what it
    had written when it is run again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, batch: int, tables: dict[str, DataFrame]) -> None:
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def mark(self, batch: int) -> None:
        jpath, files = hadoop_path(self.spark, f"{self.path}/done/{batch}")
        files.mkdirs(jpath)

    def marked(self) -> list[int]:
        jpath, files = hadoop_path(self.spark, f"{self.path}/done")
        return sorted(int(s.getPath().getName()) for s in files.listStatus(jpath)) if files.exists(jpath) else []

    def read(self, name: str, schema: str) -> DataFrame:
        """The rows of all marked batches, with batch."""
        folders = [f"{self.path}/{name}/batch={n}" for n in self.marked()]
        if not folders:
            return self.spark.createDataFrame([], f"{schema}, batch long")
        return self.spark.read.option("basePath", f"{self.path}/{name}").schema(f"{schema}, batch long").parquet(*folders)
