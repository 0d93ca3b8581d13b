"""Deliveries of all webhooks as one stream: taken once each, fanned out to several tables in one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.sources import webhooks
from tradewind.sources.shared import hadoop_path
from tradewind.streaming.events import deduplicated
from tradewind.streaming.outbox import Outbox

#: A delivery as it comes in: its id, the platform (or bank), the body, when it came and the row that it stands for.
DELIVERY = "delivery_id string, kind string, payload string, received_at timestamp, row_id long"
BANK = "bank"
TABLES = {
    "events": "kind string, route_key string, customer_ref string, text string, customer_name string, event_ts double",
    "transfers": "row_id long, created_at timestamp, txn_id long, amount double, memo string, transfer_type string",
}


def tables_of(deliveries: DataFrame) -> dict[str, DataFrame]:
    """What a lot of deliveries says: chat events and bank transfers."""
    chats = webhooks.normalised(deliveries.where(F.col("kind") != BANK).select("kind", "payload"))
    bank = webhooks.transfers(deliveries.where(F.col("kind") == BANK).select("row_id", F.col("received_at").alias("created_at"), F.col("payload").alias("body")))
    return {"events": chats, "transfers": bank.select("row_id", "created_at", "txn_id", "amount", "memo", "transfer_type")}


class Intake:
    """A folder of deliveries (JSON lines, a file a lot) and an outbox of the tables that they become.

    A delivery id that comes again within `late` of the watermark is passed over; rows without an id are all taken.
    """

    def __init__(self, spark: SparkSession, path: str, late: str = "1 day"):
        self.spark, self.path, self.late = spark, path, late
        self.out = Outbox(spark, path)

    def deliver(self, deliveries: DataFrame) -> None:
        deliveries.write.mode("append").json(f"{self.path}/deliveries")

    def run(self, files_per_batch: int = 1) -> int:
        stream = self.spark.readStream.schema(DELIVERY).option("maxFilesPerTrigger", files_per_batch).json(f"{self.path}/deliveries")
        once = deduplicated(stream, "delivery_id", "received_at", self.late)

        def take(rows: DataFrame, batch: int) -> None:
            lot = f"{self.path}/lots/{batch}"
            rows.write.mode("overwrite").parquet(lot)  # once by the many tasks of the state, then a few tasks a table
            self.out.write(batch, tables_of(rows.sparkSession.read.schema(rows.schema).parquet(lot)))
            self.out.mark(batch)
            jpath, files = hadoop_path(self.spark, lot)
            files.delete(jpath, True)

        once.writeStream.option("checkpointLocation", f"{self.path}/progress").trigger(availableNow=True).foreachBatch(take).start().awaitTermination()
        return len(self.out.marked())

    def table(self, name: str) -> DataFrame:
        return self.out.read(name, TABLES[name]).drop("batch")
