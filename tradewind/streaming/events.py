"""Event streams: intake, idempotency, first-hit rate limits and quotas, with batch twins."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tradewind.operators.scans import first_hit_windows as rate_limit_windows  # noqa: F401  the batch twin
from tradewind.sources.shared import scratch

HITS = "user_id long, window_start timestamp_ntz, hits long, allowed long"


def run_to_table(stream: DataFrame, label: str) -> DataFrame:
    """Runs a stream over all that is there, exactly once, and reads what it wrote."""
    spark = stream.sparkSession
    out = scratch(spark, label)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, f"{label}-progress")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def table_stream(spark: SparkSession, folder: str, name: str, schema, files: int = 100) -> DataFrame:
    """A file stream over one Parquet table of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/{name}.parquet*")


def deduplicated(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """The first row of each key; keys are forgotten once the watermark has passed them. Null keys are never dropped."""
    marked = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return marked.withColumn("_key", F.coalesce(F.col(key).cast("string"), F.concat(F.lit("null-"), F.uuid()))).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def _windows(key, times: Iterator[pd.Timestamp], limit: int, length: timedelta, start=None, hits: int = 0) -> tuple[list[tuple], object, int]:
    """Closed windows of sorted times; the open one comes back as (start, hits)."""
    done = []
    for t in times:
        if start is None or t - start >= length:
            if start is not None:
                done.append((key, start, hits, min(hits, limit)))
            start, hits = t, 0
        hits += 1
    return done, start, hits


def rate_limit_stream(stream: DataFrame, limit: int, seconds: int) -> DataFrame:
    """The streaming twin: emits a user's window once a later hit closes it; state is one window for each user."""
    length = timedelta(seconds=seconds)

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, hits = state.get if state.exists else (None, 0)
        times = pd.concat([p["ts"] for p in pdfs]).sort_values()
        done, start, hits = _windows(key[0], times, limit, length, start, hits)
        state.update((start, hits))
        yield pd.DataFrame(done, columns=["user_id", "window_start", "hits", "allowed"])

    return stream.select("user_id", "ts").groupBy("user_id").applyInPandasWithState(step, HITS, "start timestamp_ntz, hits long", "append", GroupStateTimeout.NoTimeout)


def quota_stream(stream: DataFrame, limit: int) -> DataFrame:
    """Each event (account_id, id, tokens, created_at) with its account's tokens before it and whether it may pass."""

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (used,) = state.get if state.exists else (0,)
        rows = pd.concat(list(pdfs)).sort_values(["created_at", "id"])
        before = used + rows["tokens"].cumsum() - rows["tokens"]
        state.update((int(used + rows["tokens"].sum()),))
        yield pd.DataFrame({"id": rows["id"], "account_id": key[0], "tokens_before": before, "allowed": (before < limit) | (limit == 0)})

    return stream.groupBy("account_id").applyInPandasWithState(step, "id long, account_id long, tokens_before long, allowed boolean", "used long", "append", GroupStateTimeout.NoTimeout)
