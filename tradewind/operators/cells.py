"""An exact vector index of cells: what a cell can hold at best decides whether it is read.

Vectors are dealt to the nearest of a bounded number of centres; each cell keeps the widest angle between its centre
and a member. By the triangle inequality no member is closer to a query than the angle to the centre less that one,
so cells are read in falling order of this bound until the k-th score beats the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tradewind.operators.lexical import ranked
from tradewind.sources.shared import staged

#: The fit sees so many rows at most (those of the least hashes), and makes so many cells at most. Rows of a block.
SAMPLE, MOST_CELLS, BLOCK = 8192, 1024, 2048
#: Bounds are raised by this much, which is more than rounding can take from them.
SLACK = 1e-6
NOWHERE = -1  # the cell of vectors without a direction


def units(lists: pa.Array) -> np.ndarray:
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def centres_of(x: np.ndarray, n: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means of unit vectors, begun with spread-out members."""
    dice = np.random.default_rng(7)
    picked = [int(dice.integers(len(x)))]
    closest = x @ x[picked[0]]
    while len(picked) < n and (closest < 1 - 1e-12).any():
        apart = np.maximum(0, 1 - closest)
        picked.append(int(dice.choice(len(x), p=apart / apart.sum())))
        closest = np.maximum(closest, x @ x[picked[-1]])
    c = x[picked]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-300), c)
    return c


@dataclass
class Cells:
    """centres (one a row), widest angles and sizes of the cells in the table at path."""

    path: str
    numbers: np.ndarray
    centres: np.ndarray
    widest: np.ndarray
    sizes: np.ndarray

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """queries x cells: what no member's cosine exceeds."""
        angle = np.arccos(np.clip(q @ self.centres.T, -1, 1)) - self.widest
        out = np.cos(np.clip(angle, 0, np.pi)) + SLACK
        out[:, self.numbers == NOWHERE] = SLACK
        return out


def build(items: DataFrame, path: str, n_cells: int | None = None, sample: int = SAMPLE) -> Cells:
    """Writes items (id, embedding and columns to filter by) under path, one folder a cell. Rows without an embedding are left out."""
    spark = items.sparkSession
    rows = items.where("embedding IS NOT NULL").withColumn("embedding", F.col("embedding").cast("array<double>"))
    n = rows.count()
    drawn = rows.select("embedding").orderBy(F.xxhash64("id"), "id").limit(sample).toArrow().column("embedding").combine_chunks()
    x = units(drawn) if len(drawn) else np.zeros((0, 1))
    x = x[np.linalg.norm(x, axis=1) > 0.5]
    centres = centres_of(x, n_cells or min(MOST_CELLS, max(1, int(np.sqrt(n))))) if len(x) else np.zeros((0, x.shape[1]))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = units(batch.column("embedding"))
            there = np.linalg.norm(u, axis=1) > 0.5
            own, angle = np.full(len(u), NOWHERE, np.int32), np.zeros(len(u))
            if there.any():
                s = u[there] @ centres.T
                own[there] = s.argmax(axis=1)
                angle[there] = np.arccos(np.clip(s.max(axis=1), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(angle)], names=[*batch.schema.names, "cell", "angle"])

    schema = StructType([*rows.schema.fields, StructField("cell", IntegerType()), StructField("angle", DoubleType())])
    dealt = staged(rows.mapInArrow(assigned, schema), "cells")
    found = sorted(dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("widest")).collect())  # a row a cell
    blocks = spark.createDataFrame([(r.cell, -(-r.n // BLOCK)) for r in found], "cell int, blocks int")
    laid = dealt.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))  # a hot cell is many blocks
    laid.drop("blocks", "angle").repartition("cell", "block").write.partitionBy("cell").parquet(path)
    numbers = np.array([r.cell for r in found], np.int32)
    own = np.array([centres[r.cell] if r.cell != NOWHERE else np.zeros(centres.shape[1]) for r in found]).reshape(len(found), centres.shape[1])
    return Cells(path, numbers, own, np.array([r.widest for r in found]), np.array([r.n for r in found]))


def _probes(queries: DataFrame, index: Cells, k: int) -> DataFrame:
    """query, vector, cell, bound, first for every cell; first: the best cells that hold 2k members together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bounds = index.bounds(units(batch.column("embedding")))
            order = np.argsort(-bounds, axis=1, kind="stable")
            ahead = np.cumsum(index.sizes[order], axis=1) - index.sizes[order]
            each = pa.array(np.repeat(np.arange(batch.num_rows), len(index.numbers)))
            columns = [batch.column("id").take(each), pa.array(index.numbers[order].ravel()), pa.array(np.take_along_axis(bounds, order, axis=1).ravel()), pa.array((ahead < 2 * k).ravel())]
            yield pa.RecordBatch.from_arrays(columns, names=["query", "cell", "bound", "first"])

    return queries.select("id", "embedding").mapInArrow(run, "query long, cell int, bound double, first boolean")


def _scanned(probes: DataFrame, queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """query, id, score: the best k of every block of the probed cells, for each query that probes it."""
    n_q = max(1, -(-queries.count() // BLOCK))
    asked = probes.join(queries.select(F.col("id").alias("query"), "embedding"), "query").withColumn("q_block", F.pmod(F.xxhash64("query"), F.lit(n_q)).cast("int"))
    wanted = F.broadcast(probes.select("cell").distinct())  # a row a cell
    blocks = rows.select("cell", F.col("block").alias("x_block")).distinct()
    asked = asked.join(F.broadcast(blocks), "cell")  # a row a block of the index
    there = rows.withColumnRenamed("block", "x_block").join(wanted, "cell", "left_semi").withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))

    def best(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query": [], "id": [], "score": []})
        x = x.sort_values("id", kind="stable")
        s = units(pa.array(q["embedding"])) @ units(pa.array(x["embedding"])).T
        at = np.argsort(-s, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({"query": np.repeat(q["query"].to_numpy(), at.shape[1]), "id": x["id"].to_numpy()[at].ravel(), "score": np.take_along_axis(s, at, axis=1).ravel()})

    key = ["cell", "x_block", "q_block"]
    return asked.groupBy(*key).cogroup(there.groupBy(*key)).applyInPandas(best, "query long, id long, score double")


def search(spark: SparkSession, index: Cells, queries: DataFrame, k: int = 20, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(query, id, score, rank) of the k nearest rows by cosine that satisfy `where`, exactly; and (query, cells_read).

    queries: id, embedding; those without one find nothing. First the best cells of each query are read, then, once,
    all others whose bound reaches its k-th score so far (all, if the filter has left fewer than k). Ties: the least ids.
    """
    if not len(index.numbers):
        return spark.createDataFrame([], "query long, id long, score double, rank int"), spark.createDataFrame([], "query long, cells_read long")
    queries = queries.where("embedding IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = spark.read.parquet(index.path)
    rows = (rows if where is None else rows.where(where)).select(F.col("id").cast("long").alias("id"), "embedding", "cell", "block")
    probes = staged(_probes(queries, index, k), "probes")
    near = staged(ranked(_scanned(probes.where("first"), queries, rows, k), k), "near")
    floor = near.where(F.col("rank") == k - 1).select("query", F.col("score").alias("floor"))
    more = staged(probes.where("NOT first").join(floor, "query", "left").where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor"))).drop("floor"), "probes")
    both = near.drop("rank").unionByName(_scanned(more, queries, rows, k))
    read = probes.where("first").select("query").unionByName(more.select("query")).groupBy("query").agg(F.count("*").alias("cells_read"))
    return ranked(both, k), read
