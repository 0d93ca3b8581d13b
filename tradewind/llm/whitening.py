"""Whitening of embeddings by hierarchical merging of singular value decompositions.

Every partition of the distinct vectors keeps a summary: its number of rows, its exact sums and all singular values
and vectors of its centred rows. Two summaries merge by stacking both, a row that corrects for the difference of
their means, and a decomposition of the stack, which keeps every dimension; so nothing is lost on the way up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import staged

#: A coordinate is counted in steps of 1 / SCALE.
SCALE = 256
COMPONENTS = 4
#: Summaries that one task merges at a time.
FAN_IN = 16
SUMMARY = "part long, n long, sums array<long>, factor binary"
LONG = 2**63
#: Entries from here on count as not finite: their whole steps are not exact in a double.
MOST = float(2**53 // SCALE)


@dataclass
class Summary:
    """n rows with exact sums; factor has at most as many rows as dimensions, and factor.T @ factor is the centred scatter."""

    n: int
    sums: np.ndarray
    factor: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Summary:
        """Of rows of whole numbers."""
        if len(x) * max(int(x.max()), -int(x.min())) >= LONG:
            raise OverflowError("a sum does not fit a long")
        sums = x.sum(axis=0)
        return cls(len(x), sums, reduced(x - sums / len(x)))

    def merged(self, other: Summary) -> Summary:
        n = self.n + other.n
        if any(abs(int(a) + int(b)) >= LONG for a, b in zip(self.sums, other.sums, strict=True)):
            raise OverflowError("a sum does not fit a long")
        apart = self.sums / self.n - other.sums / other.n
        row = np.sqrt(self.n / n * other.n) * apart
        return Summary(n, self.sums + other.sums, reduced(np.concatenate([self.factor, other.factor, row[None]])))

    def row(self, part: int) -> tuple:
        return part, self.n, self.sums.tolist(), self.factor.tobytes()

    @classmethod
    def read(cls, n: int, sums, factor: bytes) -> Summary:
        sums = np.asarray(sums, dtype=np.int64)
        return cls(int(n), sums, np.frombuffer(factor).reshape(-1, len(sums)))


def reduced(rows: np.ndarray) -> np.ndarray:
    """All singular values times their right vectors: at most as many rows as there are dimensions."""
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * v


def merged(summaries: Iterator[Summary]) -> Summary:
    """In the order given, in pairs, then pairs of pairs."""
    level = list(summaries)
    while len(level) > 1:
        level = [a[0].merged(a[1]) if len(a) == 2 else a[0] for a in (level[i : i + 2] for i in range(0, len(level), 2))]
    return level[0]


def matrix(batch: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)


@dataclass
class Model:
    """The fit: n vectors, exact sums, and for each component (columns, by falling eigenvalue) what it explains."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates; NaN for components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (x - self.sums / self.n) @ self.components / np.sqrt(self.eigenvalues)
        out[:, self.eigenvalues <= 0] = np.nan
        return out

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - sums)^2 as whole numbers; those beyond a long are refused."""
        most = self.n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max((abs(int(v)) for v in self.sums), default=0)
        if most * most * max(1, x.shape[1]) < LONG:
            apart = self.n * x - self.sums
            return (apart * apart).sum(axis=1).tolist()
        apart = self.n * x.astype(object) - self.sums.astype(object)
        out = (apart * apart).sum(axis=1).tolist()
        if any(v >= LONG for v in out):
            raise OverflowError("a deviation does not fit a long")
        return out


def cleaned(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, x: the rows whose vector is there and finite throughout, in whole steps, of the commonest length (ties: the longer)."""
    v = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < MOST))
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & finite)
    rows = rows.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long")).alias("x"))
    lengths = rows.where(F.size("x") > 0).groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("x") == (lengths.d if lengths else 0)).where(F.lit(lengths is not None))


def fit(vectors: DataFrame, dim: int, components: int = COMPONENTS) -> Model:
    """The fit over a table of distinct vectors (x). Every task streams its rows into one summary; summaries are
    merged FAN_IN at a time, level by level, each group in a task of its own. The last one, of one matrix as wide and
    high as there are dimensions, comes to the driver."""

    def summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = None, 0
        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
                own = Summary.of(matrix(batch, "x", dim))
                held = own if held is None else held.merged(own)
        if held is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(("part", "n", "sums", "factor"), held.row(part), strict=True))])

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("part")
        one = merged(Summary.read(r.n, r.sums, r.factor) for r in rows.itertuples())
        return pd.DataFrame([one.row(rows["part"].iloc[0] // FAN_IN)], columns=["part", "n", "sums", "factor"])

    level = staged(vectors.select("x", F.spark_partition_id().cast("long").alias("part")).mapInArrow(summarised, SUMMARY), "whitening-summaries")
    while level.count() > 1:
        level = staged(level.groupBy(F.floor(F.col("part") / FAN_IN).alias("group")).applyInPandas(together, SUMMARY), "whitening-summaries")
    last = level.first()
    one = Summary.read(last.n, last.sums, last.factor)
    _, s, v = np.linalg.svd(one.factor, full_matrices=False)
    k = min(components, dim)
    s = np.concatenate([s, np.zeros(dim - len(s))])
    v = np.concatenate([v, np.zeros((max(0, k - len(v)), dim))])
    eigenvalues = s * s / one.n
    least = (s[0] * np.finfo(float).eps * max(one.n, dim)) ** 2 / one.n  # variance that is rounding only
    eigenvalues[eigenvalues <= least] = 0
    trace = eigenvalues.sum()
    return Model(one.n, one.sums, v[:k].T, eigenvalues[:k], eigenvalues[:k] / trace if trace > 0 else np.zeros(k))


def identity_error(vectors: DataFrame, dim: int, model: Model) -> float | None:
    """The largest absolute entry of the whitened fit list's covariance less the identity, over components with variance.

    Of each task one small matrix of sums is kept, and Spark adds them up entry by entry.
    """
    live = np.flatnonzero(model.eigenvalues > 0)
    if not len(live):
        return None

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(live), len(live) + 1))
        for batch in batches:
            w = model.projected(matrix(batch, "x", dim))[:, live]
            total += np.concatenate([w.T @ w, w.sum(axis=0)[:, None]], axis=1)
        place = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total.ravel())], names=["place", "value"])

    sums = vectors.select("x").mapInArrow(products, "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
    total = np.array([r.value for r in sums.orderBy("place").collect()]).reshape(len(live), -1) / model.n  # 20 numbers at most
    mean = total[:, -1]
    return float(np.abs(total[:, :-1] - np.outer(mean, mean) - np.eye(len(live))).max())


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of each vector along the leading principal components of the distinct vectors.

    Returns vec_id, component (from 1, by falling eigenvalue), n (distinct vectors), deviation (the exact sum over
    dimensions of (n * x - sums)^2), whitened, explained (the eigenvalue's share of the whole variance) and
    identity_error (one value). x is a coordinate times 256, rounded down to a whole number. A vector has a row for each of the
    first `components` components, or as many as it has dimensions.

    Dropped: rows whose vector is null or has null, NaN or infinite entries (or ones from 2^45 on), empty vectors, and vectors that do not
    have the commonest length (ties: the longer). Null ids and repeated ids or rows are kept as they come; repeated
    vectors count once in the fit. A component without variance has whitened null, and without any variance
    identity_error is null. An empty table gives no rows. Other columns of embeddings, whatever their names, are not read.

    Equal vectors are reduced in each task before the shuffle, so one that very many rows hold is no hot key.
    """
    rows = cleaned(embeddings, id_col, vector_col)
    distinct = staged(rows.select("x").distinct(), "whitening-vectors")
    first = distinct.first()
    if first is None:
        return embeddings.sparkSession.createDataFrame([], OUT)
    dim = len(first.x)
    model = fit(distinct, dim, components)
    error = identity_error(distinct, dim, model)
    k = len(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch, "x", dim)
            values = model.projected(x)
            each = np.repeat(np.arange(batch.num_rows), k)
            columns = [
                batch.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), model.n)),
                pa.array(model.deviations(x), pa.int64()).take(pa.array(each)), pa.array(values.ravel(), from_pandas=True), pa.array(np.tile(model.explained, len(x))), pa.array([error] * len(each), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, OUT)
