"""Scans along an order inside each key that spread a hot key over many tasks.

Rows are range partitioned by key and order, so a key with very many rows fills several ranges. Every range is
scanned on its own; what one range hands to the next is worked out from one small row a range. At most one key goes
on from a range into the next, so the rows that carry something over are fewer than the ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tradewind.sources.shared import staged


def changes(columns: list[pa.Array], before: tuple | None) -> np.ndarray:
    """Where a row's key differs from that of the row before; before is the key of the last row of the batch before."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    for c in columns:
        differs = pc.fill_null(pc.not_equal(c[1:], c[:-1]), True)
        both_null = pc.and_(pc.is_null(c[1:]), pc.is_null(c[:-1]))
        out[1:] |= np.asarray(pc.and_not(differs, both_null).to_numpy(zero_copy_only=False), dtype=bool)
    out[:1] = before is None or before != tuple(c[0].as_py() for c in columns)
    return out


def ranges(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows range partitioned and sorted by keys and order, with _part, the number of the range."""
    laid = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return laid.withColumn("_part", F.spark_partition_id())


def running_sums(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """rows with, for each name in sums, the sum of that long column over all earlier rows of the key (0 for the first).

    order must settle the order of a key's rows. Null values count as 0 and null keys are one key.
    """
    kept = rows.columns
    names = list(sums)
    laid = rows.withColumns({f"_{name}": F.coalesce(F.col(c).cast("long"), F.lit(0)) for name, c in sums.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, carried = None, np.zeros(len(names), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k) for k in keys]
            first = changes(columns, key)
            starts = np.flatnonzero(first)
            out = []
            for j, name in enumerate(names):
                values = batch.column(f"_{name}").to_numpy()
                ahead = np.concatenate([[0], np.cumsum(values)])
                base = np.zeros(batch.num_rows, np.int64)
                base[starts] = np.diff(ahead[starts], prepend=0)
                before = ahead[:-1] - np.cumsum(base)
                at = starts[0] if len(starts) else batch.num_rows
                before[:at] = ahead[:at] + carried[j]
                carried[j] = before[-1] + values[-1]
                out.append(pa.array(before))
            key = tuple(c[-1].as_py() for c in columns)
            arrays = [batch.column(c) for c in (*kept, "_part")] + [batch.column(f"_{n}") for n in names] + out
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "_part", *(f"_{n}" for n in names), *names])

    schema = StructType([*rows.schema.fields, StructField("_part", LongType()), *(StructField(f"_{n}", LongType()) for n in names), *(StructField(n, LongType()) for n in names)])
    found = staged(ranges(laid, keys, order).withColumn("_part", F.col("_part").cast("long")).mapInArrow(run, schema), "running")
    totals = found.groupBy(*keys, "_part").agg(*(F.sum(f"_{n}").alias(f"_{n}") for n in names))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_part").alias("_p"), *(F.sum(f"_{n}").over(earlier).alias(f"_o_{n}") for n in names))
    offsets = F.broadcast(offsets.where(F.col(f"_o_{names[0]}").isNotNull()))  # keys that go on from one range into another: fewer than ranges
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = found.join(offsets, same, "left")
    return joined.select(*kept, *((F.col(n) + F.coalesce(F.col(f"_o_{n}"), F.lit(0))).alias(n) for n in names))


# --- windows that open with a first hit ------------------------------------------------------------------------


def following(times: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """For every event, the first one of its key at least `length` later, or the number of events.

    ends: for every event, the place behind the last one of its key; a key's events are sorted by time.
    """
    n = len(times)
    rank = np.cumsum(np.concatenate([[0], (ends[1:] != ends[:-1])])) if n else np.zeros(0, np.int64)
    shifted = times - times.min(initial=0)
    span = int(shifted.max(initial=0)) + length + 1
    if n and int(rank[-1] + 1) * span < 2**62:
        at = np.searchsorted(rank * span + shifted, rank * span + shifted + length)
    else:  # times too far apart for one number: key by key
        at = np.empty(n, np.int64)
        for a in np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1]])):
            at[a : ends[a]] = a + np.searchsorted(times[a : ends[a]], times[a : ends[a]] + length)
    return np.where(at < ends, at, n)


def reached(entries: np.ndarray, jump: np.ndarray) -> np.ndarray:
    """All places on the paths from the entries, in order; twice as far each round."""
    n = len(jump)
    jump = np.concatenate([jump, [n]])
    found = entries[entries < n]
    while True:
        ahead = jump[found]
        ahead = ahead[ahead < n]
        if not len(ahead):
            return np.sort(found)
        found = np.concatenate([found, ahead])
        jump = jump[jump]


def advance(users: np.ndarray, times: np.ndarray, length: int, state: tuple[int, int, int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, int, int]]:
    """Closed windows (user, start, hits) of sorted events, and the open one of the last user.

    state is the open window (user, start, hits) that the events before have left.
    """
    n = len(times)
    starts = np.flatnonzero(np.concatenate([[True], users[1:] != users[:-1]]))
    ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    entries = starts.copy()
    done_u, done_s, done_h = [], [], []
    if state is not None:
        user, start, hits = state
        if user == users[0]:
            entries[0] = np.searchsorted(times[: ends[0]], start + length)
            hits += int(entries[0])
            if entries[0] == ends[0]:
                entries = entries[1:]
        if user != users[0] or len(entries) < len(starts) and len(starts) > 1 or len(entries) == len(starts):
            done_u, done_s, done_h = [user], [start], [hits]
    places = reached(entries, following(times, ends, length))
    if not len(places):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), (user, start, hits)
    hits_of = np.minimum(np.append(places[1:], n), ends[places]) - places
    open_ = (int(users[-1]), int(times[places[-1]]), int(hits_of[-1]))
    closed = places[:-1]
    put = lambda first, rest: np.concatenate([np.array(first, np.int64), rest.astype(np.int64)])
    return put(done_u, users[closed]), put(done_s, times[closed]), put(done_h, hits_of[:-1]), open_


class Passage:
    """What a range of one user's events makes of the window that is open before it.

    A window with start s <= limits[j] (and above limits[j - 1]) ends as (starts[j], hits[j]); one that starts later
    stays open and takes `size` more hits. Without an open window the first piece applies.
    """

    def __init__(self, limits: np.ndarray, starts: np.ndarray, hits: np.ndarray, size: int):
        self.limits, self.starts, self.hits, self.size = limits, starts, hits, size

    @classmethod
    def of(cls, times: np.ndarray, length: int) -> Passage:
        n = len(times)
        ahead = following(times, np.full(n, n), length)
        last = np.where(ahead < n, ahead, np.arange(n))
        while True:
            further = last[last]
            if (further == last).all():
                break
            last = further
        _, first = np.unique(times[: ahead[0] + 1], return_index=True)  # a window that is open is no older than the range
        return cls(times[first] - length, times[last[first]], n - last[first], n).thinned()

    def thinned(self) -> Passage:
        keep = np.append(self.starts[1:] != self.starts[:-1], True)
        return Passage(self.limits[keep], self.starts[keep], self.hits[keep], self.size)

    def after(self, start: int | None, hits: int) -> tuple[int, int]:
        at = 0 if start is None else np.searchsorted(self.limits, start)
        return (start, hits + self.size) if at == len(self.limits) else (int(self.starts[at]), int(self.hits[at]))

    def then(self, other: Passage) -> Passage:
        at = np.searchsorted(other.limits, self.starts)
        stays = at == len(other.limits)
        put = np.minimum(at, len(other.limits) - 1)
        starts = np.where(stays, self.starts, other.starts[put])
        hits = np.where(stays, self.hits + other.size, other.hits[put])
        later = other.limits > self.limits[-1]  # for what stays open in the first range
        return Passage(np.append(self.limits, other.limits[later]), np.append(starts, other.starts[later]), np.append(hits, other.hits[later]), self.size + other.size).thinned()


PASSAGE = "user_id long, part long, limits array<long>, starts array<long>, hits array<long>, size long"


def _passage_row(user: int, part: int, p: Passage) -> pd.DataFrame:
    return pd.DataFrame([(user, part, p.limits, p.starts, p.hits, p.size)], columns=["user_id", "part", "limits", "starts", "hits", "size"])


def _passage(pdf: pd.DataFrame) -> Passage:
    r = pdf.iloc[0]
    return Passage(np.asarray(r.limits, np.int64), np.asarray(r.starts, np.int64), np.asarray(r.hits, np.int64), int(r["size"]))


def open_before(laid: DataFrame, length: int) -> list:
    """user_id, part, start, hits, goes_on of every range of a user with several: the window that is open when it
    begins (start is null in the first one). There are fewer than twice as many rows as ranges.

    Every such range becomes a passage; passages are composed with the ones before them, twice as far each round,
    in pairs of two ranges a task, so the number of rounds is the logarithm of the ranges of the hottest user.
    """
    spans = laid.groupBy("user_id").agg(F.min("_part").alias("first"), F.max("_part").alias("last")).where(F.col("first") < F.col("last"))
    spans = F.broadcast(spans)  # one user at most goes on from a range into the next
    some = laid.join(spans, "user_id")

    def passage(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _passage_row(*key, Passage.of(np.sort(pdf["t"].to_numpy()), length))

    own = staged(some.groupBy("user_id", F.col("_part").cast("long").alias("part")).applyInPandas(passage, PASSAGE), "passages")
    order = Window.partitionBy("user_id").orderBy("part")
    own = own.join(own.select("user_id", "part", F.row_number().over(order).alias("i"), F.count("*").over(Window.partitionBy("user_id")).alias("n")), ["user_id", "part"])
    numbered = staged(own, "passages")
    most = numbered.agg(F.max("n")).first()[0]
    far, now = 1, numbered
    while most is not None and far < most:
        behind = now.select("user_id", (F.col("i") + far).alias("i"), *(F.col(c).alias(c) for c in ("part", "limits", "starts", "hits", "size", "n")))

        def composed(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            """a: what ends at range i; b: what ends `far` ranges earlier."""
            if not len(a):
                return a
            p = _passage(a) if not len(b) else _passage(b).then(_passage(a))
            out = a.copy()
            out["limits"], out["starts"], out["hits"], out["size"] = [p.limits], [p.starts], [p.hits], [p.size]
            return out

        now = staged(now.groupBy("user_id", "i").cogroup(behind.groupBy("user_id", "i")).applyInPandas(composed, now.schema), "passages")
        far *= 2
    ends = now.select("user_id", (F.col("i") + 1).alias("i"), F.col("starts")[0].alias("start"), F.col("hits")[0].alias("open_hits"))
    rows = numbered.select("user_id", "part", "i", (F.col("i") < F.col("n")).alias("goes_on")).join(ends, ["user_id", "i"], "left")
    return rows.select("user_id", "part", "start", "open_hits", "goes_on").collect()


def first_hit_windows(events: DataFrame, limit: int, seconds: int) -> DataFrame:
    """Windows that open with a user's first hit and last so many seconds: user_id, window_start, hits, allowed.

    events: user_id (long) and ts; rows without one of them are left out. Every range of a user's events is scanned
    on its own, a batch at a time and without a step for each event; the windows that are open where a range begins
    are worked out from the ranges' passages.
    """
    length = seconds * 1_000_000
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.where("user_id IS NOT NULL AND ts IS NOT NULL").select(F.col("user_id").cast("long").alias("user_id"), micros.alias("t"))
    laid = staged(ranges(rows, ["user_id"], ["t"]), "hits")
    known = {(r.user_id, r.part): (r.start, r.open_hits, r.goes_on) for r in open_before(laid, length)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task reads whole ranges, in order; part tells where one begins."""
        state, part, last_key = None, None, None

        def rows_of(users, starts, hits) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(users), pa.array(starts), pa.array(hits)], names=["user_id", "start", "hits"])

        def closing() -> Iterator[pa.RecordBatch]:
            if state is not None and not known.get(last_key, (None, None, False))[2]:
                yield rows_of(*(np.array([v]) for v in state))

        for batch in batches:
            parts = batch.column("_part").to_numpy()
            users, times = batch.column("user_id").to_numpy(), batch.column("t").to_numpy()
            cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1), len(parts)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if parts[a] != part:
                    yield from closing()
                    part = parts[a]
                    start, hits, _ = known.get((int(users[a]), int(part)), (None, None, False))
                    state = None if start is None else (int(users[a]), start, hits)
                *done, state = advance(users[a:b], times[a:b], length, state)
                last_key = (state[0], int(part))
                yield rows_of(*done)
        yield from closing()

    whole = laid.repartition("_part").sortWithinPartitions("_part", "user_id", "t")  # a file of a range may be read by several tasks
    found = whole.select("_part", "user_id", "t").mapInArrow(run, "user_id long, start long, hits long")
    return found.select("user_id", F.timestamp_micros("start").cast("timestamp_ntz").alias("window_start"), "hits", F.least("hits", F.lit(limit)).cast("long").alias("allowed"))
