"""Scans along an order: hot keys over many ranges, against plain loops."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tradewind.operators import scans


def plain_windows(times, length, state=None):
    """(start, hits) of all windows, the open one last."""
    out = [] if state is None else [list(state)]
    for t in times:
        if not out or t >= out[-1][0] + length:
            out.append([t, 0])
        out[-1][1] += 1
    return [tuple(w) for w in out]


TIMES = st.lists(st.integers(0, 60), min_size=1, max_size=40).map(sorted)


@settings(max_examples=300, deadline=None)
@given(TIMES, st.lists(st.integers(0, 40), max_size=3), st.integers(1, 20), st.one_of(st.none(), st.integers(0, 30)))
def test_passages_compose(times, cuts, length, before):
    cuts = sorted({0, len(times), *(min(c, len(times)) for c in cuts)})
    parts = [np.array(times[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    state = (None, 0) if before is None else (times[0] - before, 3)
    want = plain_windows(times, length, None if before is None else state)[-1]
    one_by_one, whole = state, None
    for p in parts:
        own = scans.Passage.of(p, length)
        one_by_one = own.after(*one_by_one)
        whole = own if whole is None else whole.then(own)
    assert one_by_one == want == whole.after(*state)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), TIMES), min_size=1, max_size=4, unique_by=lambda x: x[0]), st.integers(1, 20), st.integers(1, 9))
def test_advance_in_batches(users, length, size):
    rows = [(u, t) for u, times in sorted(users) for t in times]
    got, state = [], None
    for at in range(0, len(rows), size):
        u, t = (np.array(c) for c in zip(*rows[at : at + size]))
        *done, state = scans.advance(u, t, length, state)
        got += zip(*(d.tolist() for d in done))
    assert [*got, state] == [(u, *w) for u, times in sorted(users) for w in plain_windows(times, length)]


@pytest.fixture
def many_ranges(spark):
    """So many range partitions that a hot key fills several."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def hot_rows(n=6000):
    """Nine tenths of the rows belong to one key."""
    dice = random.Random(4)
    return [(1 if dice.random() < 0.9 else dice.choice([None, 2, 3, 4]), i, dice.choice([None, 1, 5, -2])) for i in range(n)]


def test_running_sums_of_a_hot_key(spark, many_ranges):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k long, at long, v long").repartition(5)
    found = scans.running_sums(df.withColumn("one", F.lit(1)), ["k"], ["at"], {"s": "v", "c": "one"})
    got = sorted((r.at, r.k, r.v, r.s, r.c) for r in found.collect())
    sums, want = {}, []
    for k, at, v in rows:
        s, c = sums.get(k, (0, 0))
        want.append((at, k, v, s, c))
        sums[k] = (s + (v or 0), c + 1)
    assert got == sorted(want)
    assert scans.running_sums(df.limit(0), ["k"], ["at"], {"s": "v"}).count() == 0


def test_ranges_of_a_hot_key_are_alike(spark, many_ranges):
    """The largest range holds no more than twice what the median one does, though one account has nine tenths of all rows."""
    df = spark.createDataFrame(hot_rows(20_000), "k long, at long, v long").repartition(5)
    sizes = sorted(r["count"] for r in scans.ranges(df, ["k"], ["at"]).groupBy("_part").count().collect())
    assert len(sizes) > 8 and sizes[-1] < 2 * sizes[len(sizes) // 2]


@pytest.mark.parametrize("seconds", [1, 40, 4000, 10**6])
def test_windows_of_a_hot_user(spark, many_ranges, seconds):
    dice = random.Random(seconds)
    start = datetime(2024, 1, 1)
    rows = [(u, start + timedelta(seconds=dice.randrange(9000), microseconds=dice.choice([0, 5]))) for u, _, _ in hot_rows(4000)] + [(7, None)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz").repartition(4)
    got = sorted(map(tuple, scans.first_hit_windows(df, 3, seconds).collect()))
    want = []
    for user in (1, 2, 3, 4):
        times = sorted(t for u, t in rows if u == user)
        want += [(user, s, h, min(h, 3)) for s, h in plain_windows(times, timedelta(seconds=seconds))]
    assert got == sorted(want)
    assert scans.first_hit_windows(df.limit(0), 3, seconds).count() == 0
