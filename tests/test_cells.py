"""The index of cells against a plain search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradewind.operators import cells

SCHEMA = "id long, embedding array<double>, colour string"


def plain(rows, queries, k, keep=lambda r: True):
    x = [r for r in rows if r[1] is not None and keep(r)]
    unit = lambda v: np.asarray(v) / max(np.linalg.norm(v), 1e-300)
    out = set()
    for q, v, _ in queries:
        if v is not None:
            scored = sorted((-round(float(unit(v) @ unit(u)), 9), i) for i, u, _ in x)[:k]
            out |= {(q, i, -s, n) for n, (s, i) in enumerate(scored)}
    return out


@pytest.fixture(scope="module")
def clustered():
    dice = np.random.default_rng(3)
    centres = dice.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + dice.normal(size=16) * 0.05).tolist(), "red" if i % 5 else "blue") for i in range(1500)]
    rows += [(i, rows[3][1], "red") for i in range(1500, 1600)] + [(2000, None, "red"), (2001, [0.0] * 16, "blue")]
    return rows


@pytest.mark.parametrize("block", [40, 2048])
def test_search_is_exact_and_reads_few_cells(spark, tmp_path, clustered, block):
    df = spark.createDataFrame(clustered, SCHEMA).repartition(5)
    asked = [clustered[i] for i in (0, 3, 1501, 1600, 1601, 700)]
    queries = spark.createDataFrame(asked, SCHEMA)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(cells, "BLOCK", block)
        index = cells.build(df, f"file://{tmp_path}/index")
        found, read = cells.search(spark, index, queries, 7)
        got = {(r.query, r.id, round(r.score, 9), r.rank) for r in found.collect()}
        assert got == plain(clustered, asked, 7)
        shares = {r.query: r.cells_read / len(index.numbers) for r in read.collect()}
        assert all(shares[q] < 0.5 for q in (0, 3, 700, 1501)), shares
        scoped = cells.search(spark, index, queries, 7, F.col("colour") == "blue")[0]
        assert {(r.query, r.id, round(r.score, 9), r.rank) for r in scoped.collect()} == plain(clustered, asked, 7, lambda r: r[2] == "blue")
        assert cells.search(spark, index, queries, 7, F.lit(False))[0].count() == 0


def test_bounds_hold(clustered):
    x = np.array([v for _, v, _ in clustered[:1500]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = cells.centres_of(x, 20)
    own = (x @ c.T).argmax(axis=1)
    widest = np.array([np.arccos(np.clip((x[own == j] @ c[j]).min(initial=1), -1, 1)) for j in range(len(c))])
    index = cells.Cells("", np.arange(len(c)), c, widest, np.bincount(own, minlength=len(c)))
    bounds = index.bounds(x[::50])
    for j in range(len(c)):
        if (own == j).any():
            assert ((x[::50] @ x[own == j].T).max(axis=1) <= bounds[:, j]).all()


def test_empty_index(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "red")], SCHEMA)
    index = cells.build(df, f"file://{tmp_path}/none")
    assert len(index.numbers) == 0
    assert cells.search(spark, index, df, 3)[0].count() == 0
