"""Stupid-backoff scores against a plain version."""

import math
import random
from collections import Counter

import pytest

from tradewind.llm import lmscore, registry


def plain(rows, back=0.4):
    split = [(d, (t or "").encode().lower().split()) for d, t in rows]
    one = Counter(w for _, x in split for w in x)
    two = Counter(p for _, x in split for p in zip(x, x[1:]))
    total, out = sum(one.values()), []
    for d, x in split:
        s = 0.0
        for i, w in enumerate(x):
            s += math.log(two[x[i - 1], w] / one[x[i - 1]]) if i and two[x[i - 1], w] else math.log(back * one[w] / total)
        out.append((-1 if d is None else d, len(x), max(0, len(x) - 1), pytest.approx(s, rel=1e-9, abs=1e-6)))
    return sorted(out, key=lambda r: r[:3])


def rows_of(got):
    return sorted(((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_bigrams, r.log_score) for r in got), key=lambda r: r[:3])


@pytest.mark.parametrize(("common", "stretch"), [(200_000, 4_000_000), (3, 100), (0, 1)])
def test_scores(spark, monkeypatch, common, stretch):
    monkeypatch.setattr(lmscore, "COMMON", common)
    monkeypatch.setattr(lmscore, "STRETCH", stretch)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("a b c d e f g h i j k l É".split()) for _ in range(rng.randint(1, 40)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n "), (103, "Unique words here"), (103, "Unique words here"), (None, "a b c"), (104, "a b " * 3000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row int, gram string").repartition(3)
    got = lmscore.score(docs).collect()
    assert rows_of(got) == plain(rows)
    assert all((r.mean_log_score is None) == (r.n_words == 0) for r in got)


def test_empty(spark):
    assert lmscore.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_table_leaves_out_only_bigrams_that_occur_once(spark):
    docs = spark.createDataFrame([("a b c a b",), ("b c",), (None,)], "t string").repartition(3)
    got = {r.gram: r.c for r in lmscore.count_table(docs).collect()}
    w = lmscore.words_of("a b c a b")
    assert got == {int(g.astype("int64")): c for g, c in [(w[0], 2), (w[1], 3), (w[2], 2), (lmscore.bigrams_of(w)[0], 2), (lmscore.bigrams_of(w)[1], 2)]}


def test_query_backs_off_at_count_zero_only(spark, tmp_path):
    rows = [(1, "a b c a b"), (2, "a b once seen"), (3, "Alone"), (4, None), (4, None), (5, "b a c c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(registry.op7_lm_scoring(spark, f"file://{tmp_path}").collect()) == plain(rows)
