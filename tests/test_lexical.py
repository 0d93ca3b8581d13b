"""Word similarity: bounds, scores and the search, against plain versions."""

import re

import numpy as np
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from tradewind.operators import lexical
from tradewind.plans import content
from tradewind.plans.catalog import Tables


def sequence(text):
    return [p[i : i + 3] for w in re.findall(r"[^\W_]+", text.lower()) for p in (f"  {w} ",) for i in range(len(p) - 2)]


def plain_score(query, text):
    """The greatest |query & E| / |query | E| over all stretches E of the text's trigrams."""
    q, s = set(sequence(query)), sequence(text)
    return max((len(q & set(s[i:j])) / len(q | set(s[i:j])) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=0.0) if q else 0.0


def pair(query, text):
    q, codes = np.unique(lexical.trigram_codes(query)), lexical.trigram_codes(text)
    return len(q), lexical.repeats_of(codes), np.isin(codes, q)


TEXT = st.text("ab c_É", max_size=24)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_codes_are_the_trigrams(text):
    codes, grams = lexical.trigram_codes(text), sequence(text)
    assert len(codes) == len(grams)
    assert [int(c) for c in codes] == [ord(g[0]) << 42 | ord(g[1]) << 21 | ord(g[2]) for g in grams]
    assert [int(b) for b in lexical.repeats_of(codes)] == [max((j for j in range(i) if grams[j] == g), default=-1) for i, g in enumerate(grams)]


@settings(max_examples=200, deadline=None)
@given(TEXT, TEXT, st.integers(1, 5), st.sampled_from([5, 2_000_000]))
def test_bounds_hold_and_scores_are_exact(query, text, stride, cells):
    n, before, hit = pair(query, text)
    if not n or not hit.any():
        return
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(lexical, "CELLS", cells)
        bounds = lexical.stretch_bounds(n, before, hit, stride)
        starts = np.flatnonzero(hit)
        for s in starts:
            assert bounds[s // stride] >= lexical.stretch_score(n, before, hit, np.array([s]))
        assert lexical.stretch_score(n, before, hit, starts) == plain_score(query, text)


def test_few_chunks_are_scored_for_names_of_products(spark):
    """The names are no words of the chunks, so all scores are low and near one another."""
    t = Tables(spark, SF.replace("0.001", "0.01"))
    texts = [r.text for r in content.chunk_items(t).orderBy("id").limit(1500).collect()]
    block = lexical.BlockSearch(texts, 20, 0.1)
    grams = [np.unique(lexical.trigram_codes(r.text)) for r in content.product_queries(t).collect()]
    for query, shared in zip(grams, block.shared(grams), strict=True):
        block.best(query, shared, np.arange(len(texts)))
    assert block.pairs == len(grams) * len(texts) and 0 < block.verified < 0.08 * block.pairs


def test_documented_example():
    n, before, hit = pair("word", "two words")
    assert lexical.stretch_score(n, before, hit, np.flatnonzero(hit)) == 0.8


@settings(max_examples=80, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=30), st.lists(TEXT, min_size=1, max_size=4), st.integers(1, 6), st.sampled_from([0.0, 0.1, 0.4]), st.sampled_from([0, 64]))
def test_block_search_equals_brute_force(texts, queries, k, least, short):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(lexical, "SHORT", short)
        patch.setattr(lexical, "TAKEN", 4)
        patch.setattr(lexical, "COUNTED", 20)
        block = lexical.BlockSearch(texts, k, least)
        grams = [np.unique(lexical.trigram_codes(q)) for q in queries]
        ids = np.array([(7 * i) % len(texts) + 100 * i % 3 for i in range(len(texts))])
        for q, g, shared in zip(queries, grams, block.shared(grams), strict=True):
            assert [int(c) for c in shared] == [len(set(sequence(q)) & set(sequence(t))) for t in texts]
            want = sorted(((-s, int(ids[i])) for i, t in enumerate(texts) if (s := plain_score(q, t)) > least))[:k]
            assert [(-s, int(ids[i])) for s, i in block.best(g, shared, ids)] == want


def test_search_over_blocks(spark):
    words = ["river", "stone", "bridge", "garden", "window", "lamp"]
    items = [(i, " ".join(words[(i * j) % 6] + str(i % 7) for j in range(1, 5))) for i in range(60)] + [(60, None), (61, ""), (62, "river0 " * 1_000)]
    queries = [(1, "river stone"), (2, "garden3 lamp3"), (3, None), (4, "zzz")]
    q, x = spark.createDataFrame(queries, "id long, text string"), spark.createDataFrame(items, "id long, text string")
    found = lexical.block_topk(q, x, 5, 0.1, query_block=2, item_block=20)
    got = sorted((r.query, r.id, r.score) for r in lexical.ranked(found.where("id IS NOT NULL"), 5).collect())
    want = []
    for name, text in queries:
        scores = sorted((-plain_score(text or "", t[:140] if t else ""), i) for i, t in items)
        want += [(name, i, -s) for s, i in scores if -s > 0.1][:5]
    assert got == sorted(want)
    assert lexical.lexical_topk(q.limit(0), x).count() == lexical.lexical_topk(q, x.limit(0)).count() == 0


def test_jaccard_over_blocks(spark):
    texts = [(i, " ".join(w + str(i % 5) for w in ("river", "stone", "lamp")[: 1 + i % 3])) for i in range(50)] + [(50, None), (51, "")]
    df = spark.createDataFrame(texts, "id long, text string")
    got = {(r.query, r.id, r.score) for r in lexical.jaccard_topk(df.where("id % 10 = 0"), df, 4, query_block=2, item_block=9).collect()}
    sets = {i: set(sequence(t or "")) for i, t in texts}
    want = set()
    for q in range(0, 51, 10):
        scored = sorted((-len(sets[q] & s) / len(sets[q] | s), i) for i, s in sets.items() if sets[q] & s)[:4]
        want |= {(q, i, -s) for s, i in scored}
    assert got == want


def test_few_pairs_of_passages_and_chunks_are_scored(spark):
    t = Tables(spark, SF.replace("0.001", "0.01"))
    items = content.chunk_items(t).select("id", "text")
    (work,) = lexical.search_work(lexical.block_topk(content.asked(t), items, 20, 0.1)).collect()
    assert work.pairs == items.count() and 0 < work.verified < 0.1 * work.pairs


def test_equal_queries_are_searched_once(spark):
    q = spark.createDataFrame([(i, "river stone") for i in range(40)] + [(40, None), (41, "")], "id long, text string")
    x = spark.createDataFrame([(i, f"river stone{i % 3}") for i in range(30)], "id long, text string")
    assert lexical.asked_once(q)[0].count() == 2
    got = lexical.lexical_topk(q, x, 5).collect()
    one = [(r.id, r.score, r["rank"]) for r in got if r.query == 0]
    assert len(one) == 5 and sorted((r.query, r.id, r.score, r["rank"]) for r in got) == sorted((i, *r) for i in range(40) for r in one)


@settings(max_examples=100, deadline=None)
@given(TEXT, st.lists(TEXT, min_size=1, max_size=20))
def test_short_items_are_scored_together(query, texts):
    grams = np.unique(lexical.trigram_codes(query))
    block = lexical.BlockSearch(texts, 5, 0.0)
    hit = np.zeros(len(block.grams), bool)
    hit[block.known(grams)] = True
    taken = np.array([i for i, t in enumerate(texts) if set(sequence(query)) & set(sequence(t))], int)
    if len(taken):
        assert list(block.short_scores(len(grams), taken, hit, 0.0)) == [plain_score(query, texts[i]) for i in taken]


@settings(max_examples=100, deadline=None)
@given(TEXT, st.lists(TEXT, min_size=1, max_size=10))
def test_hit_bounds_hold(query, texts):
    grams = np.unique(lexical.trigram_codes(query))
    block = lexical.BlockSearch(texts, 5, 0.0)
    hit = np.zeros(len(block.grams), bool)
    hit[block.known(grams)] = True
    at = np.flatnonzero(hit[block.gram]) if len(block.gram) else np.zeros(0, int)
    for place, bound in zip(at, block.hit_bounds(len(grams), at, block.item[at]), strict=True):
        i = block.item[place]
        piece = slice(block.offsets[i], block.offsets[i] + block.lengths[i])
        assert bound >= lexical.stretch_score(len(grams), block.before[piece] - block.offsets[i], hit[block.gram[piece]], np.array([place - block.offsets[i]]))


def test_of_equal_items_only_the_least_ids_are_compared(spark):
    q = spark.createDataFrame([(i, "river") for i in range(3)], "id long, text string")
    x = spark.createDataFrame([(i, ("river", "rivers")[i % 2]) for i in range(400)], "id long, text string")
    got = {(r.query, r.id) for r in lexical.jaccard_topk(q, x, 4).collect()}
    assert got == {(i, j) for i in range(3) for j in (0, 2, 4, 6)}
    items = lexical.least_copies(x, 4)
    assert sorted(r.id for r in items.collect()) == list(range(8))


@settings(max_examples=80, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=30), st.lists(TEXT, min_size=1, max_size=8), st.integers(1, 6), st.sampled_from([0.0, 0.1, 0.4]), st.sampled_from([0, 3, 64]), st.sampled_from([1, 4, 32]))
def test_search_of_groups_equals_brute_force(texts, queries, k, least, short, seldom):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(lexical, "SHORT", short)
        patch.setattr(lexical, "SELDOM", seldom)
        patch.setattr(lexical, "TOGETHER", 2)
        patch.setattr(lexical, "CELLS", 200)
        queries = [q + end for q in queries for end in ("", " 17", " 18", " 1")]
        texts = [*texts, *(t + " 17 b" for t in texts[:3])]
        ids = np.array([(7 * i) % len(texts) + 100 * i % 3 for i in range(len(texts))])
        found = lexical.BlockSearch(texts, k, least).search([np.unique(lexical.trigram_codes(q)) for q in queries], ids)
        for q, (best, *_) in zip(queries, found, strict=True):
            want = sorted(((-s, int(ids[i])) for i, t in enumerate(texts) if (s := plain_score(q, t)) > least))[:k]
            assert [(-s, int(ids[i])) for s, i in best] == want


def test_queries_that_differ_in_seldom_trigrams_are_searched_together():
    """Names with numbers: one search for each name, and few items for each number."""
    items = [f"{a} {b} {i}" for i, (a, b) in enumerate((a, b) for _ in range(40) for a in ("large", "small") for b in ("ring", "bolt", "gear"))]
    queries = [np.unique(lexical.trigram_codes(f"{a} ring {i}")) for a in ("large", "small") for i in range(100, 200)]
    found = lexical.BlockSearch(items, 5, 0.1).search(queries, np.arange(len(items)))
    assert sum(pairs for _, pairs, _, _ in found) == len(queries) * len(items)
    assert sum(verified for _, _, _, verified in found) < 0.05 * len(queries) * len(items)


def test_few_queries_are_sent_to_the_items(spark):
    words = ["river", "stone", "bridge", "garden", "window", "lamp"]
    items = [(i, " ".join(words[(i * j) % 6] + str(i % 7) for j in range(1, 5))) for i in range(200)] + [(200, None), (201, "")]
    queries = [(1, "river stone"), (2, "garden3 lamp3"), (3, ""), (4, "zzz"), (5, " ".join(w + "1" for w in words) * 3)]
    x, q = spark.createDataFrame(items, "id long, text string"), spark.createDataFrame(queries, "id long, text string")
    blocks = lexical.ranked(lexical.block_topk(q, x, 5, 0.1).where("id IS NOT NULL").select("query", "id", "score"), 5)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(lexical, "CHARACTERS", 400)
        scanned = lexical.ranked(lexical.scanned_topk(queries, x, 5, 0.1), 5)
        rows = lambda df: sorted((r.query, r["rank"], r.id, r.score) for r in df.collect())
        assert len(rows(blocks)) == 15 and rows(scanned) == rows(blocks)
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" not in plan
