"""Language id, quality rules, archive, dedup, near duplicates, sharding and the pipeline."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from compare import same
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline
from tradewind.llm import archive, components, dedup, jaccard, langid, members, quality, registry, sharding
from tradewind.llm.common import staged


def table(spark, rows, extra=True):
    schema = "doc_id long, text string" + (", lang string, n int, kept string, digest string" if extra else "")
    return spark.createDataFrame([(*r, "en", 1, "k", "d") if extra else r for r in rows], schema)


ODD = [(1, "a b c"), (2, None), (None, "a b c"), (4, ""), (4, ""), (5, "A B C"), (6, "é É"), (7, "  \n"), (8, "long " * 20_000), (8, None)]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    same(registry.QUERIES[name](spark, SF), duck, registry.ORACLES[name])


# --- quality ---


def brute_repeats(words, w=8):
    windows = [tuple(words[i : i + w]) for i in range(len(words) - w + 1)]
    n = Counter(windows)
    return len({i + j for i, x in enumerate(windows) if n[x] > 1 for j in range(w)})


def test_repeats():
    rng = random.Random(2)
    for _ in range(200):
        words = [rng.choice("ab") for _ in range(rng.randint(0, 30))]
        assert quality._repeated(words) == brute_repeats(words)


def test_quality_cases(spark):
    got = quality.judged(table(spark, ODD), keep=("lang",))
    assert got.count() == len(ODD) and not got.where("doc_id = 2").first().kept
    long = got.where("doc_id = 8 AND n_words > 0").first()
    assert (long.n_words, long.n_repeat_words, long.base_failed) == (20_000, 20_000, True)
    assert quality.judged(table(spark, ODD).limit(0)).count() == 0
    clean = " ".join(f"word{i}" for i in range(60))
    assert quality.judged(table(spark, [(1, clean)])).first().kept


def test_ablation_counts(spark):
    entries = spark.createDataFrame([(0,), (1,), (3,), (8,)], "fail_bits long")
    rows = {(r.policy, r.rule): r for r in quality.ablation(entries, (quality.BASE, quality.STRICT)).collect()}
    base = rows["base", "few_words"]
    assert (base.n_docs, base.n_kept, base.n_failing, base.n_failing_only_this) == (4, 2, 2, 1)
    assert rows["strict", "symbols"].n_failing_only_this == 1 and len(rows) == 7


# --- language id ---


def test_language_accuracy_and_inputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    got = registry.op2_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got[got.held_out].lang_pred == got[got.held_out].lang).mean() > 0.95 and got.score.between(0, 1).all()
    texts = docs.select("text")
    alone = langid.predict(texts, model).toPandas().sort_values("text")
    full = langid.predict(docs.withColumn("lang", F.lit("xx")), model).toPandas().sort_values("text")
    assert alone.lang_pred.tolist() == full.lang_pred.tolist()


def test_language_cases(spark):
    model = langid.train(table(spark, [(i, "the cat and the dog") for i in range(30)]))
    got = langid.predict(table(spark, ODD), model)
    assert got.count() == len(ODD) and {r.lang_pred for r in got.where("text IS NULL OR trim(text) = '' OR text = '  \n'").collect()} == {"und"}
    assert langid.train(table(spark, ODD).limit(0)) is None
    assert {r.lang_pred for r in langid.predict(table(spark, ODD), None).collect()} == {"und"}


def test_ftrl_equals_a_plain_loop():
    rng = random.Random(3)
    how = langid.Training(epochs=2, l1=0.01, l2=0.2)
    examples = [(np.array(sorted(rng.sample(range(30), 4)), dtype=np.int32), np.array([rng.random() + 0.1 for _ in range(4)]), rng.randrange(3)) for _ in range(40)]
    got_w, got_b = langid.fit_ftrl(examples, 3, how)
    z, n = defaultdict(float), defaultdict(float)

    def weight(f, c):
        if abs(z[f, c]) <= how.l1:
            return 0.0
        return -(z[f, c] - math.copysign(how.l1, z[f, c])) / ((how.beta + math.sqrt(n[f, c])) / how.alpha + how.l2)

    order = np.random.default_rng(7)
    for _ in range(how.epochs):
        for i in order.permutation(len(examples)):
            at, x, y = examples[i]
            pairs = [*zip(at.tolist(), x.tolist()), (langid.DIM, 1.0)]
            w = {(f, c): weight(f, c) for f, _ in pairs for c in range(3)}
            s = [sum(w[f, c] * v for f, v in pairs) for c in range(3)]
            total = sum(math.exp(v) for v in s)
            for f, v in pairs:
                for c in range(3):
                    g = v * (math.exp(s[c]) / total - (c == y))
                    sigma = (math.sqrt(n[f, c] + g * g) - math.sqrt(n[f, c])) / how.alpha
                    z[f, c] += g - sigma * w[f, c]
                    n[f, c] += g * g
    assert np.allclose(got_w[:30], [[weight(f, c) for c in range(3)] for f in range(30)], atol=1e-5)
    assert np.allclose(got_b, [weight(langid.DIM, c) for c in range(3)], atol=1e-6)


def plain_features(text):
    """Hashed character 1- to 3-grams of the lower-cased text, one at a time."""
    c, n = [ord(x) for x in text.lower()], Counter()
    for i in range(len(c)):
        key = 0
        for back in range(min(3, i + 1)):
            key = (key + c[i - back] * int(langid.MULTIPLIERS[back])) % 2**32
            n[((key ^ key >> 15) * 0x2C1B3C6D % 2**32) >> (32 - langid.BITS)] += 1
    return n


def test_language_query_equals_brute_force(spark):
    """The whole query: held-out fold, document frequencies, weights, temperature and predictions, text by text."""
    docs = registry.table(spark, SF, "documents")
    hashed = F.pmod(F.xxhash64(F.lit("langid"), F.col("doc_id").cast("string"), F.length("text")), F.lit(1 << 30)).alias("h")
    rows = docs.select("doc_id", "text", "lang", hashed).collect()
    out = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows}
    features = {r.doc_id: plain_features(r.text or "") for r in rows}
    train = [r for r in rows if not out[r.doc_id] and r.text is not None and r.lang is not None]
    df = Counter(f for r in train for f in features[r.doc_id])
    idf = lambda f: math.log((1 + len(train)) / (1 + df[f])) + 1
    classes = sorted({r.lang for r in train})

    def vector(r):
        x = {f: n * idf(f) for f, n in sorted(features[r.doc_id].items())}
        norm = max(math.sqrt(sum(v * v for v in x.values())), 1e-9)
        return {f: v / norm for f, v in x.items()}

    at = lambda r: np.array(sorted(features[r.doc_id]), dtype=np.int32)
    train.sort(key=lambda r: (r.h, r.lang, at(r).tobytes()))
    examples = [(at(r), np.array(list(vector(r).values())), classes.index(r.lang)) for r in train]
    w, b = langid.fit_ftrl([e for i, e in enumerate(examples) if i % 5], len(classes), langid.Training())  # a plain loop checks it above
    tuning = examples[::5]
    t = langid.fit_temperature(np.array([x @ w[i] + b for i, x, _ in tuning]), np.array([y for *_, y in tuning]))
    got = {r.doc_id: r for r in registry.op2_language_id(spark, SF).collect()}
    assert len(got) == len(rows) and len(train) >= 50
    for r in rows:
        g = got[r.doc_id]
        assert g.held_out == out[r.doc_id]
        if not any(map(str.isalpha, r.text or "")):
            assert (g.lang_pred, g.score) == (langid.UNDETERMINED, 0.0)
            continue
        logits = [sum(v * float(w[f, k]) for f, v in vector(r).items()) + float(b[k]) for k in range(len(classes))]
        p = [math.exp((s - max(logits)) / t) for s in logits]
        assert g.lang_pred == classes[p.index(max(p))] and g.score == pytest.approx(max(p) / sum(p), abs=1e-3)


def test_temperature_has_the_least_loss():
    rng = np.random.default_rng(4)
    logits = rng.normal(size=(400, 3)) * 5
    y = np.array([rng.choice(3, p=np.exp(v / 2.5) / np.exp(v / 2.5).sum()) for v in logits])

    def loss(t):
        s = logits / t - (logits / t).max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))

    found = langid.fit_temperature(logits, y)
    assert loss(found) <= min(loss(t) for t in np.linspace(0.5, 10, 300)) + 1e-6 and 1.8 < found < 3.5


def test_ngrams_do_not_depend_on_stretches():
    text = "abcé " * 300_000
    whole = langid.ngram_counts(text)
    assert whole.sum() == 3 * len(text) - 3


# --- archive ---


def test_a_hot_payload_is_split(spark, tmp_path, monkeypatch):
    """Nine tenths of the records share a payload: it meets them in parts, and the result is the same."""
    monkeypatch.setattr(archive, "LOT", 20)
    rows = [(i, "u" * (i % 3), "x" * 1200 if i % 10 else f"{i} " * 300) for i in range(400)] + [(400, "u", None), (401, "v", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    path = f"file://{tmp_path}/warc"
    archive.write_archive(pages, path)
    read = archive.read_archive(spark, path)
    got = {r.page_id: (r.record_type, r.refers_to, bytes(r.payload).decode()) for r in read.collect()}
    assert got == {i: ("revisit" if i % 10 and i < 399 and t and t[0] == "x" else "response", 399 if i % 10 and i < 399 and t and t[0] == "x" else None, t or "") for i, _, t in rows}
    assert spark.read.parquet(f"{path}/payloads").count() == 42


def test_archive_round_trip(spark, tmp_path):
    body, small = "x" * 1200, "tiny"
    rows = [(1, "u", body), (2, "u\r\n", body), (3, None, small), (4, "u", small), (5, "u", None), (6, "u", "é" * 700), (7, "u", "WARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    path = f"file://{tmp_path}/w"
    archive.write_archive(pages, path)
    got = {r.page_id: r for r in archive.record_bytes(archive.read_archive(spark, path)).collect()}
    assert len(got) == 7 and got[1].record_type == "revisit" and got[1].refers_to == 2 and got[2].refers_to is None
    assert got[3].record_type == got[4].record_type == "response"
    assert all(bytes(got[i].payload) == (h or "").encode() for i, _, h in rows)
    assert bytes(got[2].record).endswith(body.encode() + b"\r\n\r\n") and b"Content-Length: 1200\r\n" in bytes(got[2].record) and b"Content-Length: 0\r\n" in bytes(got[1].record)
    assert archive.archived(pages.limit(0)).count() == 0
    assert spark.read.parquet(f"{path}/payloads").count() == 5


# --- exact dedup ---


def weak(content):
    return F.unhex(F.substring(F.sha2(content.cast("binary"), 256), 1, 2))


@pytest.mark.parametrize("digest", [dedup.sha256, lambda c: F.lit(b"x"), weak])
def test_exact_groups(spark, digest):
    rows = [(i % 23 if i % 11 else None, ["a", "A", "b", None, "", "é", "É", "c d"][i % 8]) for i in range(120)]
    fold = lambda t: (t or "").translate(str.maketrans(dedup.UPPER, dedup.LOWER))
    want = defaultdict(list)
    for d, t in rows:
        want[fold(t)].append(-1 if d is None else d)
    got = dedup.groups(table(spark, rows).repartition(5), digest=digest).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.keep_id is None else r.keep_id, r.group_size) for r in got) == sorted((d, max(g), len(g)) for g in want.values() for d in g)
    assert sum(r.kept for r in got) == len(want)


def test_state_over_many_batches(spark):
    arrivals = staged(spark.range(400).select((F.col("id") % 70).cast("string").cast("binary").alias("digest"), F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("text_hash"), F.lit("f").alias("locator"), F.col("id").alias("row")).repartition(12), "arrivals")
    got = dedup.run_stream(arrivals, files_per_batch=1).collect()
    assert len(got) == 70 and sum(r.group_size for r in got) == 400 and all(r.holder.doc_id >= 330 for r in got)


def test_state_batch_again(spark, tmp_path):
    state = dedup.KeyedState(spark, f"file://{tmp_path}/s")
    rows = spark.createDataFrame([(b"d", 1, 1, "f")], "digest binary, doc_id long, `row` long, locator string")
    state.update(rows, 0)
    state.update(rows, 1)
    state.update(rows, 1)  # a batch that is run again counts once
    assert state.entries().first().group_size == 2


def test_groups_meet_their_state(spark, monkeypatch):
    before = []
    update = dedup.KeyedState.update
    monkeypatch.setattr(dedup.KeyedState, "update", lambda self, arrivals, number: (before.append(len(self.versions(number))), update(self, arrivals, number))[1])
    rows = [(i, f"text {i % 50}") for i in range(200)]
    got = dedup.groups(table(spark, rows).repartition(40)).collect()
    assert before[:3] == [0, 1, 2] and len(got) == 200
    assert all(r.group_size == 4 and r.keep_id == 150 + r.doc_id % 50 for r in got) and sum(r.kept for r in got) == 50


def test_state_is_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(b"d", 1, 1, "f")], "digest binary, doc_id long, `row` long, locator string")
    for i in (0, 1, 2, 3, 3, 4):  # number 3 is run again after it was compacted
        dedup.KeyedState(spark, f"file://{tmp_path}/s", compact=3).update(rows, i)
    state = dedup.KeyedState(spark, f"file://{tmp_path}/s", compact=3)
    assert state.entries().first().group_size == 5 and [v.rsplit("/", 1)[1] for v in state.versions()] == ["until-3", "batch-4"]


@pytest.mark.parametrize("written", [True, False])
def test_a_crash_counts_nothing_twice(spark, tmp_path, monkeypatch, written):
    rows = spark.range(60).select((F.col("id") % 7).cast("string").cast("binary").alias("digest"), F.col("id").alias("doc_id"), F.col("id").alias("row"), F.lit("f").alias("locator"))
    arrivals, path = staged(rows.repartition(6), "arrivals"), f"file://{tmp_path}/state"
    update = dedup.KeyedState.update

    def crashing(self, batch, number):
        if number == 1 and not written:
            raise RuntimeError("lost")
        update(self, batch, number)
        if number == 1:
            raise RuntimeError("lost")  # its version is written, but the stream does not know

    monkeypatch.setattr(dedup.KeyedState, "update", crashing)
    with pytest.raises(Exception, match="lost"):
        dedup.run_stream(arrivals, files_per_batch=2, path=path)
    monkeypatch.undo()
    other = staged(rows.where("id < 0"), "arrivals")
    if not written:
        with pytest.raises(ValueError, match="run it again first"):
            dedup.run_stream(other, path=path)
    for _ in range(2):  # goes on, then finds nothing new
        got = dedup.run_stream(arrivals, files_per_batch=2, path=path).collect()
        assert len(got) == 7 and sum(r.group_size for r in got) == 60 and all(r.holder.doc_id >= 53 for r in got)


def test_the_state_is_met_whatever_the_files(spark, monkeypatch):
    """The query's table is one file; three of its four batches look up and merge earlier versions."""
    before = []
    update = dedup.KeyedState.update
    monkeypatch.setattr(dedup.KeyedState, "update", lambda self, arrivals, number: (before.append(len(self.versions(number))), update(self, arrivals, number))[1])
    registry.op6_exact_dedup(spark, SF.replace("0.001", "0.01")).count()
    assert len(before) >= 4 and before[:4] == [0, 1, 2, 3]


def test_a_locator_names_the_row(spark, tmp_path):
    spark.createDataFrame([(i, f"text {i % 3}") for i in range(9)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/t")
    rows, located = dedup.placed(spark.read.parquet(f"{tmp_path}/t").select("doc_id", "text"))
    assert located and sorted((r.doc_id, r.place.row) for r in rows.collect()) == [(i, i) for i in range(9)]
    assert not dedup.placed(spark.range(3))[1]


def test_durable_state_goes_on(spark, tmp_path):
    for begin in (0, 60):
        rows = spark.range(begin, begin + 60).select((F.col("id") % 40).cast("string").cast("binary").alias("digest"), F.col("id").alias("doc_id"), F.col("id").alias("row"), F.lit("f").alias("locator"))
        got = {r.digest: r for r in dedup.run_stream(staged(rows.repartition(6), "arrivals"), files_per_batch=2, path=f"file://{tmp_path}/state").collect()}
    assert len(got) == 40 and all(r.group_size == 3 and r.holder.doc_id == 80 + int(bytes(d)) for d, r in got.items())


def test_member_test_never_misses(spark):
    keys = spark.range(0, 2000, 7).withColumn("id", F.when(F.col("id") != 0, F.col("id")))
    maybe = members.member_test(keys, "id")
    passed = {r.id for r in spark.range(2000).where(maybe(F.col("id"))).collect()}
    assert set(range(7, 2000, 7)) <= passed and len(passed) < 600


# --- near duplicates ---


def brute_classes(rows, t=Fraction(4, 5), k=5):
    sets = {}
    for d, text in rows:
        w = (text or "").encode().split()
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()
    root = {d: d for d in sets}
    links = Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b]:
                i = len(sets[a] & sets[b])
                if Fraction(i, len(sets[a] | sets[b])) >= t:
                    links[a] += 1
                    links[b] += 1
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {d: (find(d), links[d]) for d in ids}


@pytest.mark.parametrize("block", [512, 4])
def test_similar_equals_brute_force(spark, block):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randint(20, 120))] for _ in range(6)]
    rows = [(i, None) for i in range(3)] + [(3, ""), (4, "one two"), (5, "one two"), (6, "one two three")]
    for i in range(7, 150):
        w = list(base[i % 6])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = "edit"
        rows.append((i, " ".join(w)))
    got = jaccard.similar(table(spark, rows).repartition(3), how=jaccard.Settings(block=block)).collect()
    want = brute_classes(rows)
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == want
    assert sum(r.kept for r in got) == len({c for c, _ in want.values()})


def test_similar_cases(spark):
    got = jaccard.similar(table(spark, ODD)).collect()
    assert len(got) == len(ODD) and sum(r.kept for r in got) == 9
    assert jaccard.similar(table(spark, ODD).limit(0)).count() == 0


def test_posterior_tolerance():
    least = jaccard.least_matches(0.8, 1e-6)
    rng = np.random.default_rng(1)
    hits = rng.random((20_000, jaccard.HASHES)) < 0.8
    lost = np.zeros(len(hits), dtype=bool)
    for i, m in enumerate(least):
        lost |= hits[:, : (i + 1) * jaccard.LOOK].sum(axis=1) < m
    assert lost.mean() < 1e-3 and least == sorted(least)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


# --- sharding ---


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_feistel_is_a_permutation(n):
    place = sharding.feistel(np.arange(n), n, 9)
    assert sorted(place.tolist()) == list(range(n))
    assert sharding.feistel(place, n, 9, inverse=True).tolist() == list(range(n))


def test_shards(spark):
    rows = sharding.shard(table(spark, ODD * 5)).toPandas()
    counts = rows["shard"].value_counts()
    assert len(rows) == 50 and counts.max() - counts.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in rows.groupby("shard"))
    assert set(rows[rows["size"] == 1].text_crc32) == {0} and sharding.shard(table(spark, ODD).limit(0)).count() == 0


def plain_place(x, n, seed):
    """The same permutation of whole numbers, by Python's own numbers."""
    m64 = 2**64 - 1

    def mix(v, key):
        v = (v + key) * 0x9E3779B97F4A7C15 & m64
        v = (v ^ v >> 32) * 0xD6E8FEB86659FD93 & m64
        return v ^ v >> 32

    half = max(1, ((n - 1).bit_length() + 1) // 2)
    keys = [mix(seed, r + 1) for r in range(6)]
    while True:
        left, right = x >> half, x & (1 << half) - 1
        for key in keys:
            left, right = right, left ^ mix(right, key) & (1 << half) - 1
        x = left << half | right
        if x < n:
            return x


def test_shards_equal_brute_force(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect(), key=lambda r: r.doc_id)
    want = {}
    for i, r in enumerate(docs):
        place, raw = plain_place(i, len(docs), 20_260), (r.text or "").encode()
        want[r.doc_id] = (len(raw) + 1, zlib.crc32(raw), "rows", place % 8, place // 8, None)
    got = {r.doc_id: (r["size"], r.text_crc32, r.law, r["shard"], r.slot, r.grown_shard) for r in registry.op9_sharding(spark, SF).collect()}
    assert got == want


# --- pipeline ---


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    measured = {r.doc_id: quality.measure(r.text) for r in rows}
    ok = [r for r in rows if measured[r.doc_id][0] >= 20 and 100 * measured[r.doc_id][4] <= 30 * measured[r.doc_id][0]]
    current, counts = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        current = staged(stage(spark, current, SF), "test")
        counts[name] = current
    judged = {r.doc_id for r in counts["quality_rules"].collect()}
    assert judged <= {r.doc_id for r in ok} and len(judged) > 0.9 * len(ok)
    assert counts["language_id"].count() >= 0.99 * len(judged)
    by_text = defaultdict(list)
    for r in counts["language_id"].collect():
        by_text[r.text.translate(str.maketrans(dedup.UPPER, dedup.LOWER))].append(r.doc_id)
    exact = counts["exact_dedup"].collect()
    assert sorted(r.doc_id for r in exact) == sorted(max(g) for g in by_text.values())
    classes = brute_classes([(r.doc_id, r.text) for r in exact])
    assert sorted(r.doc_id for r in counts["near_dedup"].collect()) == sorted({c for c, _ in classes.values()})
    assert {r.doc_id for r in counts["packing"].collect()} == {r.doc_id for r in counts["near_dedup"].collect()}
    assert counts["near_dedup"].columns == docs.columns
    assert hashlib.sha256(b"").hexdigest()  # the whole run again gives the same pieces
    again = corpus_pipeline.run(spark, SF)
    assert again.agg(F.sum("length")).first()[0] == counts["packing"].agg(F.sum("length")).first()[0]


def test_pipeline_of_an_unlabelled_corpus(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).withColumn("lang", F.lit(None).cast("string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    clean = corpus_pipeline.quality_rules(spark, docs, SF)
    assert corpus_pipeline.language_id(spark, clean, SF).count() == clean.count() > 0
    odd = table(spark, ODD + [(9, "12 34"), (10, "1 é")]).withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.language_id(spark, odd, SF)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 5, 6, 8, 10]
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() > 0
