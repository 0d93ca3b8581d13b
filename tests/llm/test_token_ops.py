"""Packing, token files and BPE against the tokenizers library."""

import hashlib
import os
import random
import tracemalloc
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF
from tradewind.llm import bpe, packing, rangecoder, registry, tokenfiles, tokenization
from tradewind.llm.registry import vocabulary

TEXTS = ["Hello, WORLD it's 12", "", None, "  two  spaces \n\n lines\n", "é É ﬁ İ. ΣΑΣ क़ 日本 😀", "<|endoftext|>x <|startoftext|>", "word " * 3000, "a" * 5000, "x.\nY\n\nZ ", "same", "same", " ", "a b c\x1cd"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 5 else None, t, "en", i, i) for i, t in enumerate(TEXTS)] + [(9, "same", "en", 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, length int, sequence_id int").repartition(3)


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    return lambda s: t.encode(s or "", add_special_tokens=False).ids, t


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunk_memo_equals_library(name, spaced):
    encode, _ = library(name)
    tokenizer = tokenization.ChunkTokenizer(vocabulary(name), spaced, capacity=100)
    rng = random.Random(1)
    atoms = ["foo", "Bar", "é", "İ", "क़", " ", "  ", "\n", "\t", ".", "'s", "<|endoftext|>", "12", "½", "\xa0", "ΣΑΣ", "\r\n", "\x1c"]
    for _ in range(150):
        texts = ["".join(rng.choice(atoms) + " " * (rng.random() < 0.5) for _ in range(rng.randint(0, 25))) for _ in range(5)]
        assert tokenizer.encode(texts) == [array("I", encode(t)).tobytes() for t in texts]


def test_packing_covers_every_id_once(spark, docs):
    encode, _ = library("byte_bpe_50k.json")
    rows = packing.pack(docs, vocabulary("byte_bpe_50k.json")).toPandas()
    want = sorted((-1 if r.doc_id is None else r.doc_id, tuple(encode(r.text) + [1])) for r in docs.collect())
    fill = rows.groupby("sequence_id").length.sum()
    assert fill.max() <= 2048
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
    got = []  # every id of every document lies in exactly one piece
    for doc, g in rows.assign(doc=rows.doc_id.fillna(-1).astype(int)).groupby("doc"):
        same = [ids for d, ids in want if d == doc]
        assert set(g.doc_tokens) == {len(ids) for ids in same} or len(same) > 1
        for ids in {i for i in same}:
            pieces = sorted((r.start, r.length, r.ids_crc32) for r in g.itertuples() if r.doc_tokens == len(ids))
            copies = same.count(ids)
            at = 0
            for start, length, crc in pieces[::copies]:
                assert start == at and crc == zlib.crc32(array("I", ids[at : at + length]).tobytes())
                at += length
            assert at == len(ids) and len(pieces) % copies == 0
            got += [ids] * copies
    assert sorted(got) == sorted(ids for _, ids in want)
    assert len(rows[rows.doc_id == 1]) == 1 and rows.doc_id.isna().sum() == 1
    assert packing.pack(docs.limit(0), vocabulary("byte_bpe_50k.json")).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 300), min_size=1, max_size=40))
def test_differencing_respects_capacity(sizes):
    found, k = packing.windows_within(sizes, 300)
    assert np.bincount(found, weights=sizes, minlength=k).max() <= 300 and len(found) == len(sizes) and found.max() < k


def test_differencing_is_near_equal():
    rng = np.random.default_rng(3)
    sizes = rng.integers(20, 200, 400).tolist()
    sums = np.bincount(packing.differencing(sizes, 20), weights=sizes)
    assert sums.max() - sums.min() <= 5


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.lists(st.integers(0, 2**32 - 1), max_size=1500), st.lists(st.integers(0, 3), max_size=3000)))
def test_range_coder_round_trip(ids):
    assert rangecoder.decode_block(rangecoder.encode_block(np.array(ids, dtype=np.int64))).tolist() == ids


def test_range_coder_learns_and_notices_damage():
    ids = np.tile(np.arange(50), 400)
    block = rangecoder.encode_block(ids)
    assert len(block) < len(ids) // 2
    for at in (0, 20, len(block) // 2, len(block) - 1):
        broken = bytearray(block)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            rangecoder.decode_block(bytes(broken))


def test_token_files(spark, docs, tmp_path):
    encode, _ = library("word_bpe_49k.json")
    path = f"file://{tmp_path}/tokens"
    tokenfiles.write_tokens(docs, path, vocabulary("word_bpe_49k.json"), block_ids=500)
    got = sorted(tokenfiles.read_tokens(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in docs.collect()), key=lambda d: (d is not None, d))
    at, by_text = 0, {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        ids = encode(by_text[r.doc_id]) + [2]
        assert (r.start, r.n_tokens, r.ids, r.ids_crc32) == (at, len(ids), ids, zlib.crc32(array("I", ids).tobytes()))
        at += len(ids)
    assert tokenfiles.written_and_read(docs.limit(0), vocabulary("word_bpe_49k.json")).count() == 0


def test_bpe_equals_library(spark, docs):
    encode, t = library("word_bpe_49k.json")
    want = sorted((len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(t.decode(i, skip_special_tokens=False).encode()).hexdigest()) for i in (encode(r.text) for r in docs.collect()))
    rows = bpe.encode_decode(docs, vocabulary("word_bpe_49k.json"), with_text=True).collect()
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    assert all(r.decoded == t.decode(r.ids, skip_special_tokens=False) for r in rows)


def test_query_packs_every_id_of_every_document(spark):
    encode, _ = library("byte_bpe_50k.json")
    docs = {r.doc_id: encode(r.text) + [1] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = registry.op1_packing(spark, SF).toPandas().sort_values(["doc_id", "start"])
    assert set(rows.doc_id) == set(docs)
    for doc, g in rows.groupby("doc_id"):
        assert g.start.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() == len(docs[doc])
        assert [zlib.crc32(array("I", docs[doc][a : a + n]).tobytes()) for a, n in zip(g.start, g.length)] == g.ids_crc32.tolist()
    windows = rows.groupby("sequence_id").length.sum()
    assert windows.max() <= 2048 and 1 - windows.sum() / (2048 * len(windows)) < 0.05


def test_queries_of_word_tokens_equal_the_library(spark):
    encode, t = library("word_bpe_49k.json")
    docs = {r.doc_id: encode(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in registry.op10_bpe(spark, SF).collect():
        ids = docs[r.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    at = 0
    for r in sorted(registry.op5_token_files(spark, SF).collect(), key=lambda r: r.doc_id):
        ids = docs[r.doc_id] + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(array("I", ids).tobytes()))
        at += len(ids)


def test_every_word_runs_through_the_transducer(monkeypatch):
    encode, _ = library("word_bpe_49k.json")
    w = bpe.WordBpe(vocabulary("word_bpe_49k.json"))
    taken = []
    stream = w.merges.stream
    monkeypatch.setattr(w.merges, "stream", lambda symbols: stream(taken.append(s) or s for s in symbols))
    text = "several words, several of them again"
    assert w.encode(text).tolist() == encode(text)
    assert len(taken) == sum(map(len, {"several", "words", ",", "of", "them", "again"}))


@pytest.mark.parametrize(("stretch", "long"), [(65_536, 1_024), (64, 16), (160, 40)])
def test_streamed_units_equal_library(monkeypatch, stretch, long):
    encode, _ = library("word_bpe_49k.json")
    w = bpe.WordBpe(vocabulary("word_bpe_49k.json"))
    monkeypatch.setattr(w, "STRETCH", stretch)
    monkeypatch.setattr(w, "LONG", long)
    rng = random.Random(5)
    atoms = ["foo", "É", "e", "\u0301", " ", "\n", ".", "'s", "'", "'re", "<|endoftext|>", "<|", "12", "\xa0", "Σ", "ς", "日本", "\u1100\u1161", "x" * 30, "!" * 20, "\x1c"]
    for _ in range(400):
        text = "".join(rng.choice(atoms) + " " * (rng.random() < 0.05) for _ in range(rng.randint(0, 45)))
        assert w.encode(text).tolist() == encode(text)


def test_memory_does_not_grow_with_a_text(spark):
    w, peaks = bpe.WordBpe(vocabulary("word_bpe_49k.json")), []
    for n in (20_000, 60_000):
        text = "ab!cd" * n
        tracemalloc.start()
        assert sum(map(len, w.stretches(text))) > 0
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0] < 3_000_000


def test_range_coder_beats_order_0_where_contexts_tell():
    rng = np.random.default_rng(2)
    after = rng.integers(0, 5000, (5000, 2))
    ids = [0]
    for choice in rng.random(60_000) < 0.9:
        ids.append(int(after[ids[-1], 0 if choice else 1]))
    ids = np.array(ids)
    p = np.bincount(ids) / len(ids)
    plain = -(p[p > 0] * np.log2(p[p > 0])).sum() * len(ids) / 8
    assert len(rangecoder.encode_block(ids)) < 0.75 * plain


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=4), min_size=1, max_size=30), st.data())
def test_blocks_of_words_round_trip(spelled, data):
    words = np.array(data.draw(st.lists(st.integers(0, len(spelled) - 1), max_size=400)), dtype=np.int64)
    block = rangecoder.encode_words(words, np.array([i for w in spelled for i in w], dtype=np.int64), np.array([len(w) for w in spelled]))
    assert rangecoder.decode_block(block).tolist() == [i for w in words for i in spelled[w]]


def test_word_row_equals_library():
    encode, _ = library("word_bpe_49k.json")
    tokenizer = tokenization.ChunkTokenizer(vocabulary("word_bpe_49k.json"), False, capacity=100)
    rng = random.Random(4)
    atoms = ["foo", "Bar", "é", "É", "À", "ß", "ÿ", "Þ", "İ", "क़", " ", "  ", "\n", "\t", ".", "),", "#$", "_", "'s", "'", "''", "<|endoftext|>", "<|", "12", "½", "\xa0", "ΣΑΣ", "\r\n", "\x1c", "\x7f", "×", "÷"]
    for _ in range(600):
        some = rng.sample(atoms, rng.choice([6, 14, len(atoms)]))
        texts = [rng.choice([None, ""]) if rng.random() < 0.1 else "".join(rng.choice(some) + " " * (rng.random() < 0.3) for _ in range(rng.randint(0, 25))) for _ in range(6)]
        row, counts, words = tokenizer.word_row(pa.array(["cut", *texts, "off"]).slice(1, 6), b"\2\0\0\0")
        ends = np.cumsum(counts).tolist()
        assert ends[-1] == len(row)
        assert [np.frombuffer(b"".join(words[i] for i in row[e - n : e]), dtype="<u4").tolist() for e, n in zip(ends, counts.tolist())] == [[*encode(t or ""), 2] for t in texts]


def test_a_word_is_coded_at_once(spark, monkeypatch):
    """On the documents of sf0.01, words take fewer codings than ids would, in hardly more bytes."""
    tokenizer = tokenization.ChunkTokenizer(vocabulary("word_bpe_49k.json"), False, capacity=1_000_000)
    texts = [t for (t,) in registry.table(spark, f"{os.path.dirname(SF)}/sf0.01", "documents").orderBy("doc_id").select("text").collect()]
    row, _, words = tokenizer.word_row(pa.array(texts, pa.string()), b"\2\0\0\0")
    spelling, lengths = np.frombuffer(b"".join(words), dtype="<u4"), np.array([len(w) // 4 for w in words])
    ids = rangecoder.spelled_out(row, spelling, lengths)
    taken, put = [], rangecoder._Encoder.put
    monkeypatch.setattr(rangecoder._Encoder, "put", lambda self, start, *rest: taken.append(len(start)) or put(self, start, *rest))
    block = rangecoder.encode_words(row, spelling, lengths)
    assert sum(taken) < 0.8 * len(ids) and (rangecoder.decode_block(block) == ids).all()
    assert len(block) < 1.05 * len(rangecoder.encode_block(ids))


@pytest.mark.parametrize("block_ids", [40, 100_000])
def test_documents_keep_their_order_in_blocks(spark, tmp_path, block_ids):
    """Texts of one id a byte fill more blocks than their bytes tell; texts of any kind lie beside each other."""
    encode, _ = library("word_bpe_49k.json")
    texts = ["1" * 300, None, "plain words", "it's «quoted»", "", "<|endoftext|>", "2" * 90, "x", "日本 " * 50]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    path = f"file://{tmp_path}/tokens"
    tokenfiles.write_tokens(docs, path, vocabulary("word_bpe_49k.json"), block_ids=block_ids)
    got = sorted(tokenfiles.read_tokens(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.ids) for r in got] == [(i, [*encode(t or ""), 2]) for i, t in enumerate(texts)]


def test_range_coder_on_documents(spark):
    """Far below the static order-0 entropy of the same ids, and exact."""
    encode, _ = library("word_bpe_49k.json")
    ids = np.array([i for (t,) in registry.table(spark, SF, "documents").orderBy("doc_id").select("text").toLocalIterator() for i in [*encode(t or ""), 2]])
    p = np.bincount(ids) / len(ids)
    block = rangecoder.encode_block(ids)
    assert (rangecoder.decode_block(block) == ids).all()
    assert len(block) < 0.9 * -(p[p > 0] * np.log2(p[p > 0])).sum() * len(ids) / 8


def test_stream_of_symbols_equals_merging_at_once():
    rng = random.Random(11)
    for _ in range(300):
        k, rules, seen = rng.randint(1, 3), [], set()
        symbols = list(range(k))
        for _ in range(rng.randint(1, 25)):
            pair = (rng.choice(symbols), rng.choice(symbols))
            if pair not in seen:
                seen.add(pair)
                rules.append((*pair, len(symbols)))
                symbols.append(len(symbols))
        merges = bpe.Merges(rules)
        s = [rng.randrange(k) for _ in range(rng.randint(0, 500))]
        assert list(merges.stream(s)) == merges.merged(s)


def test_stream_with_rules_in_any_order():
    rng = random.Random(2)
    for _ in range(200):
        rules, symbols = {}, [0, 1, 2]
        for _ in range(rng.randint(1, 12)):
            rules.setdefault((rng.choice(symbols), rng.choice(symbols)), len(symbols))
            symbols = [0, 1, 2, *rules.values()]
        listed = [(*pair, c) for pair, c in rules.items()]
        rng.shuffle(listed)
        merges = bpe.Merges(listed)
        s = [rng.randrange(3) for _ in range(rng.randint(0, 60))]
        for stretch in (1, 16):
            assert list(merges.stream(s, stretch)) == merges.merged(s)


def test_tokens_come_out_inside_words(spark):
    """On the documents, tokens are emitted before their word has ended, by both rules; and they are the library's."""
    encode, _ = library("word_bpe_49k.json")
    w = bpe.WordBpe(vocabulary("word_bpe_49k.json"))
    texts = [t or "" for (t,) in registry.table(spark, SF, "documents").select("text").collect()]
    assert all(list(encode(t)) == [i for part in w.stretches(t) for i in array("I", part)] for t in texts)
    assert w.merges.early > 500
    words = sorted({x for t in texts for x in w.word.findall(w.normalised(t))}, key=len)[-200:]
    w.merges.joined = {(x << bpe.ID_BITS | y) for x in [*w.inner, *w.last] for y in [*w.inner, *w.last]}  # only the lookahead is left
    w.merges.early = 0
    assert all(list(w.merges.stream(w.symbols(x), 4)) == w.merges.merged(w.symbols(x)) for x in words) and w.merges.early > 0


def test_bytes_decoder_takes_split_characters():
    d = bpe.BytesDecoder(["".join(bpe.byte_alphabet()[b] for b in part) for part in ("é".encode()[:1], "é".encode()[1:], b"x")])
    assert d.feed([0]) == "" and d.feed([1, 2]) == "éx" and d.finish() == ""
