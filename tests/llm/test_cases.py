"""Every operator and every stage over nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tradewind.llm import archive, bpe, dedup, jaccard, langid, lmscore, packing, quality, sharding, tokenfiles
from tradewind.llm.registry import vocabulary

CLEAN = " ".join(f"clean{i % 37}word{i}" for i in range(60))
ROWS = [(1, CLEAN), (2, None), (None, CLEAN), (None, None), (4, ""), (4, ""), (5, " \n\t"), (6, "é É 12"), (7, CLEAN), (7, CLEAN), (8, CLEAN.upper()), (9, " ".join(f"long{i}" for i in range(60_000))), (10, "x" * 100_000)]
CLASHES = "_own _h _id _hash _pred _m kept digest row node score lang_pred n_words length gram own_0 seen_0 made_0 policy document page_id payload".split()
BYTES, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")

OPERATORS = {
    "packing": lambda d: packing.pack(d, BYTES).where("start = 0"),
    "langid": lambda d: langid.predict(d, langid.train(d)),
    "quality": quality.judged,
    "archive": lambda d: archive.archived(d, id_col="doc_id", url_col="lang", body_col="text").withColumnRenamed("page_id", "doc_id"),
    "tokenfiles": lambda d: tokenfiles.written_and_read(d, WORDS),
    "dedup": dedup.groups,
    "lmscore": lmscore.score,
    "jaccard": jaccard.similar,
    "sharding": sharding.shard,
    "bpe": lambda d: bpe.encode_decode(d, WORDS),
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame([(*r, "en") for r in ROWS], "doc_id long, text string, lang string").repartition(3)
    return rows.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operator(docs, name):
    got = OPERATORS[name](docs)
    ids = sorted(-1 if r.doc_id is None else r.doc_id for r in got.select("doc_id").collect())
    assert ids == sorted(-1 if d is None else d for d, _ in ROWS)
    assert OPERATORS[name](docs.limit(0)).count() == 0


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES[:-1])
def test_stage(spark, docs, name, stage):
    got = stage(spark, docs, "")
    assert got.columns == docs.columns
    rows = got.collect()
    assert all(r[c] == f"own {c}" for r in rows for c in CLASHES)
    assert {r.doc_id for r in rows} <= {d for d, _ in ROWS} and len(rows) <= len(ROWS) and rows
    assert stage(spark, docs.limit(0), "").count() == 0


def test_last_stage(spark, docs):
    """Packing: every row's ids once, whatever its columns are; rows that repeat an id have pieces of their own."""
    _, pack = corpus_pipeline.STAGES[-1]
    got = pack(spark, docs, "").collect()
    whole = {-1 if d is None else d for d, _ in ROWS}
    assert {-1 if r.doc_id is None else r.doc_id for r in got} == whole
    assert sum(r.doc_tokens for r in got if r.start == 0) == sum(r.length for r in got)
    used = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert used.get(r.sequence_id, 0) == r.offset
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 2048
    assert pack(spark, docs.limit(0), "").count() == 0


def test_repeated_and_missing_page_ids(spark):
    body = "x" * 1200
    pages = spark.createDataFrame([(1, "u", body), (2, "u", body), (2, "v", body), (None, "u", body), (None, "u", "y" * 1200), (None, "u", "y" * 1200), (3, "u", "tiny"), (3, "u", "tiny")], "page_id long, url string, html string")
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in archive.archived(pages).collect())
    assert got == [(0, "response", 0), (0, "revisit", 0), (0, "revisit", 2), (1, "revisit", 2), (2, "response", 0), (2, "revisit", 2), (3, "response", 0), (3, "response", 0)]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
