"""The corpus pipeline: quality rules, language id, exact dedup, near dedup, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the
columns of documents, whatever other columns those have and whatever their names. Null and empty texts fail the
quality rules, so later stages see none, but would handle them; very long texts are taken whole. Of repeated rows and
rows without an id one stays where their texts are equal. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm import dedup, jaccard, langid, packing, quality
from tradewind.llm.common import kept_rows, staged, table
from tradewind.llm.registry import vocabulary

#: The least calibrated probability at which a predicted language is accepted.
LEAST_SCORE = 0.5


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id and text beside the whole row, so that no column of docs can clash with what a stage adds."""
    return docs.select("doc_id", "text", "lang", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the strict policy. Null and empty texts go."""
    return quality.judged(_carried(docs), quality.STRICT, keep=("document",)).where("kept").select("document.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told.

    Without a kept row outside the held-out fold that has text and a lang (an unlabelled corpus, a tiny table) there
    is no model; then every document with a letter stays, and only texts that are undetermined by content go.
    """
    model = langid.train(docs)
    if model is None:
        return docs.where(langid.lettered(F.col("text")))
    found = langid.predict(_carried(docs), model)
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select("document.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return kept_rows(docs, staged(dedup.groups(docs), "pipeline-exact"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that near copies tie together."""
    return kept_rows(docs, staged(jaccard.similar(docs), "pipeline-near"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the token windows: every id of every row once. Null and empty texts are their end id alone, very
    long ones are cut, repeated rows have pieces of their own, an empty table has none. Workers that ran the other stages have less memory to spare for the memo."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), memo=150_000)


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("packing", pack)]

#: Token ids and packing have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs
