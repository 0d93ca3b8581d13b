"""Document ingestion: extraction, chunks, incremental and repeated indexing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tradewind.functions.scalars import blank_to_null, stripped

TARGET = 800
#: Characters of chunks that are held before they go on.
GIVEN = 1_000_000


def _packed(text: str | None, target: int, separator: str, lossless: bool) -> list[str]:
    """One pass over the paragraphs; the open chunk is held as a list, so the time follows the length of the text."""
    text = text or ""
    done: list[str] = []
    held: list[str] = []
    room = 0
    for paragraph in text.replace("\r", "").split(separator):
        paragraph = paragraph.strip()
        for at in range(0, len(paragraph) if lossless else min(1, len(paragraph)), target):
            part = paragraph[at : at + target]
            need = len(separator) + (len(part) if lossless else len(paragraph))
            if held and need <= room:
                room -= need
            else:
                if held:
                    done.append(separator.join(held))
                    held = []
                room = target - len(part)
            held.append(part)
    if held:
        done.append(separator.join(held))
    return done or [text[:target]]


def chunks_of(text: Column, target: int = TARGET, separator: str = "\n\n", lossless: bool = False) -> Column:
    """The chunks that chunk_rows makes, as an array for expressions; it holds a whole batch of them."""

    @F.pandas_udf("array<string>")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _packed(t, target, separator, lossless))

    return packed(F.coalesce(text.cast("string"), F.lit("")))


def chunk_rows(rows: DataFrame, keys: list[str], text: Column, target: int = TARGET, separator: str = "\n\n", lossless: bool = False) -> DataFrame:
    """keys, ordinal, content: paragraphs packed greedily into chunks of at most target characters.

    A paragraph over the target keeps only its first target characters, as the original does; lossless cuts it
    into several instead. Text of white space alone is one chunk. What fits depends on all paragraphs before, which
    no built-in function carries along in linear time, so this is one Arrow pass over the rows where they are read.
    Texts are taken out of a batch one by one, and chunks go on once there are GIVEN characters of them.
    """
    texts = rows.select(*keys, F.coalesce(text.cast("string"), F.lit("")).alias("content"))
    schema = StructType([*(f for f in texts.schema.fields if f.name in keys), StructField("ordinal", IntegerType()), StructField("content", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[int, list[str]]] = []
            size = 0
            for i, raw in enumerate(batch.column(len(keys))):
                held.append((i, _packed(raw.as_py(), target, separator, lossless)))
                size += sum(map(len, held[-1][1]))
                if size < GIVEN and i + 1 < batch.num_rows:
                    continue
                whose = pa.array([i for i, pieces in held for _ in pieces], pa.int32())
                ordinals = pa.array([n for _, pieces in held for n in range(len(pieces))], pa.int32())
                contents = pa.array([p for _, pieces in held for p in pieces], pa.string())
                held, size = [], 0
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(whose) for k in range(len(keys))), ordinals, contents], names=[*keys, "ordinal", "content"])

    return texts.mapInArrow(run, schema)


def chunked(documents: DataFrame, id_col: str = "id", text_col: str = "content", **how) -> DataFrame:
    """document_id, ordinal, content."""
    return chunk_rows(documents.withColumn("document_id", F.col(id_col)), ["document_id"], F.col(text_col), **how)


def document_text(chunks: DataFrame, most: int = 200_000) -> DataFrame:
    """A document's chunks put together again in order, a blank line between."""
    listed = chunks.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "content"))).alias("c"))
    return listed.select("document_id", F.left(F.array_join(F.transform("c", lambda x: x["content"]), "\n\n"), F.lit(most)).alias("text"))


def pending(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """Chunks that the index has no vector for yet."""
    have = index.where("embedding IS NOT NULL").select("document_id", "ordinal")
    return chunks.join(have, ["document_id", "ordinal"], "left_anti")


def reindexed(chunks: DataFrame, changed: DataFrame, **how) -> DataFrame:
    """The chunk table after the changed documents' chunks are replaced by new ones."""
    kept = chunks.join(changed.select(F.col("id").alias("document_id")), "document_id", "left_anti")
    return kept.select("document_id", "ordinal", "content").unionByName(chunked(changed, **how))


def with_status(documents: DataFrame) -> DataFrame:
    """ready, or error with a message (at most 500 characters), row by row."""
    empty = F.length(stripped(F.coalesce("content", F.lit("")))) == 0
    return documents.withColumns({"status": F.when(empty, "error").otherwise("ready"), "error": F.when(empty, F.left(F.lit("no text found in the file"), F.lit(500))), "char_count": F.length(F.coalesce("content", F.lit("")))})


def scoped_chunks(chunks: DataFrame, documents: DataFrame, bases: DataFrame, shop_id: int, bot_id: int | None = None) -> DataFrame:
    """Chunks of the active documents of a shop's knowledge bases: those of the bot and those of no bot (all, without one).

    bases (id, shop_id) and documents (id, base_id, bot_id, active) are narrowed before the chunks meet them.
    """
    rows = documents.where("active").join(bases.where(F.col("shop_id") == shop_id).select(F.col("id").alias("base_id")), "base_id", "left_semi")
    rows = rows if bot_id is None else rows.where(F.col("bot_id").isNull() | (F.col("bot_id") == bot_id))
    return chunks.join(rows.select(F.col("id").alias("document_id"), "base_id"), "document_id")


def blocked(documents: DataFrame, limits: DataFrame, hard_mb: int = 25) -> DataFrame:
    """Which documents (account_id, n-th of its account, bytes) a plan's limits block; a limit of 0 is none."""
    rows = documents.join(limits, "account_id")
    too_many = (F.col("knowledge_docs") > 0) & (F.col("nth") > F.col("knowledge_docs"))
    too_large = F.col("bytes") > F.least(F.lit(hard_mb), F.col("max_file_mb")) * 1_048_576
    return rows.withColumn("blocked", F.when(too_many, "count").when(too_large, "size"))


def product_text(products: DataFrame) -> Column:
    """What is embedded of a product: name, description, sku and attributes, blanks left out."""
    return F.concat_ws(" ", blank_to_null(F.col("name")), blank_to_null(F.col("description")), blank_to_null(F.col("sku")), F.concat(F.lit("size:"), F.col("size").cast("string")))
