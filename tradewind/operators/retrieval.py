"""Retrieval: hashed embeddings, dense and lexical rankings, reciprocal rank fusion, answers."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.functions.scalars import estimated_tokens, number_text, relevant
from tradewind.functions.text import DIM, tokens
from tradewind.operators import lexical
from tradewind.operators.lexical import answered, asked_once, dealt, extent, jaccard_topk, lexical_topk, ranked, texts_of  # noqa: F401  one of the two rankers

CANDIDATES = 20
RRF_K = 60
BLOCK = 2048  # rows on each side of a matrix product
#: Rows of a block of sparse vectors: queries, items at most and at least; rows whose columns are held; queries with so few entries on average add up columns instead.
ASKING, SPARSE, LEAST, HELD, FEW = 65_536, 65_536, 4096, 4096, 24


def _buckets_of(dim: int):
    """Token to bucket, a bounded number of tokens: the first eight bytes of the MD5, modulo dim."""

    class Buckets(dict):
        def __missing__(self, token: str) -> int:
            if len(self) >= 500_000:
                self.clear()
            found = self[token] = int.from_bytes(hashlib.md5(token.encode()).digest()[:8], "big") % dim
            return found

    return Buckets()


def _bags(batch: pa.RecordBatch, known, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of word lists (second column): row, bucket, weight. A token is hashed once."""
    lists = batch.column(1)
    words = lists.flatten().dictionary_encode()
    bucket_of = np.array([known[w] for w in words.dictionary.to_pylist()], dtype=np.int64)
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    place, n = np.unique(row * dim + (bucket_of[words.indices.to_numpy()] if len(words) else 0), return_counts=True)
    row, where = place // dim, place % dim
    norm = np.sqrt(np.bincount(row, weights=(n * n).astype(np.float64), minlength=len(lists)))
    return row, where, n / norm[row]


def _worded(items: DataFrame, id_col: str, text_col: str, kind: str = "long") -> DataFrame:
    return items.select(F.col(id_col).cast(kind).alias("id"), tokens(F.col(text_col)).alias("words"))


def hash_embedding(items: DataFrame, id_col: str = "id", text_col: str = "text", dim: int = DIM) -> DataFrame:
    """Sparse form of the bag-of-words embedding: id, bucket, weight, each row's weights of length one.

    Rows are embedded where they are read: nothing is shuffled, and of each batch a token is hashed once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _buckets_of(dim)
        for batch in batches:
            row, where, weight = _bags(batch, known, dim)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(where.astype(np.int32)), pa.array(weight)], names=["id", "bucket", "weight"])

    return _worded(items, id_col, text_col).mapInArrow(run, "id long, bucket int, weight double")


def hash_vectors(items: DataFrame, id_col: str = "id", text_col: str = "text", dim: int = DIM, kind: str = "long", blank: bool = False) -> DataFrame:
    """Dense form of the same, made where rows are read: id (of this kind) and embedding. Texts without tokens have
    none; they are left out, or have a null with blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _buckets_of(dim)
        for batch in batches:
            row, where, weight = _bags(batch, known, dim)
            there = np.arange(batch.num_rows) if blank else np.unique(row)
            dense = np.zeros((len(there), dim))
            dense[np.searchsorted(there, row), where] = weight
            offsets = pa.array(np.arange(len(there) + 1, dtype=np.int32) * dim)
            none = pa.array(~np.isin(there, row))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(there)), pa.ListArray.from_arrays(offsets, pa.array(dense.ravel()), mask=none)], names=["id", "embedding"])

    return _worded(items, id_col, text_col, kind).mapInArrow(run, f"id {kind}, embedding array<double>")


def dense_topk(queries: DataFrame, items: DataFrame, k: int = CANDIDATES, block: int = BLOCK, digits: int | None = None) -> DataFrame:
    """query, id, score, rank: the k nearest items by cosine for a stated set of queries (both: id, embedding).

    Both sides are dealt to blocks of about `block` rows, every two blocks meet in one group, which is one matrix
    product, and of each group's scores only the k best of a query go on (ties: the least ids). So no task and no
    driver holds more than two blocks. Rows without an embedding are invisible; digits rounds the scores first.
    """
    there = "embedding IS NOT NULL"
    n_q, n_x = (max(1, -(-df.where(there).count() // block)) for df in (queries, items))

    def unit(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        pdf = pdf.sort_values("id", kind="stable")
        x = np.stack(pdf["embedding"].to_numpy())
        return pdf["id"].to_numpy(), x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def best(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query": [], "id": [], "score": []})
        (names, a), (ids, b) = unit(q), unit(x)
        s = a @ b.T if digits is None else np.round(a @ b.T, digits)
        at = np.argsort(-s, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({"query": np.repeat(names, at.shape[1]), "id": ids[at].ravel(), "score": np.take_along_axis(s, at, axis=1).ravel()})

    sides = [df.where(there).select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")) for df in (queries, items)]
    q, x = dealt(*sides, n_q, n_x)
    found = q.cogroup(x).applyInPandas(best, "query long, id long, score double")
    return ranked(found, k)


def hashed_topk(queries: DataFrame, items: DataFrame, k: int = CANDIDATES, digits: int = 9, dim: int = DIM, query_block: int = ASKING, item_block: int | None = None) -> DataFrame:
    """query, id, score, rank by the cosine of the hashed embeddings, rounded to so many digits and over 0 (both: id, text).

    The same as dense_topk over hash_vectors, but what is dealt to blocks is each row's few entries, each text is
    asked once, and of a block's scores only those that reach the k-th so far are rounded and sorted. A few queries
    are sent to all items.
    """
    once, stands = asked_once(queries)

    def entries(df: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _buckets_of(dim)
            for batch in batches:
                row, where, weight = _bags(batch, known, dim)
                there, many = np.unique(row, return_counts=True)
                offsets = pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (where.astype(np.int16), weight)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(there)), *lists], names=["id", "buckets", "weights"])

        return _worded(texts_of(df), "id", "text").mapInArrow(run, "id long, buckets array<short>, weights array<double>")

    def spread(pdf: pd.DataFrame) -> np.ndarray:
        """A column a row, all its dim entries."""
        many = pdf["buckets"].map(len).to_numpy()
        x = np.zeros((dim, len(pdf)))
        x[np.concatenate(pdf["buckets"].to_numpy()).astype(np.int64), np.repeat(np.arange(len(pdf)), many)] = np.concatenate(pdf["weights"].to_numpy())
        return x

    near = 2 * 10.0**-digits  # scores so near may be equal once they are rounded

    def merged(top: tuple[np.ndarray, np.ndarray], ids: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best k (ids, rounded scores) of those before and of these."""
        least = top[1][-1] if len(top[1]) == k else np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else 0.0
        at = np.flatnonzero(s >= least - near)
        if not len(at):
            return top
        ids, score = np.concatenate([top[0], ids[at]]), np.concatenate([top[1], np.round(s[at], digits)])
        order = np.lexsort((ids, -score))[:k]
        order = order[score[order] > 0]
        return ids[order], score[order]

    def best(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query": [], "id": [], "score": []})
        few = q["buckets"].map(len).mean() <= FEW
        tops = [(np.zeros(0, np.int64), np.zeros(0))] * len(q)
        entries = [*zip(q["buckets"], q["weights"], strict=True)]
        for b in range(0, len(x), HELD):
            ids, columns = x["id"].to_numpy()[b : b + HELD], spread(x.iloc[b : b + HELD])
            s, one = np.empty(len(ids)), np.empty(len(ids))
            for a in range(0, len(q), 256):
                made = None if few else spread(q.iloc[a : a + 256]).T @ columns
                for j in range(a, min(a + 256, len(q))):
                    if few:
                        s[:] = 0.0
                        for place, weight in zip(*entries[j], strict=True):
                            s += np.multiply(columns[place], weight, out=one)
                    tops[j] = merged(tops[j], ids, s if few else made[j - a])
        names = np.repeat(q["id"].to_numpy(), [len(ids) for ids, _ in tops])
        return pd.DataFrame({"query": names, "id": np.concatenate([ids for ids, _ in tops]), "score": np.concatenate([score for _, score in tops])})

    def scan(asked: list) -> Callable:
        weights = np.zeros((len(asked), dim))
        for own, r in zip(weights, asked, strict=True):
            own[r.buckets] = r.weights

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _buckets_of(dim)
            tops = [(np.zeros(0, np.int64), np.zeros(0))] * len(asked)
            for batch in batches:
                row, where, weight = _bags(batch, known, dim)
                there = np.unique(row)
                ids = batch.column(0).to_numpy()[there]
                for j, own in enumerate(weights):
                    tops[j] = merged(tops[j], ids, np.bincount(row, weights=weight * own[where], minlength=batch.num_rows)[there])
            names = np.repeat(np.array([r.id for r in asked], np.int64), [len(ids) for ids, _ in tops])
            ids, scores = (np.concatenate([np.zeros(0, t), *(top[c] for top in tops)]) for c, t in enumerate((np.int64, np.float64)))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(ids), pa.array(scores)], names=["query", "id", "score"])

        return run

    asking, chars = extent(once)
    if asking <= lexical.FEW and chars <= lexical.BRIEF:
        found = _worded(lexical.spread(texts_of(items)), "id", "text").mapInArrow(scan(entries(once).collect()), "query long, id long, score double")  # a bounded number of queries
        return answered(ranked(found, k), stands)
    n_q, rows = max(1, -(-asking // query_block)), items.count()
    wanted = -(-8 * items.sparkSession.sparkContext.defaultParallelism // n_q)
    n_x = max(1, -(-rows // (item_block or SPARSE)), 0 if item_block else min(-(-rows // LEAST), wanted))
    q, x = dealt(entries(once), entries(items), n_q, n_x)
    return answered(ranked(q.cogroup(x).applyInPandas(best, "query long, id long, score double"), k), stands)


def fused(dense: DataFrame, lexical: DataFrame, k: int = 4) -> DataFrame:
    """Reciprocal rank fusion of two rankings (query, id, score, rank): the best k of each query, with both raw scores.

    Ties keep the dense order, then the lexical one.
    """
    d = dense.select("query", "id", F.col("score").alias("v"), F.col("rank").alias("vrank"))
    x = lexical.select("query", "id", F.col("score").alias("w"), F.col("rank").alias("krank"))
    one = lambda r: F.coalesce(1 / (RRF_K + F.col(r) + 1), F.lit(0.0))
    rows = d.join(x, ["query", "id"], "full_outer").withColumn("score", one("vrank") + one("krank"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vrank"), F.asc_nulls_last("krank"))
    top = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return top.select("query", "id", "place", "score", F.coalesce("v", F.lit(0.0)).alias("vscore"), F.coalesce("w", F.lit(0.0)).alias("kwscore"), F.col("w").isNotNull().alias("kw"))


def gated(hits: DataFrame) -> DataFrame:
    """What is relevant of the top k, so fewer may be left."""
    return hits.where(relevant(F.col("vscore"), F.col("kw"), F.col("kwscore")))


def in_scope(items: DataFrame, shop_id: int, bot_id: int | None = None) -> DataFrame:
    """Active items of a shop with an embedding; with a bot, its own and those of no bot, without one, all."""
    rows = items.where((F.col("shop_id") == shop_id) & F.col("active") & F.col("embedding").isNotNull())
    return rows if bot_id is None else rows.where(F.col("bot_id").isNull() | (F.col("bot_id") == bot_id))


def price_text(price: Column, currency: str = "") -> Column:
    text = number_text(price)
    return F.coalesce(F.concat(text, F.lit(f" {currency}")) if currency else text, F.lit(""))


def product_context(products: DataFrame, variants: DataFrame, ask: str = "ask us") -> DataFrame:
    """source, title and body of a product's context block."""
    one = F.concat(F.col("name"), F.lit(" (in stock "), F.col("stock").cast("string"), F.lit(", "), price_text(F.col("price")), F.lit(")"))
    listed = variants.withColumn("text", one).groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("name", "text"))).alias("v"))
    rows = products.join(listed.withColumnRenamed("product_id", "id"), "id", "left")
    names = F.array_join(F.transform("v", lambda x: x["text"]), ", ")
    price = F.coalesce(F.nullif(price_text(F.col("price")), F.lit("")), F.lit(ask))
    body = F.concat(F.lit("Price "), price, F.lit(". "), F.coalesce("description", F.lit("")), F.coalesce(F.concat(F.lit(" Variants: "), names, F.lit(".")), F.lit("")))
    return rows.select("id", F.lit("product").alias("source"), F.col("name").alias("title"), F.trim(body).alias("body"))


def rendered(blocks: DataFrame, key: str = "query") -> DataFrame:
    """Each query's blocks (place, source, title, body) as lines, in order."""
    line = F.concat(F.lit("- ["), F.col("source"), F.lit("] "), F.col("title"), F.lit(": "), F.col("body"))
    listed = blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("l"))
    return listed.select(key, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("context"))


def stub_answer(questions: DataFrame, blocks: DataFrame) -> DataFrame:
    """An extractive answer: the first block and the titles of two more; without blocks, a hand-over."""
    listed = blocks.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "title", "body"))).alias("b"))
    rows = questions.withColumnRenamed("id", "query").join(listed, "query", "left")
    first = F.get("b", F.lit(0))
    more = F.array_join(F.transform(F.slice(F.col("b"), 2, 2), lambda x: x["title"]), "; ")
    found = F.concat(first["title"], F.lit(" - "), first["body"], F.lit("."), F.when(F.size("b") > 1, F.concat(F.lit(" See also: "), more, F.lit("."))).otherwise(""))
    text = F.when(F.col("b").isNull(), F.lit("A colleague will get back to you.")).otherwise(found)
    return rows.select("query", text.alias("answer"), estimated_tokens(text).alias("output_tokens"))
