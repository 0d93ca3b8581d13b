"""Stupid-backoff language-model scores as joins: hashed n-gram counts, joined to exploded n-grams, summed by document.

The model has orders 2 and 1, with counts of all documents. For each word w after v, S = c(v w) / c(v); a bigram that
never occurs would back off to backoff * c(w) / N, and so does a document's first word, which has no bigram.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import staged
from tradewind.llm.members import bitmap_of, bits_for, is_set
from tradewind.llm.memos import claim

#: Of each order, so many counts at most are broadcast: those of the commonest grams (16 bytes each).
COMMON = 200_000
#: Words and bigrams that are counted together in a task before they are shuffled.
STRETCH = 3_000_000


class _Words(dict):
    """Words to hashes, a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word) & ~1
        return found


_WORDS = _Words()


def words_of(text: str | None) -> np.ndarray:
    """The hashes (even numbers) of a text's words: A-Z lower-cased, parted by ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))


def bigrams_of(w: np.ndarray) -> np.ndarray:
    """The hashes (odd numbers) of the bigrams in a row of words."""
    with np.errstate(over="ignore"):
        g = w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:]
        g ^= g >> np.uint64(32)
        g *= np.uint64(0xD6E8FEB86659FD93)
        return g ^ (g >> np.uint64(32)) | np.uint64(1)


def is_bigram(gram: Column) -> Column:
    return gram.bitwiseAND(F.lit(1)) == 1


def count_table(texts: DataFrame) -> DataFrame:
    """gram, c: the counts of words and bigrams over all rows of a one-column table, partitioned by the gram's hash.

    A bigram that is not in the table occurred once: those rows would be most of it and their logarithm is 0.
    Copies are counted in the tasks that read them before anything is shuffled, so no gram is a hot key. Two grams
    of one 64-bit hash (a chance of 5e-20 for each pair) would be counted as one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(_WORDS, _WORDS.clear)
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            grams, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n)], names=["gram", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                w = words_of(text)
                held += [w, bigrams_of(w)]
                size += 2 * len(w)
                if size >= STRETCH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    counted = texts.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("c"))
    return counted.where(~is_bigram(F.col("gram")) | (F.col("c") > 1))


def commonest(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Grams, sorted, and their counts: of each order the commonest, at most COMMON.

    The least count that is common follows from a histogram of the counts' logarithms (some hundred rows).
    """
    level = F.floor(F.log2("c") * 8).alias("level")
    rows = counts.groupBy(is_bigram(F.col("gram")).alias("two"), level).agg(F.count("*").alias("n")).collect()
    wanted = F.lit(False)
    for two in (False, True):
        taken, least = 0, None
        for r in sorted((r for r in rows if r.two == two), key=lambda r: -r.level):
            taken += r.n
            if taken > COMMON:
                break
            least = r.level
        if least is not None:
            wanted |= (is_bigram(F.col("gram")) == two) & (F.floor(F.log2("c") * 8) >= least)
    found = counts.where(wanted).select("gram", "c").toArrow()  # 2 * COMMON rows at most
    gram, c = (found.column(i).to_numpy() for i in range(2))
    order = np.argsort(gram)
    return gram[order], c[order]


def _bit(gram: Column, bits: int) -> Column:
    return F.shiftrightunsigned(gram, 64 - bits)


ASKED = "row long, gram long, weight long, value double, doc_id long, n_words long"


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, backoff: float = 0.4) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_bigrams, log_score (the sum of log S) and mean_log_score.

    A text's score is a sum of weighted logarithms of counts: its bigrams', less those of their first words, plus its
    first word's. Each text is exploded into its distinct grams; the commonest are answered by a bounded broadcast, a
    bigram that a bounded bitmap says is not in the table has the logarithm 0, all others meet the count table in a
    join. So what is shuffled holds no very common gram. The bitmap never decides a score: what it lets through
    without need finds no count and adds 0 as well.

    Texts without words, null or empty, score 0 with a null mean. Repeated rows, repeated and null ids get rows of
    their own; very long texts are one row like all others; an empty table gives no rows. Other columns of docs,
    whatever their names, are not read.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    counts = staged(count_table(docs.select(text.alias("t"))), "lm-counts")
    total = counts.where(~is_bigram(F.col("gram"))).agg(F.sum("c")).first()[0] or 1  # one number
    repeated = counts.where(is_bigram(F.col("gram")))
    bits = bits_for(repeated.count())
    names, number = commonest(counts)
    broadcast = spark.sparkContext.broadcast((names, np.log(number.astype(np.float64)), bitmap_of(repeated.select(_bit(F.col("gram"), bits).alias("p")), bits)))
    log_back = math.log(backoff) - math.log(total)

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(_WORDS, _WORDS.clear)
        common, logs, bitmap = broadcast.value
        fields = [c.split()[0] for c in ASKED.split(", ")]
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            row, gram, weight, value, doc_id, n_words, own = (np.concatenate(x) for x in zip(*held, strict=True))
            columns = [pa.array(x) for x in (row, gram, weight, value)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(doc_id, pa.int64(), mask=~own), pa.array(n_words)], names=fields)

        for batch in batches:
            ids, null = batch.column(1).fill_null(0).to_numpy(), batch.column(1).is_null().to_numpy(zero_copy_only=False)
            for row, doc_id, no_id, t in zip(batch.column(0).to_pylist(), ids, null, batch.column(2).to_pylist(), strict=True):
                w = words_of(t)
                g, n = np.unique(bigrams_of(w), return_counts=True)
                first, m = np.unique(w[:-1], return_counts=True)
                gram = np.concatenate((g, first, w[:1])).view(np.int64)
                weight = np.concatenate((n, -m, np.ones(min(1, len(w)), dtype=np.int64)))
                at = np.minimum(np.searchsorted(common, gram), max(0, len(common) - 1))
                known = common[at] == gram if len(common) else np.zeros(len(gram), dtype=bool)
                value = float(weight[known] @ logs[at[known]]) + (log_back if len(w) else 0.0)
                asks = ~known
                asks[: len(g)] &= is_set(bitmap, (g >> np.uint64(64 - bits)).view(np.int64))
                k = int(asks.sum()) + 1  # and the text's own entry, spread by its number, which weighs nothing
                zeros = np.zeros(k, dtype=np.int64)
                own = zeros.astype(bool)
                own[-1] = True
                held.append((
                    np.full(k, row), np.append(gram[asks], hash((row, 1)) & ~1), np.append(weight[asks], 0), np.where(own, value, 0.0),
                    np.where(own, doc_id, 0), np.where(own, len(w), zeros), own & (not no_id),
                ))
                size += k
                if size >= 200_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), text.alias("t"))
    answered = own.mapInArrow(exploded, ASKED).join(counts, "gram", "left")
    value = F.col("value") + F.col("weight") * F.coalesce(F.log("c"), F.lit(0.0))
    by_row = answered.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum(value).alias("log_score"))
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return by_row.select("doc_id", "n_words", F.greatest(F.col("n_words") - 1, F.lit(0)).alias("n_bigrams"), "log_score", mean.alias("mean_log_score"))
