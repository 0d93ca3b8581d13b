"""Quality rules as a ledger: each rule is judged once per document and kept as one bit beside its measurements.

Policies are named, versioned bit masks over the ledger; what they keep and what each of their rules costs are
bitwise questions to the ledger, without another look at the texts.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.llm.memos import claim

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
WINDOW = 8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _repeated(words: list[str]) -> int:
    """Words that lie in a WINDOW-word window found twice or more, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    with np.errstate(over="ignore"):
        key = np.zeros(n, dtype=np.uint64)
        for j in range(WINDOW):
            key = key * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
            key ^= key >> np.uint64(29)
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(key, twice)).tolist()
    windows = [tuple(words[i : i + WINDOW]) for i in at]  # equal keys are no proof
    counts = Counter(windows)
    inside = np.zeros(len(words) + 1, dtype=np.int64)
    for i, w in zip(at, windows, strict=True):
        if counts[w] > 1:
            inside[i] += 1
            inside[i + WINDOW] -= 1
    return int(np.count_nonzero(np.cumsum(inside[:-1])))


def measure(text: str | None) -> tuple[int, ...]:
    """The MEASURES of one text; a null or empty text has none of anything."""
    if not text:
        return (0,) * len(MEASURES)
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), _repeated(words), len(lines)


@dataclass(frozen=True)
class Rule:
    """A document fails when `fails`, SQL over the measurements, is true."""

    bit: int
    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    """A document is kept when it fails none of the rules."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES[r].bit for r in self.rules)


RULES = {
    r.name: r
    for r in (
        Rule(0, "few_words", "n_words < 20"),
        Rule(1, "repeated_words", "100 * n_repeat_words > 30 * n_words"),
        Rule(2, "word_length", "word_chars < 2 * n_words OR word_chars > 16 * n_words"),
        Rule(3, "symbols", "n_symbols > n_words"),
        Rule(4, "repeated_lines", "n_lines >= 5 AND 10 * n_dup_lines > 4 * n_lines"),
    )
}
BASE = Policy("base", 1, ("few_words", "repeated_words"))
STRICT = Policy("strict", 1, tuple(RULES))
LENIENT = Policy("lenient", 1, ("few_words", "repeated_words", "word_length"))


def _measured(text: Column) -> Column:
    @F.pandas_udf(", ".join(f"{m} long" for m in MEASURES))
    def run(texts: pd.Series) -> pd.DataFrame:
        claim("quality")
        return pd.DataFrame([measure(t) for t in texts], columns=list(MEASURES))

    return run(text)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: id, measurements and fail_bits; the columns in keep are carried along.

    The words are counted in the tasks that read the texts and nothing is shuffled. Null and empty texts have
    zero measurements (and so fail few_words); repeated rows and null ids get rows of their own; very long texts are
    measured whole; an empty table gives no rows. Columns of docs that are not in keep are not read; one in keep must
    not have the name of a column of the ledger (put it into a struct).
    """
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in RULES.values()]
    measured = docs.select(F.col(id_col).alias("_id"), _measured(F.col(text_col).cast("string")).alias("_m"), *(F.col(c).alias(f"_keep_{c}") for c in keep))
    measured = measured.select("_id", *(F.col(f"_m.{m}") for m in MEASURES), *(f"_keep_{c}" for c in keep))
    return measured.select(F.col("_id").alias(id_col), *MEASURES, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fail_bits"), *(F.col(f"_keep_{c}").alias(c) for c in keep))


def passes(policy: Policy) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0


def ablation(entries: DataFrame, policies: tuple[Policy, ...]) -> DataFrame:
    """For each policy and each of its rules: documents, kept, failing the rule, and kept only if it were dropped.

    The ledger is first folded into one row for each bit pattern (at most 2 to the number of rules), so the
    answers come from that small table however large the corpus is.
    """
    patterns = entries.groupBy("fail_bits").agg(F.count("*").alias("n"))
    asked = entries.sparkSession.createDataFrame([(p.name, p.version, r, p.mask, 1 << RULES[r].bit) for p in policies for r in p.rules], "policy string, version int, rule string, mask long, bit long")
    held = F.col("fail_bits").bitwiseAND(F.col("mask"))
    return (
        patterns.crossJoin(F.broadcast(asked))  # both sides are bounded by the number of rules
        .groupBy("policy", "version", "rule")
        .agg(
            F.sum("n").alias("n_docs"),
            F.sum(F.when(held == 0, F.col("n")).otherwise(0)).alias("n_kept"),
            F.sum(F.when(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failing"),
            F.sum(F.when(held == F.col("bit"), F.col("n")).otherwise(0)).alias("n_failing_only_this"),
            F.bit_or(held).alias("bits_seen"),
        )
    )


def judged(docs: DataFrame, policy: Policy = STRICT, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The ledger with base_failed, kept under the policy, and the policy's name and version."""
    entries = ledger(docs, id_col, text_col, keep)
    return entries.withColumns({"base_failed": ~passes(BASE), "kept": passes(BASE) & passes(policy), "policy": F.lit(f"{policy.name}-{policy.version}")})
