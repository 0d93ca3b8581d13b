"""Language id: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained by follow-the-regularised-leader with elastic-net penalties; scores are calibrated by one temperature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import unused
from tradewind.llm.memos import claim

#: n-grams of one to three characters, hashed to this many features.
BITS = 15
DIM = 1 << BITS
MULTIPLIERS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))
UNDETERMINED = "und"
FOLDS = 5


@dataclass(frozen=True)
class Training:
    """sample: the most labelled documents (whole texts) the weights are fitted on; all labelled ones count for IDF."""

    sample: int = 3000
    epochs: int = 3
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1


@dataclass(frozen=True)
class Model:
    """weights: features x classes, for values that idf has multiplied and the norm has divided."""

    classes: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float


def ngram_counts(text: str) -> np.ndarray:
    """How often each feature occurs in the whole text, lower-cased."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    counts = np.zeros(DIM, dtype=np.float32)
    shift = np.uint32(32 - BITS)
    for begin in range(0, max(1, len(c)), 1 << 20):  # a bounded stretch at a time
        part = c[max(0, begin - 2) : begin + (1 << 20)]
        skip = begin - max(0, begin - 2)
        key = np.zeros(len(part), dtype=np.uint32)
        for n, m in enumerate(MULTIPLIERS):
            if len(part) <= n:
                break
            key = (key[1:] if n else key) + part[: len(part) - n] * m if n else part * m
            ends_in_part = key[max(0, skip - n) :]  # an n-gram counts where it ends
            counts += np.bincount((ends_in_part ^ (ends_in_part >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift, minlength=DIM)
    return counts


def has_letter(text: str | None) -> bool:
    return bool(text) and (any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text)))


def lettered(text: Column) -> Column:
    """has_letter as a column; false for null."""

    @F.pandas_udf("boolean")
    def test(texts: pd.Series) -> pd.Series:
        return pd.Series([has_letter(t) for t in texts], dtype=bool)

    return test(text.cast("string"))


def held_out(id_col: Column) -> Column:
    """Whether a document stays out of training: crc32 of its id as text, modulo FOLDS, is 0 (a null id: empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts and in how many of them each feature occurs, over every row of a one-column table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("langid")
        df, n = np.zeros(DIM, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                df += ngram_counts(text) > 0
                n += 1
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(df[found], n))], names=["feature", "n"])

    rows = texts.mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()  # DIM rows at most
    out = np.zeros(DIM + 1, dtype=np.int64)
    for r in rows:
        out[r.feature] = r.n
    return int(out[-1]), out[:-1]


def fit_ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, how: Training) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias. examples: feature indices, values, class. Per-coordinate FTRL-proximal on the softmax loss."""
    z = np.zeros((DIM + 1, n_classes))
    n = np.zeros((DIM + 1, n_classes))

    def weights(rows) -> np.ndarray:
        zr = z[rows]
        w = -(zr - np.sign(zr) * how.l1) / ((how.beta + np.sqrt(n[rows])) / how.alpha + how.l2)
        return np.where(np.abs(zr) <= how.l1, 0.0, w)

    rng = np.random.default_rng(7)
    for _ in range(how.epochs):
        for i in rng.permutation(len(examples)):
            at, x, y = examples[i]
            at, x = np.append(at, DIM), np.append(x, 1.0)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1.0
            g = x[:, None] * p
            before = n[at]
            n[at] = before + g * g
            z[at] += g - (np.sqrt(n[at]) - np.sqrt(before)) / how.alpha * w
    w = weights(np.arange(DIM + 1))
    return w[:-1].astype(np.float32), w[-1]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section on its logarithm."""
    if not len(y):
        return 1.0

    def loss(log_t: float) -> float:
        s = logits / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))

    lo, hi, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(50):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", how: Training | None = None) -> Model | None:
    """A model from the labelled rows of docs outside the held-out fold; None without any.

    IDF counts all of those rows. The weights are fitted, in one task, on an evenly stratified sample of at most
    how.sample whole texts, chosen by a hash of the id; a fifth of the sample only sets the temperature. Rows without
    text or label are not counted; repeated rows count each time; texts of equal hash are ordered by label and
    content; very long texts count whole; other columns of docs, whatever their names, are not read.
    """
    how = how or Training()
    text, label = F.col(text_col).cast("string"), F.col(label_col).cast("string")
    rows = docs.where(~held_out(F.col(id_col)) & text.isNotNull() & label.isNotNull()).select(text.alias("text"), label.alias("label"), F.pmod(F.xxhash64(F.lit("langid"), F.col(id_col).cast("string"), F.length(text)), F.lit(1 << 30)).alias("h"))
    n_docs, df = document_frequencies(rows.select("text"))
    if not n_docs:
        return None
    idf = (np.log((1 + n_docs) / (1 + df)) + 1).astype(np.float32)
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # one row a language
    classes = tuple(sorted(sizes))
    each = how.sample / len(classes)
    bound = F.lit(0)
    for c in classes:
        bound = F.when(F.col("label") == c, F.lit(int(min(1.0, each / sizes[c]) * (1 << 30)))).otherwise(bound)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values = [], []
            for t in batch.column(0).to_pylist():
                counts = ngram_counts(t)
                found = np.flatnonzero(counts)
                at.append(found.astype(np.int32).tobytes())
                values.append(counts[found].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.binary()), pa.array(values, pa.binary()), batch.column(1), batch.column(2)], names=["at", "counts", "label", "h"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "label", "at"]).head(how.sample)
        examples = []
        for r in pdf.itertuples():
            at = np.frombuffer(r.at, dtype=np.int32)
            x = np.frombuffer(r.counts, dtype=np.float32) * idf[at]
            examples.append((at, x / max(float(np.sqrt(x @ x)), 1e-9), classes.index(r.label)))
        tuning = examples[::5] if len(examples) >= 50 else []
        w, b = fit_ftrl([e for i, e in enumerate(examples) if not tuning or i % 5], len(classes), how)
        logits = np.array([x @ w[at] + b for at, x, _ in tuning]).reshape(-1, len(classes))
        t = fit_temperature(logits, np.array([y for *_, y in tuning], dtype=int))
        return pd.DataFrame({"w": [w.tobytes()], "b": [b.astype(np.float64).tobytes()], "t": [t]})

    sample = rows.where(F.col("h") <= bound).select("text", "label", "h")
    fitted = sample.mapInArrow(features, "at binary, counts binary, label string, h long").withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(fit, "w binary, b binary, t double").collect()[0]  # one model
    return Model(classes, np.frombuffer(fitted.w, dtype=np.float32).reshape(DIM, len(classes)), np.frombuffer(fitted.b), idf, fitted.t)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (the calibrated probability, 0 to 1), from each whole text alone.

    A text that is null, empty or has no letter is `und` with score 0, as is every text without a model. A very long
    text is taken a stretch at a time; of languages with equal scores the first by name is predicted; repeated rows
    each get their own; an empty table gives none. Other columns of docs, whatever their names, are carried along,
    but columns named lang_pred or score are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM x languages floats

    @F.pandas_udf("lang_pred string, score double")
    def score(texts: pd.Series) -> pd.DataFrame:
        claim("langid")
        m = shared.value
        out = []
        for text in texts:
            if m is None or not has_letter(text):
                out.append((UNDETERMINED, 0.0))
                continue
            x = ngram_counts(text) * m.idf
            s = ((x @ m.weights) / max(float(np.sqrt(x @ x)), 1e-9) + m.bias) / m.temperature
            p = np.exp(s - s.max())
            p /= p.sum()
            best = int(p.argmax())
            out.append((m.classes[best], float(p[best])))
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    made = unused(docs)
    found = docs.withColumn(made, score(F.col(text_col).cast("string")))
    return found.select(*(F.col(f"`{c}`") for c in docs.columns), f"{made}.lang_pred", f"{made}.score")
