"""Spelling variants by full neighbourhood generation: every string one edit away from a word is looked up as it is.

All distinct deletions, replacements and insertions over the observed alphabet are generated for each word of the
vocabulary. A generated string that is a word is a near word by construction, so no distance is ever computed.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import drop_staged, staged
from tradewind.llm.members import bitmap_of, bits_for, is_set

#: One document's run in so many loses a code point.
DAMAGED = 97
LEAST_LENGTH, LEAST_N = 5, 3
#: A word's form is at least so many times as frequent.
FACTOR = 2
#: Words that a task counts together before they are shuffled.
HELD = 400_000
#: Generated strings that a task holds at a time.
AT_ONCE = 2_000_000
#: Bits of the bitmap for each word of the vocabulary; each sets two.
BITS_A_WORD = 64

#: Latin-1 bytes: runs keep their letters, A-Z in lower case; all else parts them.
_RUNS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs_of(text: str | None) -> list[bytes]:
    """The maximal runs of A-Z, a-z and U+00C0 to U+00FF in Latin-1, A-Z lower-cased."""
    return (text or "").encode("latin-1", "replace").translate(_RUNS).split()


def damaged(run: bytes, crc: int) -> bytes:
    """The run without its code point at crc modulo its length."""
    at = crc % len(run)
    return run[:at] + run[at + 1 :]


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n over all rows of docs, counted in the tasks that read them before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in total], pa.string())
            out = pa.RecordBatch.from_arrays([words, pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                named = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(runs_of(text.as_py())).items():
                    crc = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), named)
                    total[word if crc % DAMAGED else damaged(word, crc)] += n
                if len(total) >= HELD:
                    yield flush()
        if total:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Hashes:
    """Polynomial hashes of words and of all that is one edit away, many at a time. Words are rows of Latin-1 bytes.

    They only choose which generated strings are spelled out, so equal hashes of different strings do no harm.
    """

    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self, alphabet: str, bits: int):
        self.letters = np.frombuffer(alphabet.encode("latin-1"), dtype=np.uint8)
        self.bits = bits
        self.value = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

    def _powers(self, n: int) -> np.ndarray:
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, self.BASE, dtype=np.uint64)]), dtype=np.uint64)

    def _places(self, h: np.ndarray, which: int) -> np.ndarray:
        h = (h ^ (h >> np.uint64(29))) * np.uint64((0xD6E8FEB86659FD93, 0xA0761D6478BD642F)[which])
        return ((h ^ (h >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(64 - self.bits)

    def places(self, words: np.ndarray) -> np.ndarray:
        """The two places of each word in the bitmap."""
        h = (self.value[words] * self._powers(words.shape[1])[:-1]).sum(axis=1, dtype=np.uint64)
        return np.concatenate([self._places(h, 0), self._places(h, 1)])

    def maybe(self, bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Where the hashes' places are both set; the second is looked up only where the first one is."""
        at = np.flatnonzero(is_set(bitmap, self._places(h, 0)))
        return at[is_set(bitmap, self._places(h[at], 1))]

    def neighbours(self, words: np.ndarray, bitmap: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, strings): the distinct strings one edit away from the words at these rows that the bitmap lets through.

        Distinct: of equal letters in a row only the first is deleted, no letter is replaced by itself, and none is
        inserted right behind its like.
        """
        n, length = words.shape
        power = self._powers(length + 1)
        value = self.value[words]
        terms = value * power[:length]
        before = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)
        whole = before[:, -1:]

        new = np.ones((n, length), bool)
        new[:, 1:] = words[:, 1:] != words[:, :-1]
        row, at = np.nonzero(new)
        h = before[row, at] + (whole[row, 0] - before[row, at + 1]) * np.uint64(self.INVERSE)
        hit = self.maybe(bitmap, h)
        row, at = row[hit], at[hit]
        keep = np.arange(length) != at[:, None]
        yield row, words[row][keep].reshape(len(row), length - 1)

        letter = self.value[self.letters]
        h = (whole - terms)[:, :, None] + letter * power[:length][None, :, None]
        hit = self.maybe(bitmap, h.ravel())
        row, at, c = np.unravel_index(hit, h.shape)
        other = words[row, at] != self.letters[c]
        row, at, c = row[other], at[other], c[other]
        made = words[row]
        made[np.arange(len(row)), at] = self.letters[c]
        yield row, made

        h = (before + (whole - before) * np.uint64(self.BASE))[:, :, None] + letter * power[: length + 1][None, :, None]
        hit = self.maybe(bitmap, h.ravel())
        row, at, c = np.unravel_index(hit, h.shape)
        first = (at == 0) | (words[row, at - 1] != self.letters[c])
        row, at, c = row[first], at[first], c[first]
        made = np.empty((len(row), length + 1), np.uint8)
        place = np.arange(length + 1)
        source = np.clip(place - (place > at[:, None]), 0, length - 1)
        made[:] = words[row[:, None], source]
        made[np.arange(len(row)), at] = self.letters[c]
        yield row, made


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which, rows of Latin-1 bytes): the words of each length together."""
    for length, group in itertools.groupby(sorted(range(len(words)), key=lambda i: len(words[i])), key=lambda i: len(words[i])):
        which = np.fromiter(group, np.int64)
        joined = "".join(words[i] for i in which).encode("latin-1")
        yield which, np.frombuffer(joined, np.uint8).reshape(len(which), length)


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, n_near, best (n and near word: the most frequent near word, ties by code points), where there is any.

    Being near is mutual, so what a generated string collects from the words that generated it are its own near
    words. They are reduced in each task before the shuffle, then joined to the vocabulary by equality.

    Broadcast: the observed letters (at most 90) and a bitmap of the vocabulary of at most 32 MB that keeps nearly
    all strings that are no words from being spelled out; those it lets through find no partner in the join.
    """
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct()
    hashes = Hashes("".join(sorted(r.c for r in letters.collect())), bits_for(vocabulary.count(), BITS_A_WORD))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words in _by_length(batch.column(0).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(hashes.places(words).astype(np.int64))], names=["p"])

    bitmap = vocabulary.sparkSession.sparkContext.broadcast(bitmap_of(vocabulary.select("word").mapInArrow(placed, "p long"), hashes.bits))

    def generated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_words = batch.column(0).to_pylist()
            for which, words in _by_length(all_words):
                step = max(1, AT_ONCE // ((words.shape[1] + 1) * max(1, len(hashes.letters))))
                for at in range(0, len(which), step):
                    for rows, made in hashes.neighbours(words[at : at + step], bitmap.value):
                        source, length, text = pa.array(which[at + rows]), made.shape[1], made.tobytes().decode("latin-1")
                        strings = pa.array([text[i * length : (i + 1) * length] for i in range(len(rows))], pa.string())
                        yield pa.RecordBatch.from_arrays([strings, batch.column(0).take(source), batch.column(1).take(source)], names=["word", "near", "n"])

    found = vocabulary.select("word", "n").mapInArrow(generated, "word string, near string, n long")
    return found.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), F.col("near").alias("near"))).alias("best"))


def rooted(forms: DataFrame) -> DataFrame:
    """word, root for rows with a form (word, form): forms followed to the last, every round twice as far.

    A form is more frequent than its word, so there are no cycles, and their number grows with the logarithm of the
    counts; the number of rounds grows with the logarithm of that.
    """
    now = staged(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        following = staged(now.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        done = following.where("moved").isEmpty()
        drop_staged(now)
        now = following.select("word", "root")
        if done:
            return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_n: int = LEAST_N) -> DataFrame:
    """word, form, root, n, n_near, form_n: every word of the whole texts with its commoner spelling, if there is one.

    Words are the maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased, of at least five code points
    and least_n occurrences over all rows; in one of 97 documents (by a checksum of the id and the run) a run has
    lost a code point first. Near words differ by exactly one inserted, deleted or replaced code point. A word's form
    is its most frequent near word (ties: the least by code points), if that is at least twice as frequent; root is
    the last form that following forms leads to, the word itself without one.

    Null texts and empty ones have no words; null ids are written as nothing before the colon of the checksum.
    Repeated rows count each time. Very long texts are read whole. An empty table, or one without frequent words,
    gives no rows. Other columns of docs, whatever their names, are not read. A word that very many rows hold is
    one row of each task before the shuffle.
    """
    words = counted(docs, id_col, text_col).where((F.length("word") >= LEAST_LENGTH) & (F.col("n") >= least_n))
    vocabulary = staged(words, "spelling-words")
    found = vocabulary.join(near_words(vocabulary), "word", "left")
    form_n = -F.col("best.less")
    formed = F.when(form_n >= FACTOR * F.col("n"), F.struct(F.col("best.near").alias("form"), form_n.alias("form_n")))
    forms = staged(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), formed.alias("f")).select("word", "n", "n_near", "f.form", "f.form_n"), "spelling-forms")
    rows = forms.where("form IS NULL").withColumn("root", F.col("word")).unionByName(forms.where("form IS NOT NULL").join(rooted(forms), "word"))
    return rows.select("word", "form", "root", "n", "n_near", "form_n")
