"""N-gram Jaccard join: MinHash bands find candidates, Bayesian pruning drops the hopeless, the rest is verified exactly.

A pair of different texts is looked at once, in the first band whose four values agree. It is dropped as soon as
the posterior probability that its similarity reaches the threshold, given how many of the MinHash values compared
so far agree (uniform prior), falls below a tolerance; what is left is verified on the full shingle sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm.common import drop_staged, session_settings, staged, text_hash
from tradewind.llm.components import components
from tradewind.llm.members import is_set, member_test
from tradewind.llm.memos import claim

BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
LOOK = 16  # MinHash values compared between two tests of the posterior


@dataclass(frozen=True)
class Settings:
    """words: the shingle's length. tolerance: of the posterior. block: the most texts of a bucket compared in one go."""

    words: int = 5
    threshold: Fraction = Fraction(4, 5)
    tolerance: float = 1e-6
    block: int = 512
    block_shingles: int = 400_000


def _odd_numbers(n: int) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(f"minhash {i}".encode(), digest_size=8).digest(), "little") | 1 for i in range(n)], dtype=np.uint64)


class _WordHashes(dict):
    """Words to 64-bit hashes, a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_WORDS = _WordHashes()


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's k-word shingles; a shorter text is one shingle, none without words.

    Words are parted by ASCII white space.
    """
    words = (text or "").encode("utf-8", "surrogatepass").split()
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=n)
    k = min(k, n)
    with np.errstate(over="ignore"):
        key = np.full(n - k + 1, k, dtype=np.uint64)
        for j in range(k):
            key = (key ^ h[j : n - k + 1 + j]) * np.uint64(0x9FB21C651E98DF25)
            key ^= key >> np.uint64(32)
    return np.unique(key)


def signature(found: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """HASHES MinHash values, 16 bits of each kept."""
    low = np.full(len(odd), np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(found), 2048):
            np.minimum(low, (found[i : i + 2048, None] * odd).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint16)


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For each look, the fewest agreeing values that keep a pair.

    With m of n values agreeing and a uniform prior, P(similarity >= t) is the chance of at most m successes in
    n + 1 trials of chance t.
    """
    out = []
    for n in range(LOOK, HASHES + 1, LOOK):
        p, m = 0.0, 0
        while m <= n:
            p += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if p >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def _small_batches(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows, for rows that may be large."""
    return session_settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": rows})


def sketches(docs: DataFrame, id_col: str, text_col: str, how: Settings) -> DataFrame:
    """Staged: doc_id, text_hash, row (a number of its own), digest of the shingle set, n (its size), bands (the signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(_WORDS, _WORDS.clear)
        odd = _odd_numbers(HASHES)
        for batch in batches:
            digests, sizes, bands = [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, how.words)
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                sizes.append(len(found))
                bands.append(signature(found, odd).view(np.int64))
            flat = np.concatenate(bands) if bands else np.zeros(0, dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1, dtype=np.int32) * BANDS), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), lists, batch.column(2)], names=["doc_id", "digest", "n", "bands", "text_hash"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"), text_hash(F.col(text_col)).alias("text_hash"))
    return staged(source.mapInArrow(run, "doc_id long, digest binary, n long, bands array<long>, text_hash long").withColumn("row", F.monotonically_increasing_id()), "jaccard-sketches")


def _buckets(classes: DataFrame, how: Settings) -> DataFrame:
    """Each text of each bucket of two texts or more, once for every pair of blocks that it takes part in.

    A bucket is cut into blocks by a hash of the text, and every two blocks meet (and each with itself), so no
    task holds a large bucket whole.
    """
    banded = classes.select("node", "n", F.posexplode("bands").alias("band", "value"))
    sizes = banded.groupBy("band", "value").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles")).where("texts > 1")
    blocks = F.greatest(F.ceil(F.col("texts") / how.block), F.least(F.ceil(F.col("shingles") / how.block_shingles), F.col("texts"))).cast("int")
    sizes = sizes.select("band", "value", blocks.alias("blocks"))
    own = F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("blocks")).cast("int")
    member = banded.drop("n").join(sizes, ["band", "value"]).withColumn("own", own)
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return member.select("band", "value", F.least("own", "other").cast("int").alias("one"), F.greatest("own", "other").cast("int").alias("two"), "own", "node")


KEY = ["band", "value", "one", "two"]


def _cases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each group (KEY), from batches sorted by it, some groups at a time and never part of one."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        keys = np.stack([new.column(c).to_numpy().astype(np.int64) for c in KEY])
        change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        if held:
            last = [held[-1].column(c)[-1].as_py() for c in KEY]
            if keys[:, 0].tolist() != last:
                yield pa.concat_tables(held).combine_chunks()
                held = []
        if not len(change):
            held.append(new)
            continue
        cut = int(change[-1])
        yield pa.concat_tables([*held, new.slice(0, cut)]).combine_chunks()
        held = [new.slice(cut)]
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _groups(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in KEY])
    starts = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1))
    return starts, np.append(starts[1:], table.num_rows)


def _pairs(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the two texts of every pair to be looked at, a bounded number at a time."""
    starts, ends = _groups(table)
    one, two, own = (table.column(c).to_numpy() for c in ("one", "two", "own"))
    left, right, size = [], [], 0
    for b, e in zip(starts.tolist(), ends.tolist(), strict=True):
        if one[b] == two[b]:
            i, j = np.triu_indices(e - b, 1)
        else:
            first, second = np.flatnonzero(own[b:e] == one[b]), np.flatnonzero(own[b:e] == two[b])
            i, j = np.repeat(first, len(second)), np.tile(second, len(first))
        left.append(i + b)
        right.append(j + b)
        size += len(i)
        if size >= 50_000:
            yield np.concatenate(left), np.concatenate(right)
            left, right, size = [], [], 0
    if size:
        yield np.concatenate(left), np.concatenate(right)


def _promising(table: pa.Table, least: list[int], threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that first meet here and whose posterior stays above the tolerance."""
    bands = table.column("bands").combine_chunks()
    bands = bands.chunk(0) if isinstance(bands, pa.ChunkedArray) else bands
    wide = bands.flatten().to_numpy().reshape(-1, BANDS)
    short = np.ascontiguousarray(wide).view(np.uint16).reshape(-1, HASHES)
    band, n = table.column("band").to_numpy(), table.column("n").to_numpy()
    before = np.arange(BANDS)
    kept_i, kept_j = [], []
    for all_i, all_j in _pairs(table):
        for at in range(0, len(all_i), 50_000):
            i, j = all_i[at : at + 50_000], all_j[at : at + 50_000]
            small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            ok = small * threshold.denominator >= large * threshold.numerator
            i, j = i[ok], j[ok]
            met = ((wide[i] == wide[j]) & (before < band[i, None])).any(axis=1)
            i, j = i[~met], j[~met]
            same = np.zeros(len(i), dtype=np.int64)
            for look, enough in enumerate(least):
                part = slice(look * LOOK, (look + 1) * LOOK)
                same += (short[i, part] == short[j, part]).sum(axis=1)
                ok = same >= enough
                i, j, same = i[ok], j[ok], same[ok]
            kept_i.append(i)
            kept_j.append(j)
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(kept_i), np.concatenate(kept_j)) if kept_i else (none, none)


def _verified(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: Fraction) -> np.ndarray:
    """Which pairs reach the threshold, on the full sets."""
    used = np.unique(np.concatenate((i, j)))
    ids = np.unique(np.concatenate([sets[x] for x in used.tolist()]), return_inverse=True)[1]
    sizes = np.array([len(sets[x]) for x in used.tolist()])
    begin = np.concatenate(([0], np.cumsum(sizes)))
    place = {x: p for p, x in enumerate(used.tolist())}
    local = [ids[begin[p] : begin[p + 1]] for p in range(len(used))]
    flag = np.zeros(int(ids.max()) + 1, dtype=np.int64)
    order = np.argsort(i, kind="stable")
    out = np.zeros(len(i), dtype=bool)
    bounds = np.concatenate(([0], np.flatnonzero(np.diff(i[order])) + 1, [len(i)]))
    for b, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        mine = local[place[int(i[order[b]])]]
        partners = [local[place[x]] for x in j[order[b:e]].tolist()]
        flag[mine] = 1
        lengths = np.array([len(p) for p in partners])
        shared = np.add.reduceat(flag[np.concatenate(partners)], np.concatenate(([0], np.cumsum(lengths)[:-1])))
        flag[mine] = 0
        out[order[b:e]] = shared * threshold.denominator >= (len(mine) + lengths - shared) * threshold.numerator
    return out


def _needed(rows: DataFrame, how: Settings) -> DataFrame:
    """The rows of rows that are part of a promising pair of their group."""
    least = least_matches(float(how.threshold), how.tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _cases(batches):
            i, j = _promising(table, least, how.threshold)
            if len(i):
                yield from table.take(pa.array(np.unique(np.concatenate((i, j))))).to_batches()

    return rows.repartition(*KEY).sortWithinPartitions(*KEY, "node").mapInArrow(run, rows.schema)


def _links(rows: DataFrame, how: Settings) -> DataFrame:
    """One row for each text of each group with a verified link: node, root (least of those it hangs together with
    in the group), links (rows of documents that it is linked to there) and texts (different texts)."""
    least = least_matches(float(how.threshold), how.tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _cases(batches):
            i, j = _promising(table, least, how.threshold)
            if not len(i):
                continue
            node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
            sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("shingles").to_pylist()]
            starts, _ = _groups(table)
            group = np.searchsorted(starts, i, side="right")
            out: list[tuple] = []
            order = np.argsort(group, kind="stable")
            bounds = np.concatenate(([0], np.flatnonzero(np.diff(group[order])) + 1, [len(i)]))
            for b, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                a, c = i[order[b:e]], j[order[b:e]]
                right = _verified(sets, a, c, how.threshold)
                a, c = a[right], c[right]
                if not len(a):
                    continue
                used, where = np.unique(np.concatenate((a, c)), return_inverse=True)
                x, y = where[: len(a)], where[len(a) :]
                links = np.bincount(x, weights=copies[c], minlength=len(used)) + np.bincount(y, weights=copies[a], minlength=len(used))
                texts = np.bincount(np.concatenate((x, y)), minlength=len(used))
                root = np.asarray(node[used]).copy()
                while True:  # least label along the links
                    low = np.minimum(root[x], root[y])
                    following = root.copy()
                    np.minimum.at(following, x, low)
                    np.minimum.at(following, y, low)
                    if (following == root).all():
                        break
                    root = following
                out.append((node[used], root, links.astype(np.int64), texts))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], names=["node", "root", "links", "texts"])

    return rows.repartition(*KEY).sortWithinPartitions(*KEY, "node").mapInArrow(run, "node long, root long, links long, texts long")


def _shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, how: Settings) -> DataFrame:
    """digest and shingles (bytes of the sorted hashes) of at least the wanted texts (doc_id, digest)."""
    maybe = member_test(wanted, "doc_id")
    bitmap = maybe.bitmap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(_WORDS, _WORDS.clear)
        for batch in batches:
            texts = batch.column(1).filter(pa.array(is_set(bitmap.value, batch.column(0).to_numpy())))
            raw = [shingles(t, how.words).tobytes() for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in raw], pa.binary()), pa.array(raw, pa.binary())], names=["digest", "shingles"])

    source = docs.select(maybe.place(F.col(id_col).cast("long")).alias("p"), F.col(text_col).cast("string").alias("t"))
    return source.mapInArrow(run, "digest binary, shingles binary")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Settings | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, class_id, n_links, n_linked_texts, copies, text_hash, kept.

    Two documents are linked when the Jaccard similarity of their shingle sets reaches the threshold; documents
    with equal sets are copies and always linked. class_id is the least doc_id that a document hangs together
    with over links, n_links counts the documents it is linked to, and kept marks one row of each class (the
    least id; null ids come last, ties go to one of them). Texts without words, null or empty, have no links and
    are classes of their own (class_id: their own id). Very long texts count whole; repeated rows are copies; an
    empty table gives no rows; other columns of docs, whatever their names, are not read.

    Copies are folded first and only different texts are compared. A pair at the threshold is missed if none of the
    bands agree (3e-6) or the posterior misleads (about the tolerance); more similar pairs are missed far less.
    """
    how = how or Settings()
    spark = docs.sparkSession
    with _small_batches(spark, 2000):
        own = sketches(docs, id_col, text_col, how)
    classes = staged(
        own.where("n > 0").groupBy("digest").agg(F.min("row").alias("node"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("holder"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")), "jaccard-classes"
    )
    texts = classes.select("node", "digest", "copies", "n", "bands", F.col("holder.doc_id").alias("doc_id"))
    with _small_batches(spark, 5000):
        needed = staged(_needed(_buckets(classes, how).join(texts, "node"), how), "jaccard-needed")
    sets = _shingle_sets(docs, needed, id_col, text_col, how).groupBy("digest").agg(F.first("shingles").alias("shingles"))
    with _small_batches(spark, 256):
        links = staged(_links(needed.drop("digest", "doc_id").join(needed.select("node", "digest").distinct().join(sets, "digest").select("node", "shingles"), "node"), how), "jaccard-links")
    drop_staged(needed)

    roots = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    linked = classes.select("node", "digest", "holder", "copies").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = linked.groupBy("root").agg(F.min("holder").alias("head"))
    by_digest = linked.join(heads, "root").select("digest", "head", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_linked_texts"))
    out = own.select("doc_id", "text_hash", "row", "digest", "n").join(by_digest, "digest", "left")
    alone = F.col("n") == 0
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        F.when(alone, F.lit(0)).otherwise(F.col("n_linked_texts")).cast("long").alias("n_linked_texts"),
        F.when(alone, F.lit(1)).otherwise(F.col("copies")).cast("long").alias("copies"),
        "text_hash",
        (alone | (F.col("row") == F.col("head.row"))).alias("kept"),
    )
