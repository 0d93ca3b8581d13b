"""Packing: documents cut into pieces and dealt to near-equal token windows by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.tokenization import chunk_tokenizer, encoded

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


def differencing(sizes: list[int], k: int) -> np.ndarray:
    """The window (0 to k-1) of each item, by k-way Karmarkar-Karp differencing.

    Every item starts as a partial partition of its own. The two with the widest spread are merged, the largest sums
    of one with the smallest of the other, and the least sum is taken off all, until one partition is left. A partial
    partition is the list of its parts, largest first, each as sum << 32 | part; empty parts are left out.
    """
    n = len(sizes)
    if k <= 1 or n == 0:
        return np.zeros(n, dtype=np.int64)
    joined: list[tuple[int, int]] = []  # part n + i: the two parts it was made of
    partial = {i: [size << 32 | i] for i, size in enumerate(sizes)}
    heap = [(-size, i) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    part_of = (1 << 32) - 1
    while len(heap) > 1:
        _, x = heapq.heappop(heap)
        _, y = heap[0]
        a, b = partial.pop(x), partial.pop(y)
        both = len(a) + len(b) - k
        if both <= 0:
            merged = a + b
        else:  # the last parts of a meet those of b, largest with smallest
            merged = a[:-both] + b[:-both]
            for p, q in zip(a[-both:], reversed(b[-both:]), strict=True):
                merged.append((p >> 32) + (q >> 32) << 32 | n + len(joined))
                joined.append((p & part_of, q & part_of))
        merged.sort(reverse=True)
        if len(merged) == k and (least := merged[-1] >> 32):
            merged = [p - (least << 32) for p in merged]
        partial[y] = merged
        heapq.heapreplace(heap, (-(merged[0] >> 32), y))
    out = np.empty(n, dtype=np.int64)
    for window, p in enumerate(partial.popitem()[1]):
        parts = [p & part_of]
        while parts:
            part = parts.pop()
            if part < n:
                out[part] = window
            else:
                parts.extend(joined[part - n])
    return out


def windows_within(sizes: list[int], capacity: int) -> tuple[np.ndarray, int]:
    """The window of each item and their number: the fewest that could hold them, raised while one overflows."""
    total = sum(sizes)
    k = max(1, -(-total // capacity))
    while True:
        found = differencing(sizes, k)
        if len(sizes) == 0 or np.bincount(found, weights=sizes).max() <= capacity:
            return found, k
        k += 1


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *, spaced: bool = True, eos_id: int = 1, capacity: int = 2048, smallest_cut: int = 128, group_windows: int = 16, slack: int = 1, memo: int = 1_000_000) -> DataFrame:
    """One row for each piece of each document, with its sequence and its place there.

    A document's ids end with eos_id; a null or empty text has that one id alone, so every row of docs gives at least
    one piece and an empty table gives none. Full windows are cut off a document first, however long it is; its rest
    is halved down to smallest_cut ids. Pieces are dealt by differencing whenever they add up to group_windows windows
    less slack ids each, the last of them cut ever smaller so that they even out what is left; were a window to
    overflow, there is one window more. Each task
    packs the rows of its own partition, so nothing is shuffled and no key matters; only a partition's last group
    leaves a window partly empty. Repeated rows and repeated or null ids are packed as documents of their own; pieces
    of equal size are told apart by their order. Other columns of docs, whatever their names, are not read.
    sequence_id is the partition's number times 2^32 plus a counter, the same whenever a task is run again.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    target = group_windows * max(1, capacity - slack)
    finest = max(1, group_windows * 3 // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = chunk_tokenizer(tokenizer_path, spaced, memo)
        ctx = TaskContext.get()
        sequence = (ctx.partitionId() if ctx else 0) << 32
        end = int(eos_id).to_bytes(4, "little")
        ready: list[pa.RecordBatch] = []
        pieces: list[tuple] = []  # of the group that is being filled: key, start, length, checksum, the document's ids
        whole: list[tuple] = []  # windows of their own
        held = 0

        def table(rows: list[tuple], windows: np.ndarray, offsets: np.ndarray, fill: np.ndarray) -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.int64()) for c in (windows, offsets, fill))], names=names)

        def deal() -> None:
            nonlocal sequence
            sizes = [p[2] for p in pieces]
            found, k = windows_within(sizes, capacity)
            order = np.argsort(found, kind="stable")
            length = np.array(sizes, dtype=np.int64)
            before = np.cumsum(length[order]) - length[order]
            fill = np.bincount(found, weights=length, minlength=k).astype(np.int64)
            offsets = np.empty(len(sizes), dtype=np.int64)
            offsets[order] = before - (np.cumsum(fill) - fill)[found[order]]
            ready.append(table(pieces, sequence + found, offsets, fill[found]))
            sequence += k
            pieces.clear()

        def deal_whole() -> None:
            nonlocal sequence
            n = len(whole)
            ready.append(table(whole, sequence + np.arange(n), np.zeros(n, dtype=np.int64), np.full(n, capacity)))
            sequence += n
            whole.clear()

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), encoded(tokenizer, batch.column(1).to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                at = n - n % capacity
                for i in range(0, at, capacity):
                    whole.append((key, i, capacity, zlib.crc32(ids[4 * i : 4 * (i + capacity)]), n))
                rest = n - at
                while rest:  # halves, so that every group has small pieces to balance with
                    size = min(rest if rest <= smallest_cut else rest - rest // 2, max(1, (target - held) // finest))
                    pieces.append((key, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), n))
                    at, rest, held = at + size, rest - size, held + size
                    if held == target:
                        deal()
                        held = 0
                if len(whole) >= 10_000:
                    deal_whole()
            yield from ready
            ready.clear()
        if pieces:
            deal()
        if whole:
            deal_whole()
        yield from ready

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, SCHEMA)
