"""Exact top-k by word similarity: upper bounds first, the real score only where a bound leaves room for it.

Queries and items are dealt into blocks on Spark. For every two blocks one task builds an inverted table of the
items' trigrams, counts what each item shares with a query, and takes items in falling order of the bound that this
gives. Short ones are scored many at a time; longer ones are bounded again by the hits that their stretches begin at,
and only stretches that could still win are scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.sources.shared import staged

_WORDS = re.compile(r"[^\W_]+")
#: Rows of a block: queries at most, items at least (unless there are fewer); characters of a block's items and of its queries.
QUERIES, ITEMS, CHARACTERS, ASKED = 65_536, 1024, 1_500_000, 4_000_000
#: So few queries, of so few characters, are sent to all items, which then need no blocks.
FEW, BRIEF = 64, 200_000
#: Places at which stretches are bounded together; items that are taken at a time, at first and at most.
STRIDE, TAKEN, MOST_TAKEN = 16, 64, 4096
#: Longer items that are scored together.
SCORED = 8
#: Numbers of whole columns that a block holds at a time.
COUNTED = 64_000_000
#: Running counts that are held at a time, so that a very long text needs no more memory than many short ones.
CELLS = 2_000_000
#: A trigram is seldom if one of so many items of a block holds it at most.
SELDOM = 32
#: Queries of a group whose few trigrams are looked at together.
TOGETHER = 256
#: Places before a seldom trigram within which different trigrams are counted.
NEAR = 512
#: Texts of so many trigrams are scored without bounding their stretches first.
SHORT = 64
#: Within so many places equal trigrams are looked for, when what a stretch holds is bounded.
WIDTHS = np.array([16, 32, 64, 128, 256, 512, 1024, 2048])
#: Tasks that groups of blocks are dealt to at most, or the session's number of shuffle partitions if that is more.
MOST_TASKS = 4096
FOUND = "query long, id long, score double, block int, pairs long, bounded long, verified long"


def codes_of(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of all texts' words, one text after another, and how many each text has: a word has one more than letters."""
    found = [_WORDS.findall((t or "").lower()) for t in texts]
    many = np.fromiter((sum(map(len, words)) + len(words) for words in found), np.int64, len(found))
    if not many.any():
        return np.zeros(0, np.int64), many
    c = np.frombuffer(f"  {'   '.join(chain.from_iterable(found))} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    inside = (c[1:-1] != 32) | (c[2:] != 32)
    return (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[inside], many


def trigram_codes(text: str | None) -> np.ndarray:
    """The trigrams of each word in order (two blanks in front, one behind), each as one number."""
    return codes_of([text])[0]


def repeats_of(codes: np.ndarray) -> np.ndarray:
    """For every place the last earlier one with the same trigram, else -1."""
    before = np.full(len(codes), -1, np.int64)
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    return before


def _running(starts: np.ndarray, before: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From each start to each place: how many different trigrams of the query, and how many others."""
    place = np.arange(len(before))
    new = (before < starts[:, None]) & (place >= starts[:, None])
    return np.cumsum(new & hit, axis=1, dtype=np.int32), np.cumsum(new & ~hit, axis=1, dtype=np.int32)


def _groups(starts: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
    """So many starts at a time that their running counts fit CELLS numbers."""
    step = max(1, CELLS // max(1, length))
    return ((at, min(at + step, len(starts))) for at in range(0, len(starts), step))


def stretch_bounds(n: int, before: np.ndarray, hit: np.ndarray, stride: int = STRIDE) -> np.ndarray:
    """For every `stride` places, what no stretch that begins among them can exceed.

    It has at most what the query shares from the first of them on, and at least what is not the query's from the
    first place behind them on.
    """
    starts = np.arange(0, len(before), stride)
    out = np.empty(len(starts))
    for a, b in _groups(starts, len(before)):
        shared, others = _running(starts[a : b + 1], before, hit)
        if b == len(starts):
            others = np.concatenate([others, np.zeros((1, len(before)), np.int32)])
        out[a:b] = (shared[: b - a] / (n + others[1:])).max(axis=1)
    return out


def stretch_score(n: int, before: np.ndarray, hit: np.ndarray, starts: np.ndarray) -> float:
    """The greatest share of common trigrams over the stretches that begin at these places."""
    best = 0.0
    for a, b in _groups(starts, len(before)):
        shared, others = _running(starts[a:b], before, hit)
        best = max(best, float((shared / (n + others)).max()))
    return best


def grid(n: int) -> list[tuple[int, int]]:
    """Numbers of hits a stretch may have, as ranges [from, to): one by one at first, then a quarter more each time; the last is open."""
    ends = [0]
    while ends[-1] < n - 1:
        ends.append(min(n - 1, ends[-1] + max(1, ends[-1] // 4)))
    return [*zip(ends, ends[1:], strict=False), (ends[-1], n)]


class BlockSearch:
    """The best k items of a block for each query of a block, with scores over `least`.

    The items' trigrams lie in one array, place after place, so that many items are bounded or scored by one step.
    """

    def __init__(self, texts: list[str | None], k: int, least: float):
        self.k, self.least = k, least
        places, self.lengths = codes_of(texts)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.item = np.repeat(np.arange(len(texts), dtype=np.int32), self.lengths)
        self.grams, gram = np.unique(places, return_inverse=True)
        self.gram = gram.astype(np.int32)
        # for every place the last earlier one of its item with the same trigram (-1: none), and whether none follows
        order = np.argsort(self.item * np.int64(max(1, len(self.grams))) + self.gram, kind="stable")
        same = (self.item[order[1:]] == self.item[order[:-1]]) & (self.gram[order[1:]] == self.gram[order[:-1]])
        self.before = np.full(len(places), -1, np.int32)
        self.before[order[1:][same]] = order[:-1][same]
        self.last = np.ones(len(places), bool)
        self.last[order[:-1][same]] = False
        # items that hold each trigram, once each
        first = np.flatnonzero(self.before < 0)
        first = first[np.argsort(self.gram[first], kind="stable")]
        self.holders = self.item[first]
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(self.gram[first], minlength=len(self.grams)))]).astype(np.int64)
        self.distinct = np.bincount(self.holders, minlength=len(self.lengths))
        self._dense: dict[int, np.ndarray] = {}
        self._fresh: dict[int, np.ndarray] = {}
        self._near: np.ndarray | None = None
        # all places of each trigram
        self.standing = np.argsort(self.gram, kind="stable").astype(np.int32)
        self.stands = np.concatenate([[0], np.cumsum(np.bincount(self.gram, minlength=len(self.grams)))]).astype(np.int64)
        self.pairs = self.bounded = self.verified = 0

    def known(self, query: np.ndarray) -> np.ndarray:
        """The block's numbers of the query's trigrams that it has."""
        if not len(self.grams):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.grams, query), len(self.grams) - 1)
        return at[self.grams[at] == query]

    def shared(self, queries: list[np.ndarray]) -> Iterator[np.ndarray]:
        """For each query, how many different trigrams it shares with each item.

        Trigrams that many items hold are added as whole columns.
        """
        for query in queries:
            yield self._counts(self.known(query))

    def _counts(self, known: np.ndarray) -> np.ndarray:
        """How many of these trigrams each item holds."""
        n = len(self.lengths)
        counts = np.zeros(n, np.uint8 if len(known) < 256 else np.int32)
        for g in known:
            a, b = self.ends[g], self.ends[g + 1]
            if (b - a) * 24 < n:
                counts[self.holders[a:b]] += 1
                continue
            if g not in self._dense:
                if (len(self._dense) + 1) * n > COUNTED:
                    self._dense.clear()
                column = self._dense[g] = np.zeros(n, np.uint8)
                column[self.holders[a:b]] = 1
            counts += self._dense[g]
        return counts

    def _places(self, taken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of these items: their places one after another, and whose they are (by its place among the taken)."""
        many = self.lengths[taken]
        whose = np.repeat(np.arange(len(taken)), many)
        return np.arange(len(whose)) - np.repeat(np.cumsum(many) - many - self.offsets[taken], many), whose

    def fresh(self, width: int) -> np.ndarray:
        """Up to each place: how many have no equal trigram within so many places before."""
        if width not in self._fresh:
            own = (self.before < 0) | (self.before < np.arange(len(self.before)) - width)
            self._fresh[width] = np.concatenate([[0], np.cumsum(own)])
        return self._fresh[width]

    def hit_bounds(self, n: int, at: np.ndarray, whose: np.ndarray) -> np.ndarray:
        """For every hit (place, item), what no stretch that begins at it can exceed.

        A stretch of h hits has at most h (and n) of the query's trigrams. Within `width` places of its beginning, a
        place without an equal one so shortly before is a trigram of its own, so what is not a hit among them counts.
        """
        width = 1 << (2 * n).bit_length()
        fresh = self.fresh(width)
        most = np.zeros(len(at))
        for a, b in grid(n):
            if a >= len(at):
                break
            own = whose[a:] == whose[: len(whose) - a]
            start = at[: len(at) - a]
            others = fresh[np.minimum(at[a:], start + width - 1) + 1] - fresh[start] - (a + 1)
            bound = np.where(own, min(b, n) / (n + np.maximum(others, 0)), 0.0)
            np.maximum(most[: len(bound)], bound, out=most[: len(bound)])
        return most

    def short_scores(self, n: int, taken: np.ndarray, is_hit: np.ndarray, floor: float, asks: np.ndarray | None = None) -> np.ndarray:
        """Scores of items of few trigrams, all at once; where one is below the floor, it may come out lower than it is.

        asks: of several queries' rows of hits the one that each item is scored for.
        """
        many = self.lengths[taken]
        place = np.arange(many.max())
        at = np.minimum(self.offsets[taken][:, None] + place, len(self.gram) - 1)
        inside = place < many[:, None]
        hit = (is_hit[self.gram[at]] if asks is None else is_hit[asks[:, None], self.gram[at]]) & inside
        before = self.before[at] - self.offsets[taken][:, None]
        ahead = np.cumsum((hit & self.last[at])[:, ::-1], axis=1)[:, ::-1]  # different trigrams of the query from here on
        rank = np.cumsum(hit & (ahead / n >= floor), axis=1)
        best = np.zeros(len(taken))
        rows = np.flatnonzero(rank[:, -1] > 0)
        r = 1
        while len(rows):
            start = (rank[rows] < r).sum(axis=1)
            live = ahead[rows, start] / n > best[rows]  # later starts have no more ahead
            rows, start = rows[live], start[live, None]
            new = (before[rows] < start) & (place >= start) & inside[rows]
            m = np.cumsum(new & hit[rows], axis=1, dtype=np.int16)
            either = np.cumsum(new, axis=1, dtype=np.int16)
            best[rows] = np.maximum(best[rows], (m / (n + (either - m).astype(np.int64))).max(axis=1, initial=0.0))
            r += 1
            rows = rows[rank[rows, -1] >= r]
        return best

    def best(self, query: np.ndarray, shared: np.ndarray, ids: np.ndarray) -> list[tuple[float, int]]:
        """(score, place) of the best k."""
        self.pairs += len(shared)
        if not len(query):
            return []
        known = self.known(query)
        return self._best(len(query), known, self._hit(known), shared, ids)

    def search(self, queries: list[np.ndarray], ids: np.ndarray, floors: list[float] | None = None) -> list[list[tuple[float, int]]]:
        """The same for each query, and what it took: (found, pairs, bounded, verified). floors: what need not be found lies below.

        Queries of equally many trigrams that differ only in such as few items hold are searched for at once by the
        others (the work counts for the first). An item that holds none of those few has that very score, and others
        have no less; so the k-th found bounds what each of the queries finds, and only items that hold some of its
        few trigrams are looked at for it.
        """
        many = np.diff(self.ends)
        groups: dict[tuple, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        out: list[tuple[list[tuple[float, int]], int, int, int]] = [([], len(ids), 0, 0)] * len(queries)
        for j, query in enumerate(queries):
            known = self.known(query)
            few = many[known] * SELDOM <= len(ids)
            if len(query):
                alone = j if len(query) > SHORT or floors else -1
                groups.setdefault((len(query), alone, known[~few].tobytes()), []).append((j, known[~few], known[few]))
        for (n, alone, _), asking in groups.items():
            self.bounded = self.verified = 0
            core = asking[0][1] if len(asking) > 1 else np.concatenate(asking[0][1:])
            is_hit, counts = self._hit(core), self._counts(core)
            found = self._best(n, core, is_hit, counts, ids, floors[alone] if floors else 0.0)
            for lot in range(0, len(asking), TOGETHER):
                some = asking[lot : lot + TOGETHER]
                bests = self._besides(n, [few for _, _, few in some], is_hit, counts, ids, found) if len(asking) > 1 else [found]
                for (j, _, _), best in zip(some, bests, strict=True):
                    out[j] = (best, len(ids), self.bounded, self.verified)
                    self.bounded = self.verified = 0
        return out

    def _besides(self, n: int, fews: list[np.ndarray], is_hit: np.ndarray, counts: np.ndarray, ids: np.ndarray, found: list[tuple[float, int]]) -> list[list[tuple[float, int]]]:
        """The best k for each query that has some few trigrams besides those (is_hit, counts) by which `found` was found."""
        floor = found[-1][0] if len(found) == self.k else 0.0
        items, places, holding, pairs_before = [], [], [], 0
        hits = np.repeat(is_hit[None], len(fews), axis=0)
        for own, few in zip(hits, fews, strict=True):
            own[few] = True
            at = np.concatenate([np.zeros(0, np.int32), *(self.standing[self.stands[g] : self.stands[g + 1]] for g in few)])
            shared = counts.astype(np.int32)
            for g in few:
                shared[self.holders[self.ends[g] : self.ends[g + 1]]] += 1
            share = shared[self.item[at]] / n
            at = at[(share >= floor) & (share > self.least)]
            some, which = np.unique(self.item[at], return_inverse=True)
            items.append(some)
            places.append(at)
            holding.append(pairs_before + which)
            pairs_before += len(some)
        asks = np.repeat(np.arange(len(fews)), [len(some) for some in items])
        pairs, at, whose = np.concatenate(items), np.concatenate(places).astype(np.int64), np.concatenate(holding)
        scores, brief = np.zeros(len(pairs)), self.lengths[pairs] <= SHORT
        short = np.flatnonzero(brief)
        for some in np.split(short, np.arange(CELLS // SHORT, len(short), CELLS // SHORT)):
            if len(some):
                scores[some] = self.short_scores(n, pairs[some], hits, floor, asks[some])
        if not brief.all():
            own = ~brief[whose]
            self._long_scores(n, pairs, ~brief, asks, hits, self._hits(np.flatnonzero(is_hit)), at[own], whose[own], floor, scores)
        self.verified += len(pairs)
        out, ends = [], np.cumsum([len(some) for some in items])
        for some, end in zip(items, ends, strict=True):
            if not len(some):
                out.append(found)
                continue
            own = scores[end - len(some) : end]
            good = (own > self.least) & (own >= floor)
            if not good.any():
                out.append(found)
                continue
            best = {i: score for score, i in found}  # a stretch without any of the few has this score still
            for x, i in zip(own[good].tolist(), some[good].tolist(), strict=True):
                best[i] = max(x, best.get(i, 0.0))
            out.append([(score, i) for score, _, i in sorted(((score, -int(ids[i]), i) for i, score in best.items()), reverse=True)[: self.k]])
        return out

    def _long_scores(self, n: int, items: np.ndarray, long: np.ndarray, asks: np.ndarray, hits: np.ndarray, common: np.ndarray, at: np.ndarray, whose: np.ndarray, floor: float, scores: np.ndarray) -> None:
        """Raises the scores of those of the items that are long to what stretches have in which one of the places `at` (of item `whose`) stands.

        common: the places of the other hits. A stretch that reaches the floor has n / floor different trigrams at
        most, so only hits so near before such a place can begin one.
        """
        first = np.searchsorted(common, self.offsets[items])
        many = np.where(long, np.searchsorted(common, self.offsets[items] + self.lengths[items]) - first, 0)
        sizes = np.cumsum(many + np.bincount(whose, minlength=len(items)))
        order = np.argsort(whose, kind="stable")
        at, whose = at[order], whose[order]
        fresh = self.fresh(NEAR)
        for lot in np.split(np.arange(len(items)), np.flatnonzero(np.diff(sizes // CELLS)) + 1):
            a, b = np.searchsorted(whose, [lot[0], lot[-1] + 1])
            row = np.repeat(lot, many[lot])
            place = common[np.arange(len(row)) - np.repeat(np.cumsum(many[lot]) - many[lot] - first[lot], many[lot])]
            row, place = np.concatenate([row, whose[a:b]]), np.concatenate([place, at[a:b]])
            order = np.lexsort((place, row))
            row, place, besides = row[order], place[order], order >= len(order) - (b - a)
            if not len(row):
                continue
            end = np.searchsorted(row, row, side="right")
            to = np.minimum.accumulate(np.where(besides, np.arange(len(row)), len(row))[::-1])[::-1]  # the next one of `at`
            until = np.minimum(place[np.minimum(to, len(row) - 1)], place + NEAR - 1)
            begins = (to < end) & ((fresh[until + 1] - fresh[place]) * floor <= n * (1 + 1e-9))
            most, reach = self.reaches(n, place, end, floor, begins)
            good = np.flatnonzero((most >= floor) & (most > self.least))
            np.maximum.at(scores, row[good], self.row_scores(n, place[good], reach[good], hits, asks[row[good]]))
        self.bounded += int(long.sum())

    def _hit(self, known: np.ndarray) -> np.ndarray:
        is_hit = np.zeros(len(self.grams), bool)
        is_hit[known] = True
        return is_hit

    def _best(self, n: int, known: np.ndarray, is_hit: np.ndarray, shared: np.ndarray, ids: np.ndarray, start: float = 0.0) -> list[tuple[float, int]]:
        """(score, place) of the best k that score `start` at least.

        What a query shares with an item bounds its score. Items are taken in falling order of that bound and rising
        order of their ids, until the k-th score rules out what follows.
        """
        top: list[tuple[float, int, int]] = []  # falling score, then rising id
        floor = (max(self.least, start), -np.inf)  # what a score and an id must exceed: ids count from below, so negated

        def add(scores: np.ndarray, items: np.ndarray) -> None:
            nonlocal top, floor
            over = np.flatnonzero((scores > self.least) & (scores >= floor[0]))
            if len(over):
                top = sorted([*top, *((float(scores[j]), -int(ids[items[j]]), int(items[j])) for j in over)], reverse=True)[: self.k]
                if len(top) == self.k:
                    floor = top[-1][:2]

        def left(items: np.ndarray, bounds: np.ndarray) -> np.ndarray:
            """Which items could still win."""
            if len(top) < self.k:
                return (bounds > self.least) & (bounds >= start)
            return (bounds > floor[0]) | ((bounds == floor[0]) & (-ids[items] > floor[1]))

        levels = np.bincount(shared, minlength=1)
        share = np.arange(len(levels)) / n
        places, step, level = None, TAKEN, len(levels) - 1
        while level >= 0 and share[level] > self.least and share[level] >= floor[0]:
            most, rows = level, 0
            while level >= 0 and share[level] > self.least and rows < MOST_TAKEN:
                rows += levels[level]
                level -= 1
            rest = np.flatnonzero((shared > level) & (shared <= most))
            rest = rest[np.lexsort((ids[rest], -shared[rest].astype(np.int64)))]
            while len(rest := rest[left(rest, share[shared[rest]])]):
                taken, rest, step = rest[:step], rest[step:], min(4 * step, MOST_TAKEN)
                brief = self.lengths[taken] <= SHORT
                if brief.any():
                    self.verified += int(brief.sum())
                    add(self.short_scores(n, taken[brief], is_hit, floor[0]), taken[brief])
                if not brief.all():
                    places = self._hits(known) if places is None else places
                    self._long(n, taken[~brief], places, is_hit, left, add, lambda: max(floor[0], self.least))
        return [(score, i) for score, _, i in top]

    def _hits(self, known: np.ndarray) -> np.ndarray:
        """All places of these trigrams, in order."""
        return np.sort(np.concatenate([self.standing[self.stands[g] : self.stands[g + 1]] for g in known])) if len(known) else np.zeros(0, np.int32)

    def _long(self, n: int, taken: np.ndarray, places: np.ndarray, is_hit: np.ndarray, left, add, floor) -> None:
        """Longer items: the stretches between their hits are bounded together; items are scored many at a time in
        falling order of their best bound, from those hits and as far as one could win."""
        first = np.searchsorted(places, self.offsets[taken])
        many = np.searchsorted(places, self.offsets[taken] + self.lengths[taken]) - first
        lots = np.cumsum(many) // CELLS
        for some in np.split(np.arange(len(taken)), np.flatnonzero(np.diff(lots)) + 1):
            items, size = taken[some], many[some]
            self.bounded += len(items)
            whose = np.repeat(np.arange(len(items)), size)
            at = places[np.arange(len(whose)) - np.repeat(np.cumsum(size) - size - first[some], size)].astype(np.int64)
            if n <= SHORT:
                self._scored(n, items, at, whose, size, True, is_hit, left, add, floor)
                continue
            rough, whole = self.hit_bounds(n, at, whose), np.zeros(len(items))
            np.maximum.at(whole, whose, rough)
            falling, step = np.argsort(-whole, kind="stable"), SCORED
            while len(falling := falling[left(items[falling], whole[falling])]):
                now, falling, step = np.sort(falling[:step]), falling[step:], 2 * step
                own = np.flatnonzero(np.isin(whose, now))
                close = self._close(n, items[now], at[own], size[now], rough[own], is_hit)
                some = np.maximum.reduceat(close, np.cumsum(size[now]) - size[now]) >= floor()
                kept, now = np.repeat(some, size[now]), now[some]
                self._scored(n, items[now], at[own[kept]], np.searchsorted(now, whose[own[kept]]), size[now], close[kept] >= floor(), is_hit, left, add, floor)

    def _scored(self, n: int, items: np.ndarray, at: np.ndarray, whose: np.ndarray, size: np.ndarray, begins: np.ndarray | bool, is_hit: np.ndarray, left, add, floor) -> None:
        """Adds the scores of those of the items that could win. at: their hits, of item `whose`, `size` in each; begins: where stretches may."""
        if len(at):
            most, reach = self.reaches(n, at, np.cumsum(size)[whose], floor(), begins)
            whole = np.zeros(len(items))
            np.maximum.at(whole, whose, most)
            begins = np.cumsum(size) - size
            falling = np.argsort(-whole, kind="stable")
            while len(falling := falling[left(items[falling], whole[falling])]):
                now, falling = falling[:SCORED], falling[SCORED:]
                rows = [b + np.flatnonzero((most[b : b + c] >= floor()) & (most[b : b + c] > self.least)) for b, c in zip(begins[now], size[now], strict=True)]
                now, rows = now[[len(r) > 0 for r in rows]], np.concatenate(rows)
                best = np.zeros(len(items))
                np.maximum.at(best, whose[rows], self.row_scores(n, at[rows], reach[rows], is_hit))
                self.verified += len(now)
                add(best[now], items[now])

    def _close(self, n: int, items: np.ndarray, at: np.ndarray, size: np.ndarray, rough: np.ndarray, is_hit: np.ndarray) -> np.ndarray:
        """For each of the items' hits a closer bound than `rough`, for queries so long that their stretches are, too."""
        out = rough.copy()
        for item, end, many in zip(items, np.cumsum(size), size, strict=True):
            a = self.offsets[item]
            piece = slice(a, a + self.lengths[item])
            bounds = stretch_bounds(n, self.before[piece] - a, is_hit[self.gram[piece]])
            out[end - many : end] = np.minimum(rough[end - many : end], bounds[(at[end - many : end] - a) // STRIDE])
        return out

    def reaches(self, n: int, at: np.ndarray, end: np.ndarray, floor: float, begins: np.ndarray | bool = True) -> tuple[np.ndarray, np.ndarray]:
        """For every hit: what no stretch from it exceeds, as far as that is at least `floor` (else 0), and the last
        hit at which such a stretch may end. at: places of the hits of some items; end: behind each, its item's last;
        begins: which hits stretches are looked for from.

        All stretches grow hit by hit. Their trigrams of the query are counted exactly; of the others those count that
        have no equal one shortly before, where `shortly` is the least of WIDTHS that is as long as the stretch.
        """
        before = self.before[at]
        seen = np.concatenate([[0], np.cumsum(self.last[at])])
        ahead = seen[end] - seen[:-1]  # different trigrams of the query from here on
        if self._near is None:
            self._near = np.stack([self.fresh(w).astype(np.int32) for w in WIDTHS])
        own = np.zeros((len(WIDTHS), len(at) + 1), np.int32)
        np.cumsum(self._near[:, at + 1] - self._near[:, at], axis=1, out=own[:, 1:])
        most, reach = np.zeros(len(at)), at.copy()
        rows = np.flatnonzero((ahead / n >= floor) & (ahead / n > self.least) & begins)
        shared, others, k = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), 0
        while len(rows):
            to, start, there = rows + k, at[rows], at[rows + k]
            new = before[to] < start
            shared += new
            width = np.searchsorted(WIDTHS, there - start + 1)
            inside = width < len(WIDTHS)  # longer stretches keep what a shorter one had
            width = np.minimum(width, len(WIDTHS) - 1)
            least = self._near[width, there + 1] - self._near[width, start] - own[width, to + 1] + own[width, rows]
            others = np.where(inside, np.maximum(others, least), others)
            bound = shared / (n + others)
            good = new & (bound >= floor) & (bound > self.least)
            most[rows[good]] = np.maximum(most[rows[good]], bound[good])
            reach[rows[good]] = there[good]
            limit = ahead[rows] / (n + others)
            k += 1
            live = (shared < ahead[rows]) & (limit >= floor) & (limit > self.least) & (rows + k < end[rows])
            rows, shared, others = rows[live], shared[live], others[live]
        return most, reach

    def row_scores(self, n: int, start: np.ndarray, reach: np.ndarray, is_hit: np.ndarray, asks: np.ndarray | None = None) -> np.ndarray:
        """The greatest score over the stretches from each start that end no later than its reach."""
        out, size = np.zeros(len(start)), reach - start + 1
        for some in np.split(np.arange(len(start)), np.flatnonzero(np.diff(np.cumsum(size) // CELLS)) + 1) if len(start) else ():
            many = size[some]
            heads = np.cumsum(many) - many
            at = np.arange(many.sum()) - np.repeat(heads - start[some], many)
            new = self.before[at] < np.repeat(start[some], many)
            hit = is_hit[self.gram[at]] if asks is None else is_hit[np.repeat(asks[some], many), self.gram[at]]
            counts = [np.concatenate([[0], np.cumsum(x)]) for x in (new & hit, new & ~hit)]
            m, x = (c[1:] - np.repeat(c[heads], many) for c in counts)
            out[some] = np.maximum.reduceat(m / (n + x), heads)
        return out


def extent(texts: DataFrame) -> tuple[int, int]:
    """Rows and characters."""
    rows, chars = texts.agg(F.count("*"), F.sum(F.length("text"))).first()
    return rows, chars or 0


def blocks_of(queries: DataFrame, items: DataFrame, query_block: int, item_block: int | None) -> tuple[int, int]:
    """How many blocks of queries and of items (both: id, text): by their number and characters; smaller blocks of items (of ITEMS rows at least)
    as long as not every core has several. item_block states their rows instead."""
    asking, asked = extent(queries)
    n_q = max(1, -(-asking // query_block), -(-asked // ASKED))
    rows, chars = extent(items)
    if item_block:
        return n_q, max(1, -(-rows // item_block))
    wanted = -(-8 * items.sparkSession.sparkContext.defaultParallelism // n_q)
    return n_q, max(1, -(-chars // CHARACTERS), min(-(-rows // ITEMS), wanted))


def dealt(queries: DataFrame, items: DataFrame, n_q: int, n_x: int):
    """Both sides grouped by (q_block, x_block), so that every block of queries meets every block of items in one group.

    Groups are dealt to a stated number of tasks: they are small and slow, so their bytes tell nothing about how
    many of them one task should take.
    """
    parts = min(2 * n_q * n_x, max(MOST_TASKS, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def one(df: DataFrame, own: str, n_own: int, other: str, n_other: int):
        rows = df.withColumn(own, F.pmod(F.xxhash64(*df.columns), F.lit(n_own)).cast("int"))
        rows = rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))
        return rows.repartition(parts, "q_block", "x_block").groupBy("q_block", "x_block")

    return one(queries, "q_block", n_q, "x_block", n_x), one(items, "x_block", n_x, "q_block", n_q)


def texts_of(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def asked_once(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries (id, text) of which each text is left once, and (id, query): which of them stands for each.

    Equal texts have equal answers, so they are searched for once, however many ask.
    """
    rows = texts_of(queries)
    once = rows.groupBy("text").agg(F.min("id").alias("id")).select("id", "text")
    return once, rows.join(once.withColumnRenamed("id", "query"), "text").select("id", "query")


def answered(found: DataFrame, stands: DataFrame) -> DataFrame:
    """The answers (query, id, score, rank) of those that stand for others, for every query."""
    return stands.select(F.col("id").alias("asking"), "query").join(found, "query").select(F.col("asking").alias("query"), "id", "score", "rank")


def least_copies(items: DataFrame, k: int) -> DataFrame:
    """Of each text the k rows of the least ids; Spark limits them before they are shuffled, so a common text is no large group."""
    copies = Window.partitionBy("text").orderBy("id")
    return texts_of(items).withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k).drop("copy")


def block_topk(queries: DataFrame, items: DataFrame, k: int, least: float, query_block: int = QUERIES, item_block: int | None = None) -> DataFrame:
    """The best k of each query in every block of items (both: id, text), and what it took: FOUND.

    pairs, bounded and verified stand on the first row of a query in a block; a query without a hit there has one
    row with a null id.
    """
    sides = [texts_of(df) for df in (queries, items)]

    def search(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(q) and len(x):
            ids, number = x["id"].to_numpy(), int(x["x_block"].iloc[0])
            answers = BlockSearch(x["text"].tolist(), k, least).search([np.unique(trigram_codes(t)) for t in q["text"]], ids)
            for name, (found, *work) in zip(q["id"], answers, strict=True):
                for j, (score, i) in enumerate(found or [(None, None)]):
                    out.append((name, None if i is None else ids[i], score, number, *(work if j == 0 else (0, 0, 0))))
        return pd.DataFrame(out, columns=["query", "id", "score", "block", "pairs", "bounded", "verified"]).astype({"id": "Int64", "score": "Float64"})

    q, x = dealt(*sides, *blocks_of(*sides, query_block, item_block))
    return q.cogroup(x).applyInPandas(search, FOUND)


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """The best k of each query, with rank from 0; ties by id."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def scanned_topk(asked: list[tuple[int, str]], items: DataFrame, k: int, least: float) -> DataFrame:
    """query, id, score: the best k of each task for these few queries, which are sent to all items (id, text).

    What an item shares with a query is counted first; only items that could be among the best so far are searched.
    """
    grams = [np.unique(trigram_codes(t)) for _, t in asked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.unique(np.concatenate([np.zeros(0, np.int64), *grams]))
        held_by = [np.isin(every, g, assume_unique=True) for g in grams]
        tops: list[list[tuple[float, int]]] = [[] for _ in grams]  # (score, id from below), falling
        ids, texts = [], []

        def searched() -> None:
            floors = [top[-1][0] if len(top) == k else 0.0 for top in tops]
            found = BlockSearch(texts, k, least).search(grams, np.array(ids, np.int64), floors)
            for j, (best, *_) in enumerate(found):
                tops[j] = sorted([*tops[j], *((score, -ids[i]) for score, i in best)], reverse=True)[:k]
            ids.clear()
            texts.clear()

        size = 0
        for batch in batches:
            for some in pieces_of(batch, CHARACTERS):
                here = some.column(1).to_pylist()
                live = np.zeros(len(here), bool)
                item, gram = shared_pairs(here, every)
                for query, holds, top in zip(grams, held_by, tops, strict=True):
                    if len(query):
                        share = np.bincount(item[holds[gram]], minlength=len(here)) / len(query)
                        live |= (share > least) & (share >= (top[-1][0] if len(top) == k else 0.0))
                for i in np.flatnonzero(live):
                    ids.append(some.column(0)[int(i)].as_py())
                    texts.append(here[i])
                    size += len(here[i])
                    if size >= CHARACTERS:
                        searched()
                        size = 0
        searched()
        rows = [(name, -i, score) for (name, _), top in zip(asked, tops, strict=True) for score, i in top]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query", "id", "score"])

    return spread(texts_of(items)).mapInArrow(run, "query long, id long, score double")


def spread(items: DataFrame) -> DataFrame:
    """items dealt once to as many tasks as keep every core busy; what is read may lie in one file."""
    session = items.sparkSession
    return items.repartition(max(4 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions"))))


def pieces_of(batch: pa.RecordBatch, characters: int) -> Iterator[pa.RecordBatch]:
    """A batch (id, text) in pieces of about so many characters, a row at least."""
    lot = np.cumsum(pc.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False)) // characters
    cuts = [0, *(np.flatnonzero(np.diff(lot)) + 1).tolist(), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)


def shared_pairs(texts: list[str], grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which texts hold which of these trigrams (sorted), each pair once, as two lists of places."""
    codes, many = codes_of(texts)
    if not len(grams):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sieve = np.zeros(1 << 16, bool)
    sieve[slot_of(grams)] = True
    near = np.flatnonzero(sieve[slot_of(codes)])
    at = np.minimum(np.searchsorted(grams, codes[near]), len(grams) - 1)
    same = grams[at] == codes[near]
    pairs = np.unique(np.repeat(np.arange(len(texts)), many)[near[same]] * len(grams) + at[same])
    return pairs // len(grams), pairs % len(grams)


def slot_of(codes: np.ndarray) -> np.ndarray:
    """A number of 16 bits for each code."""
    return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)


def lexical_topk(queries: DataFrame, items: DataFrame, k: int = 20, least: float = 0.1) -> DataFrame:
    """query, id, score, rank by word similarity over `least`, for a stated set of queries and all items (id, text).

    Texts without a word find nothing and are not found. Items are meant to be chunks or shorter: the time for one
    that is not ruled out grows with the square of its length (its memory does not). Each pair of blocks sends on k rows a query at most, so
    what meets in the last window is k rows a block.
    """
    once, stands = asked_once(queries)
    rows, chars = extent(once)
    if rows <= FEW and chars <= BRIEF:
        found = scanned_topk([(r.id, r.text) for r in once.collect()], items, k, least)
    else:
        found = block_topk(once, items, k, least).where("id IS NOT NULL").select("query", "id", "score")
    return answered(ranked(found, k), stands)


def jaccard_topk(queries: DataFrame, items: DataFrame, k: int, query_block: int = QUERIES, item_block: int | None = None) -> DataFrame:
    """query, id, score, rank by the Jaccard similarity of the whole texts' trigram sets, of pairs that share one.

    The same blocks: what two texts share comes from the inverted table of a block's items, and each pair of
    blocks sends on k rows a query, so pairs are never rows of a shuffle. Of equal texts only the k least ids can be
    among the best, so no more of them become items.
    """
    once, stands = asked_once(queries)
    few = staged(least_copies(items, k), "jaccard-items")

    def search(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(q) and len(x):
            ids = x["id"].to_numpy()
            block = BlockSearch(x["text"].tolist(), k, 0.0)
            grams = [np.unique(trigram_codes(t)) for t in q["text"]]
            for name, query, shared in zip(q["id"], grams, block.shared(grams), strict=True):
                found = np.flatnonzero(shared)
                common = shared[found].astype(np.int64)
                score = common / (len(query) + block.distinct[found] - common)
                if len(found) > k:
                    near = score >= np.partition(score, len(score) - k)[len(score) - k]
                    found, score = found[near], score[near]
                best = np.lexsort((ids[found], -score))[:k]
                out += zip([name] * len(best), ids[found[best]], score[best], strict=True)
        return pd.DataFrame(out, columns=["query", "id", "score"])

    q, x = dealt(once, few, *blocks_of(once, few, query_block, item_block))
    return answered(ranked(q.cogroup(x).applyInPandas(search, "query long, id long, score double"), k), stands)


def search_work(found: DataFrame) -> DataFrame:
    """query, pairs, bounded, verified: what block_topk's rows took."""
    return found.groupBy("query").agg(*(F.sum(c).alias(c) for c in ("pairs", "bounded", "verified")))
