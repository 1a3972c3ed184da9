"""Inverted index with block maxima: exact search that scores only blocks whose bound is high enough.

Postings of each term are ordered by entry number and cut into blocks of ``block`` consecutive entries;
of each block only the largest weight is looked at first. A search above a threshold follows block-max WAND:
terms are taken in the order of their largest weight, and those before the pivot, which together stay below the
threshold, can't carry an entry alone. So only blocks of the other terms are candidates; the lists before
the pivot are looked up at the candidates only, and skipped elsewhere. Then the sum of a block's maxima
bounds every score in it, and blocks below the threshold are never scored.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np

#: A list with more than one in so many of the entries is wide.
WIDE = 16
#: Postings in a row of lists that are neither wide nor shorter than a row.
ROW = 8


def ranges_of(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the half-open ranges, in order."""
    sizes = ends - starts
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(total)


class BlockMaxIndex:
    """``terms``, ``entries``, ``weights``: a posting for each position; weights are at least 0.

    Whole numbers take 32 bits where they can and weights keep their own precision, since each worker holds an index.
    """

    def __init__(self, terms: np.ndarray, entries: np.ndarray, weights: np.ndarray, n_terms: int, n_entries: int, block: int = 64):
        order = np.lexsort((entries, terms))
        t, self.entry = terms[order], entries[order].astype(np.int32, copy=False)
        self.weight = weights[order].astype(np.float32 if weights.dtype == np.float32 else np.float64, copy=False)
        del order, terms, entries, weights  # freed here where the caller doesn't keep them
        self.n_terms, self.n_entries, self.block = n_terms, n_entries, block
        self.blocks = -(-n_entries // block) if n_entries else 0
        part_block = self.entry // block
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (part_block[1:] != part_block[:-1])
        first = np.flatnonzero(new).astype(np.int32 if len(t) < 1 << 31 else np.int64)
        self.part_start = np.append(first, first.dtype.type(len(t)))
        self.part_block = part_block[first]
        self.part_max = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.term_start = np.searchsorted(t[first], np.arange(n_terms + 1))
        self.term_max = np.zeros(n_terms)
        if len(own := np.flatnonzero(np.diff(self.term_start))):
            self.term_max[own] = np.maximum.reduceat(self.part_max, self.term_start[own])

    def __getstate__(self):
        """Without what is made from the rest when it is asked for."""
        return {k: v for k, v in self.__dict__.items() if k not in ("part_key", "_wide", "_rows", "_short")}

    @cached_property
    def part_key(self) -> np.ndarray:
        """Term and block of each part as one number, ascending."""
        return np.repeat(np.arange(self.n_terms) * max(self.blocks, 1), np.diff(self.term_start)) + self.part_block

    def terms_of(self, entry: int) -> np.ndarray:
        """Terms of one entry, ascending."""
        part = np.searchsorted(self.part_start, np.flatnonzero(self.entry == entry), side="right") - 1
        return np.searchsorted(self.term_start, part, side="right") - 1

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.entry, self.weight, self.part_start, self.part_block, self.part_max, self.term_start, self.term_max))

    def _parts(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.term_start[terms], self.term_start[terms + 1]
        parts, scale = ranges_of(a, b), np.repeat(weights, b - a)
        return parts, scale, np.bincount(self.part_block[parts], self.part_max[parts] * scale, self.blocks)

    def _scores(self, parts: np.ndarray, scale: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Scores of all entries; those of blocks that aren't ``wanted`` stay 0."""
        own = wanted[self.part_block[parts]]
        parts, scale = parts[own], scale[own]
        a, b = self.part_start[parts], self.part_start[parts + 1]
        at = ranges_of(a, b)
        return np.bincount(self.entry[at], self.weight[at] * np.repeat(scale, b - a), self.n_entries)

    @cached_property
    def _short(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists that are neither wide nor in rows: bounds of each term's postings, entries, weights."""
        starts = self.part_start[self.term_start].astype(np.int64)
        size = np.where((self._wide[0] < 0) & (np.diff(self._rows[0]) == 0), np.diff(starts), 0)
        at = ranges_of(starts[:-1], starts[:-1] + size)
        return np.concatenate(([0], np.cumsum(size))).astype(np.int32), self.entry[at], self.weight[at]

    def only_top(self) -> None:
        """Keep what :meth:`top_many` reads: its wide lists, rows and short lists hold all postings. Nothing else can be asked for after."""
        if self.blocks and "_short" not in self.__dict__:
            self._short  # noqa: B018  made from what goes
            del self.entry, self.weight, self.part_start, self.part_block, self.part_max, self.term_start

    def _added(self, terms: np.ndarray, shifts: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
        """Sums of the short lists' weighted postings, each list's entries moved by its shift."""
        first, entries, held = self._short
        a, b = first[terms], first[terms + 1]
        posts = ranges_of(a, b)
        sums = np.bincount(entries[posts] + np.repeat(shifts, b - a), held[posts] * np.repeat(weights, b - a), size)
        return sums.astype(np.float64, copy=False)  # no postings give whole numbers

    def above(self, terms: np.ndarray, weights: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """All entries that score at least ``threshold`` (over 0), ascending."""
        if not self.blocks or not len(terms) or (self.term_max[terms] * weights).sum() < threshold:
            return []
        most = self.term_max[terms] * weights
        order = np.argsort(most, kind="stable")
        pivot = int(np.searchsorted(np.cumsum(most[order]), threshold))  # terms before it stay below the threshold
        carried, early = terms[order[pivot:]], terms[order[:pivot]]
        parts, scale, bounds = self._parts(carried, weights[order[pivot:]])
        blocks = np.flatnonzero(bounds)
        if len(early) and len(blocks):
            keys = early[:, None] * max(self.blocks, 1) + blocks[None, :]
            at = np.minimum(np.searchsorted(self.part_key, keys), len(self.part_key) - 1)
            met = self.part_key[at] == keys
            more, w = at[met], np.broadcast_to(weights[order[:pivot]][:, None], keys.shape)[met]
            np.add.at(bounds, self.part_block[more], self.part_max[more] * w)
            parts, scale = np.concatenate((parts, more)), np.concatenate((scale, w))
        wanted = bounds >= threshold
        if not wanted.any():
            return []
        scores = self._scores(parts, scale, wanted)
        return [(int(i), float(scores[i])) for i in np.flatnonzero(scores >= threshold)]

    @cached_property
    def _wide(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists with over one in WIDE of the entries, kept as rows of each block: their place by term (else -1), weights and block maxima.

        The rows take at most WIDE times the memory of their postings.
        """
        starts = self.part_start[self.term_start]
        wide = np.flatnonzero(np.diff(starts) > self.n_entries / WIDE)
        place = np.full(self.n_terms, -1)
        place[wide] = np.arange(len(wide))
        rows = np.zeros((self.blocks, len(wide), self.block), np.float32)
        for i, t in enumerate(wide.tolist()):
            e = self.entry[starts[t] : starts[t + 1]]
            rows[e // self.block, i, e % self.block] = self.weight[starts[t] : starts[t + 1]]
        return place, rows, np.ascontiguousarray(rows.max(axis=2).T)

    @cached_property
    def _rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists of ROW postings or more that aren't wide, cut into rows, the last filled up with weights of 0: bounds of each term's rows, entries, weights.

        A gather then takes ROW postings at once. The rows take at most twice the memory of their postings.
        """
        starts = self.part_start[self.term_start].astype(np.int64)
        size = np.diff(starts)
        own = np.flatnonzero((size >= ROW) & (self._wide[0] < 0))
        many = np.zeros(self.n_terms + 1, np.int32)
        many[own + 1] = -(-size[own] // ROW)
        first = np.cumsum(many, dtype=np.int32)
        entries = np.zeros((int(first[-1]), ROW), np.min_scalar_type(self.n_entries))
        weights = np.zeros(entries.shape, self.weight.dtype)
        for some in np.array_split(own, 16):  # in parts, since places take more than what is placed
            to, at = ranges_of(first[some].astype(np.int64) * ROW, first[some].astype(np.int64) * ROW + size[some]), ranges_of(starts[some], starts[some + 1])
            entries.reshape(-1)[to], weights.reshape(-1)[to] = self.entry[at], self.weight[at]
        return first, entries, weights

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`top_many` of one query."""
        return self.top_many(np.zeros(len(terms), np.int64), terms, weights, 1, k)[0]

    def top_many(self, queries: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, k: int, seeds: int = 4) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of ``n`` queries the ``k`` best entries that score over 0, and their scores; ties (to six places) go to the smaller entry.

        ``queries`` numbers the query of each (term, weight), ascending; a query has a term once. Narrow lists are added up whole, by rows and a query
        at a time, which keeps all temporary arrays small; they and the block maxima of wide ones bound each block's scores for each query.
        The ``seeds`` best blocks of a query give a least score, and of wide lists it reads only blocks whose bound reaches it. A block's rows are
        multiplied with all queries that read it at once. Memory grows with ``n`` times the entries, which the caller keeps small.
        """
        if not self.blocks or not len(terms):
            return [(np.zeros(0, np.int64), np.zeros(0))] * n
        place, rows, maxima = self._wide
        at, size = place[terms], self.blocks * self.block
        narrow, wide = at < 0, at >= 0
        t, q, w = terms[narrow], queries[narrow], weights[narrow]
        first, row_entries, row_weights = self._rows
        a, b = first[t], first[t + 1]
        short = a == b
        scores = self._added(t[short], q[short] * size, w[short], n * size).reshape(n, size)
        ends = np.searchsorted(q, np.arange(n + 1)).tolist()
        for i, j, own in zip(ends[:-1], ends[1:], scores):
            at_rows = ranges_of(a[i:j], b[i:j])
            scale = np.repeat(w[i:j], b[i:j] - a[i:j])
            own += np.bincount(row_entries.take(at_rows, axis=0).ravel(), (row_weights.take(at_rows, axis=0) * scale[:, None]).ravel(), size)
        scores = scores.reshape(n, self.blocks, self.block)
        asked = np.zeros((n, len(maxima)), np.float32)
        asked[queries[wide], at[wide]] = weights[wide]
        bounds = scores.max(axis=2) + (asked @ maxima) * (1 + 1e-5)
        seeds = min(max(seeds, -(-k // self.block)), self.blocks)
        first = np.argpartition(-bounds, seeds - 1, axis=1)[:, :seeds]
        read = np.zeros(bounds.shape, bool)
        np.put_along_axis(read, first, True, axis=1)

        def add(wanted: np.ndarray) -> None:
            for block in np.flatnonzero(wanted.any(axis=0)).tolist():
                own = np.flatnonzero(wanted[:, block])
                scores[own, block] += asked[own] @ rows[block]

        add(read)
        found = np.take_along_axis(scores, first[:, :, None], axis=1).reshape(n, -1)
        least = np.partition(found, -k, axis=1)[:, -k] if found.shape[1] >= k else np.zeros(n)
        more = (bounds >= least[:, None]) & ~read
        add(more)
        scores[~(read | more)] = 0  # not read whole; none of them is among the best
        scores = scores.reshape(n, size)
        cut = np.partition(scores, -k, axis=1)[:, -k] - 1e-6 if size > k else np.zeros(n)
        owner, entry = np.nonzero(scores >= np.maximum(cut, np.finfo(float).tiny)[:, None])
        value = scores[owner, entry]
        order = np.lexsort((entry, -np.round(value, 6), owner))
        ends = np.searchsorted(owner, np.arange(n + 1)).tolist()
        entry, value = entry[order], value[order]
        return [(entry[i : min(j, i + k)], value[i : min(j, i + k)]) for i, j in zip(ends[:-1], ends[1:])]
