"""Suffix arrays by a difference cover, one bucket of suffixes at a time, with numpy.

The text is a matrix: rows of equal width, a multiple of the period.  Order among
suffixes is that of their bytes up to the row's end (a shorter one first).  The suffixes
whose place modulo the period lies in a difference cover are the sample; they are ranked
first.  The wanted suffixes are then taken a bucket at a time, a bucket being those with
the same first bytes, and sorted by as many bytes as the period has.  Ties are settled
by ranks alone: for two suffixes there is a shift, less than the period, that brings both
to sample places.  So memory is bounded by the ranks and one bucket, however long the
texts agree.
"""

from __future__ import annotations

import numpy as np

PERIOD = 16
#: Every difference modulo 16 occurs between two of these.
COVER = (0, 1, 2, 5, 8)
#: Suffixes of one bucket are split further above this number, where their bytes allow it.
BUCKET = 1 << 20


def shifts(period: int = PERIOD, cover: tuple[int, ...] = COVER) -> np.ndarray:
    """shifts[r, s]: the least shift that brings residues r and s into the cover."""
    inside = np.isin(np.arange(period), cover)
    k = np.arange(period)
    both = inside[(k[:, None, None] + k) % period] & inside[(k[None, :, None] + k) % period]
    assert both.any(2).all()
    return both.argmax(2)


class Text:
    def __init__(self, rows: np.ndarray):
        n, width = rows.shape
        assert width % PERIOD == 0
        self.n, self.width, self.cover = n, width, np.array(COVER)
        padded = np.zeros((n, width + 2 * PERIOD), np.uint8)
        padded[:, :width] = rows
        self.flat = padded.reshape(-1)
        self.stride = width + 2 * PERIOD
        self.shift = shifts()
        self.rank_sample()

    def words(self, places: np.ndarray, at: int) -> np.ndarray:
        """Eight bytes from each place plus `at` on, as numbers in the bytes' order; zeros after a row's end."""
        column = places % self.stride + at
        base = places - places % self.stride + np.minimum(column, self.width)
        view = np.lib.stride_tricks.sliding_window_view(self.flat, 8)
        return np.ascontiguousarray(view[base]).view(">u8").reshape(-1).astype(np.uint64)

    def rank_sample(self) -> None:
        """Ranks of the sample suffixes: sort by words, and only what is still tied by the next."""
        columns = np.flatnonzero(np.isin(np.arange(self.width + PERIOD) % PERIOD, COVER))
        self.column_slot = np.full(self.width + 2 * PERIOD, -1)
        self.column_slot[columns] = np.arange(len(columns))
        self.slots = len(columns)
        real = columns[columns < self.width]
        places = (np.arange(self.n)[:, None] * self.stride + real[None, :]).reshape(-1)
        order = np.arange(len(places))
        group = np.zeros(len(places), np.int64)  # by sorted position: first position of its ties
        tied = np.arange(len(places))  # sorted positions
        at = 0
        while len(tied) and at < self.width:
            key = self.words(places[order[tied]], at)
            again = np.lexsort((key, group[tied]))
            order[tied] = order[tied][again]
            key, old = key[again], group[tied]
            new = np.ones(len(tied), bool)
            new[1:] = (key[1:] != key[:-1]) | (old[1:] != old[:-1])
            firsts = np.flatnonzero(new)
            group[tied] = tied[firsts[np.cumsum(new) - 1]]
            sizes = np.diff(np.append(firsts, len(tied)))
            tied = tied[np.repeat(sizes > 1, sizes)]
            at += 8
        rank = np.empty(len(places), np.int64)
        rank[order] = group + 1  # equal suffixes share a rank; 0 is the empty one
        self.ranks = np.zeros((self.n, self.slots), np.int64)
        self.ranks[:, : len(real)] = rank.reshape(self.n, len(real))

    def rank_at(self, places: np.ndarray) -> np.ndarray:
        row, column = np.divmod(places, self.stride)
        return self.ranks[row, self.column_slot[column]]

    def order(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """The suffix array of the suffixes at (rows, columns): their indices in order; equal ones in that of the rows."""
        places = rows.astype(np.int64) * self.stride + columns
        head = self.words(places, 0)
        first = np.argsort(head, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], head[first][1:] != head[first][:-1]]))
        out = []
        begin = 0
        ends = np.append(cuts[1:], len(first))
        while begin < len(first):  # buckets, together up to BUCKET suffixes
            to = int(ends[max(np.searchsorted(ends, begin + BUCKET, "right") - 1, np.searchsorted(ends, begin, "right"))])
            part = first[begin:to]
            out.append(part[self.sort_bucket(places[part], head[part])])
            begin = to
        return np.concatenate(out) if out else first

    def sort_bucket(self, places: np.ndarray, head: np.ndarray) -> np.ndarray:
        """The order of a bucket: by `PERIOD` bytes, then by ranks of the sample."""
        second = self.words(places, 8)
        order = np.lexsort((second, head))
        new = np.ones(len(order), bool)
        new[1:] = (head[order][1:] != head[order][:-1]) | (second[order][1:] != second[order][:-1])
        group = np.cumsum(new) - 1
        sizes = np.bincount(group)
        tied = np.flatnonzero(sizes[group] > 1)  # sorted positions
        if not len(tied):
            return order
        index, own = order[tied], group[tied]
        spots = places[index]
        residue = spots % self.stride % PERIOD
        kinds = np.unique(residue)
        by_kind = [np.flatnonzero(residue == r) for r in kinds]
        before = np.zeros(len(tied), np.int64)  # of the ties, how many are less
        limit = np.int64(self.ranks.size + 2)
        for a, r in enumerate(kinds):
            for b, s in enumerate(kinds):
                if b < a:
                    continue
                shift = self.shift[r, s]
                x, y = by_kind[a], by_kind[b]
                kx = own[x] * limit + self.rank_at(spots[x] + shift)
                ky = kx if a == b else own[y] * limit + self.rank_at(spots[y] + shift)
                low = own * limit
                sx, sy = np.sort(kx), np.sort(ky)
                before[x] += np.searchsorted(sy, kx) - np.searchsorted(sy, low[x])
                if a != b:
                    before[y] += np.searchsorted(sx, ky) - np.searchsorted(sx, low[y])
        again = np.lexsort((spots, before, own))
        order[tied] = index[again]
        return order

    def same(self, left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
        """Whether `length` bytes from (row, column) places on agree (within the rows)."""
        out = np.ones(len(left), bool)
        for at in range(0, length, 8):
            at = min(at, length - 8)
            go = np.flatnonzero(out)
            out[go] = self.words(left[go], at) == self.words(right[go], at)
        return out
