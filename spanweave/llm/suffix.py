"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Suffixes are classified (S: smaller than the next one, L: larger); the
leftmost S suffixes of each run (LMS) are sorted; all others follow from them
by two linear passes over the array. A pass runs bucket by bucket: all entries
of a bucket that are known give their left neighbours at once, and those that
fall in the same bucket are the next batch, so the number of numpy calls
follows the alphabet and the longest run of one symbol, not the length.

LMS substrings are sorted by the same passes and named. While names repeat,
the string of names is ordered recursively by pairs, each round naming twice
as many of them, and only names that still repeat take part.
"""

from __future__ import annotations

import numpy as np

WIDTH = 7

def _types(t: np.ndarray) -> np.ndarray:
    """True at S suffixes; the last symbol must be the only least one."""
    n = len(t)
    out = np.ones(n, bool)
    if n > 1:
        less, equal = t[:-1] < t[1:], t[:-1] == t[1:]
        # An equal neighbour has the type of the next position where they differ.
        at = np.where(equal, n, np.arange(n - 1))
        at = np.minimum.accumulate(at[::-1])[::-1]
        out[:-1] = np.where(at < n - 1, less[np.minimum(at, n - 2)], True)
    return out


class _Inducer:
    def __init__(self, t: np.ndarray, small: np.ndarray):
        self.t, self.small = t, small
        counts = np.bincount(t)
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        self.symbols = np.flatnonzero(counts).tolist()

    def _deal(self, found: np.ndarray, heads: np.ndarray, sa: np.ndarray, back: bool) -> None:
        """Appends positions, in order, to their buckets' heads (or before their tails)."""
        symbols = self.t[found]
        order = np.argsort(symbols, kind="stable")
        found, symbols = found[order], symbols[order]
        first = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
        kinds, sizes = symbols[first], np.diff(np.append(first, len(found)))
        rank = np.arange(len(found)) - np.repeat(first, sizes)
        if back:
            sa[np.repeat(heads[kinds], sizes) - 1 - rank] = found
            heads[kinds] -= sizes
        else:
            sa[np.repeat(heads[kinds], sizes) + rank] = found
            heads[kinds] += sizes

    def run(self, lms: np.ndarray) -> np.ndarray:
        """The array of all suffixes from LMS suffixes in the order given (within each symbol)."""
        t, small, n = self.t, self.small, len(self.t)
        sa = np.full(n, -1, np.int32 if n < 1 << 31 else np.int64)
        seeds = np.bincount(t[lms], minlength=len(self.ends))
        tails = self.ends.copy()
        self._deal(lms[::-1], tails, sa, True)
        heads = self.starts.copy()
        for c in self.symbols:
            at = int(self.starts[c])
            while at < heads[c]:
                to = int(heads[c])
                self._push(sa[at:to], heads, sa, False)
                at = to
            if seeds[c]:
                self._push(sa[self.ends[c] - seeds[c] : self.ends[c]], heads, sa, False)
        tails = self.ends.copy()
        # The last suffix is S and follows from none.
        sa[0] = n - 1
        tails[t[n - 1]] -= 1
        for c in reversed(self.symbols):
            at = int(self.ends[c])
            while at > tails[c]:
                to = int(tails[c])
                self._push(sa[to:at][::-1], tails, sa, True)
                at = to
            if heads[c] > self.starts[c]:
                self._push(sa[self.starts[c] : heads[c]][::-1], tails, sa, True)
        return sa

    def _push(self, known: np.ndarray, heads: np.ndarray, sa: np.ndarray, back: bool) -> None:
        found = known - 1
        found = found[found >= 0]
        found = found[self.small[found] == back]
        if len(found):
            self._deal(found, heads, sa, back)


def _names(t: np.ndarray, lms: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ranks of sorted LMS substrings (positions and lengths): equal substrings have equal ranks."""
    same = lengths[1:] == lengths[:-1]
    pairs = np.flatnonzero(same)
    k = 0
    while len(pairs):
        still = t[lms[pairs] + k] == t[lms[pairs + 1] + k]
        same[pairs[~still]] = False
        k += 1
        pairs = pairs[still & (lengths[pairs] > k)]
    return np.concatenate([[0], np.cumsum(~same)])


def _order(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names, by naming pairs of names again and again."""
    n = len(names)
    kind = np.int32 if n < 1 << 31 else np.int64
    rank = names.astype(kind)
    order = np.argsort(rank, kind="stable").astype(kind)
    span = 1
    # Ranks leave room: a group of equal rank r holds places r .. r + size - 1.
    ordered = rank[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n, dtype=kind), 0))
    open_ = np.flatnonzero(~(first & np.append(first[1:], True)))
    while len(open_):
        at = order[open_]
        after = at + span
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        group = rank[at]
        by = np.lexsort((second, group))
        at, group, second = at[by], group[by], second[by]
        order[open_] = at
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        start = np.maximum.accumulate(np.where(new, open_, 0))
        rank[at] = start
        open_ = open_[~(new & np.append(new[1:], True))]
        span *= 2
    return order


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffixes of ``t`` (small non-negative integers) in order; t's last symbol must be its only least one."""
    n = len(t)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    small = _types(t)
    leftmost = small.copy()
    leftmost[0] = False
    leftmost[1:] &= ~small[:-1]
    lms = np.flatnonzero(leftmost)
    if not len(lms):
        return _Inducer(t, small).run(np.array([n - 1]))
    inducer = _Inducer(t, small)
    rough = inducer.run(lms)
    sorted_lms = rough[leftmost[rough]].astype(np.int64)
    lengths = np.zeros(n, np.int64)
    lengths[lms] = np.append(np.diff(lms) + 1, 1)
    names = np.empty(n, np.int64)
    names[sorted_lms] = _names(t, sorted_lms, lengths[sorted_lms])
    string = names[lms]
    if string.max() + 1 < len(lms):
        sorted_lms = lms[_order(string)]
    return inducer.run(sorted_lms)


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """By position: common prefix of its suffix and the one before it in the array.

    It is at least that of the position before, less one; where it is not more,
    it need not be compared. The others are, seven symbols (of 9 bits) at a time.
    """
    n = len(t)
    kind = np.int32 if n < 1 << 31 else np.int64
    before = np.empty(n, kind)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    has = before >= 0
    fresh = np.ones(n, bool)
    fresh[1:] = (before[1:] <= 0) | (t[:-1] != t[np.maximum(before[1:], 1) - 1])
    fresh &= has
    at = np.flatnonzero(fresh)
    length = np.zeros(n, kind)
    wide = np.zeros(n + WIDTH, np.uint64)
    for k in range(min(n, WIDTH)):
        wide[: n - k] |= t[k:].astype(np.uint64) << np.uint64(9 * k)
    one, two, k = at, before[at].astype(np.int64), 0
    del before
    active = np.arange(len(at))
    result = np.zeros(len(at), np.int64)
    while len(active):
        p, q = one[active] + k, two[active] + k
        inside = np.maximum(p, q) + WIDTH <= n
        equal = inside & (wide[np.minimum(p, n)] == wide[np.minimum(q, n)])
        ended = active[~equal]
        if len(ended):
            more = np.zeros(len(ended), np.int64)
            open_ = np.ones(len(ended), bool)
            for j in range(WIDTH):
                p, q = one[ended] + k + j, two[ended] + k + j
                open_ &= (np.maximum(p, q) < n) & (t[np.minimum(p, n - 1)] == t[np.minimum(q, n - 1)])
                more += open_
            result[ended] = k + more
        active = active[equal]
        k += WIDTH
    length[at] = result
    # The others carry on from the last compared position.
    del wide
    place = np.arange(n, dtype=kind)
    source = np.maximum.accumulate(np.where(fresh, place, kind(-1)))
    carried = length[np.maximum(source, 0)] - (place - source)
    return np.where(has & (source >= 0), np.maximum(carried, 0), 0)


def repeated(t: np.ndarray, least: int) -> np.ndarray:
    """True at positions whose next ``least`` symbols also start elsewhere in ``t``."""
    sa = suffix_array(t)
    common = permuted_common_prefixes(t, sa)
    long_ = common >= least
    out = long_.copy()
    out[sa[:-1]] |= long_[sa[1:]]
    return out
