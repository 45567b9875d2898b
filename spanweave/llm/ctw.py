"""Kernels of context-tree weighting over bytes.

A byte is eight binary decisions; decision ``k`` is made at the node that its
first ``k`` bits name, and each node has a context tree of its own over the
preceding bytes. A tree's contexts of depth d weigh their own
Krichevsky-Trofimov estimate and the product of the contexts one byte longer
by one half each:

    Pw(s) = Pe(s) / 2 + prod over y of Pw(ys) / 2        (Pw = Pe at full depth)

With the counts of a whole corpus, the probability of a decision is

    p(s) = w(s) * KT(s) + (1 - w(s)) * p(ys),   w(s) = Pe(s) / 2 / Pw(s)

which mixes the estimates of all depths. A gram packs ``depth`` context bytes,
the nearest first, and the coded byte into one integer, so that the contexts
of every depth are prefixes of it.
"""

from __future__ import annotations

import numpy as np

NOTHING = np.zeros(0, np.int64)
HALF = np.log(0.5)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma(x) for x >= 0.5, by Stirling's series from x + 7 on."""
    shift = np.log(x) + np.log(x + 1) + np.log(x + 2) + np.log(x + 3) + np.log(x + 4) + np.log(x + 5) + np.log(x + 6)
    y = x + 7
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_pe(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    zeros, ones = zeros.astype(np.float64), ones.astype(np.float64)
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - np.log(np.pi)


def grams(text: np.ndarray, depth: int) -> np.ndarray:
    """The gram of every byte from position ``depth`` on."""
    n = len(text) - depth
    out = text[depth:].astype(np.int64)
    pairs = text[1:].astype(np.uint16) << 8 | text[:-1]  # a byte and the one before it
    back = 1
    while back < depth:
        out |= pairs[depth - back - 1 : depth - back - 1 + n].astype(np.int64) << (8 * (depth - back))
        back += 2
    if back == depth:
        out |= text[:n].astype(np.int64) << 8
    return out


def _merge(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of the values by key, keys sorted; also each row's place among them."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else NOTHING
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(np.concatenate([[True], ordered[1:] != ordered[:-1]])) - 1 if len(keys) else NOTHING
    return (ordered[first], place, *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values))


class Level:
    """All nodes of decision ``k`` at one depth: keys (context << k | first k bits), counts, log Pe, log Pw."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        self.keys, self.zeros, self.ones = keys, zeros, ones
        own = log_pe(zeros, ones)
        self.log_pw = own if below is None else np.logaddexp(own, below) + HALF
        self.weight = np.ones(len(keys)) if below is None else np.exp(own + HALF - self.log_pw)
        self.p_one = (ones + 0.5) / (zeros + ones + 1.0)


def bottom_up(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None, k: int, deep: int, top: int) -> tuple[list[Level], list[np.ndarray]]:
    """Levels from depth ``deep`` up to ``top``, and the place of each node in the level above it."""
    levels, places = [Level(keys, zeros, ones, below)], []
    for _ in range(deep, top, -1):
        level = levels[-1]
        above = level.keys >> (8 + k) << k | level.keys & ((1 << k) - 1)
        keys, place, zeros, ones, below = _merge(above, level.zeros, level.ones, level.log_pw)
        levels.append(Level(keys, zeros, ones, below))
        places.append(place)
    return levels, places


def top_down(levels: list[Level], places: list[np.ndarray], shallow: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Probability of a one at the nodes of the deepest level.

    ``shallow`` and ``left`` belong to the nodes of the topmost level here: the
    part of the mixture that contexts above it decided, and the weight that is
    left from it on.
    """
    for level, place in zip(reversed(levels[1:]), reversed(places), strict=True):
        shallow = (shallow + left * level.weight * level.p_one)[place]
        left = (left * (1 - level.weight))[place]
    return shallow + left * levels[0].p_one


def leaf_nodes(found: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of decision ``k`` at full depth from sorted grams: keys, zeros, ones, and each gram's place."""
    keys, place = _runs(found >> (8 - k))
    bit = (found >> (7 - k)) & 1
    ones = np.bincount(place, counts * bit, len(keys)).astype(np.int64)
    return keys, np.bincount(place, counts, len(keys)).astype(np.int64) - ones, ones, place


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, bool)
    return ordered[new], np.cumsum(new) - 1
