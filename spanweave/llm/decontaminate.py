"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed slots, so that a question asked with
other values has the template of the original. Windows of ``width`` canonical
tokens of the benchmark are hashed and joined with those of every document by
hash. Matched windows of a document and an item count along a chain of diagonals
(of equal distance of places) that differ by ``SLACK`` tokens from one to the
next, in the order of both texts, and only while their slots agree: one value of
the item stands for one value of the document, and the other way round. Where
words are inserted or deleted, the rest counts from ``EDGE`` tokens on. A document is
contaminated if agreeing windows cover ``least`` tokens of an item, or all of a
shorter one.

The benchmark is joined in blocks of ``block`` items: a block's windows are
sent to all tasks (some MB, whatever the size of either table), and documents
pass through one join after the other.

A number starts with a digit (with its decimals and an attached unit); a unit
is one of UNITS after a number; a name is a capitalised ASCII word. Texts are
read in three ways, and the best match of any counts: as plain words without
slots (line breaks and case don't matter), with names only where a word follows
another word, and with names everywhere but for OPENERS, a run of them being one
slot, as what opens a sentence shows no difference otherwise. Windows with fewer than half their tokens literal are
vague templates: they match only where the values of their slots are equal too.

Benchmarks of any size are taken in blocks of bounded items and bytes, each read
once through the driver and sent to all tasks.

Defined cases: null and empty texts match nothing, on either side; very long
texts are read whole, by one task each; of an item's matches in a text the one
of most coverage counts; null ids are kept (a null item_id is
reported as null); equal rows are judged alike; other columns are ignored; an
empty benchmark contaminates nothing.
"""

from __future__ import annotations

from bisect import bisect, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .kernels import BASE, LOWER, SPACE, flat, mix, powers, prefix_hash, slices, span_hash, spans
from .shared import raw, table

# Words for units.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers centimeter centimeters "
    "g kg mg gram grams kilogram kilograms ton tons tonne tonnes ounce ounces pound pounds lb lbs oz "
    "ml l liter liters litre litres gallon gallons cup cups pint pints quart quarts "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros usd eur percent degree degrees mph kmh watt watts volt volts joule joules"
).split()
# Words that open sentences and are no names.
OPENERS = (
    "a an the this that these those he she it they we you i his her its their our your there here if when while after before because as since "
    "then so and but or for of in on at by to from with what which who whose whom where why how all each every some both many most no not now "
    "is are was were do does did has have had can could will would should let find given suppose consider calculate compute add solve"
).split()
BLOCK_BYTES = 8 << 20
LITERAL, NUMBER, NAME, UNIT = 0, 1, 2, 3
WORDS, INNER, NAMES = 0, 1, 2
# Inserted or deleted tokens between two parts of a copy, and the shortest part beside a matched window.
SLACK, EDGE = 4, 2
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
WORD = DIGIT.copy()
WORD[65:91] = WORD[97:123] = WORD[128:] = True
POINT = np.zeros(256, bool)
POINT[[44, 46]] = True


def _hashes(words: list[str]) -> np.ndarray:
    data, offsets = flat(pa.array([w.encode() for w in words], pa.binary()))
    return np.sort(span_hash(prefix_hash(data), offsets[:-1], offsets[1:]))


UNIT_HASHES, OPENER_HASHES = _hashes(UNITS), _hashes(OPENERS)


class Tokens:
    """Tokens of several texts, read in one of three ways: place, text number, hash as written (lower case), slot type, canonical hash, words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, reading: int = INNER):
        self.data, self.offsets, self.reading = data, offsets, reading
        inside = WORD[data]
        if len(data) > 2:
            inside[1:-1] |= POINT[data[1:-1]] & DIGIT[data[:-2]] & DIGIT[data[2:]]
        self.starts, self.ends = spans(inside, offsets)
        self.owner = np.searchsorted(offsets, self.starts, side="right") - 1
        self.value = span_hash(prefix_hash(LOWER[data]), self.starts, self.ends)
        self.first = self.value
        self._slots()

    def read(self, reading: int) -> Tokens:
        """The same texts read in another way."""
        if reading == self.reading:
            return self
        return Tokens(self.data, self.offsets, reading)

    def _slots(self) -> None:
        data, n = self.data, len(self.starts)
        self.kind = np.zeros(n, np.uint8)
        self.words = np.ones(n, np.int64)
        if self.reading == WORDS:
            self.canonical = self.value
            return
        first = data[self.starts] if n else data[:0]
        second = data[np.minimum(self.starts + 1, len(data) - 1)] if n else first
        single = self.ends - self.starts == 1
        # A word that only white space parts from the word before it does not begin a sentence.
        follows = np.zeros(n, bool)
        if n > 1:
            blank = np.concatenate([[0], np.cumsum(~SPACE[data])])
            follows[1:] = (blank[self.starts[1:]] == blank[self.ends[:-1]]) & (self.owner[1:] == self.owner[:-1])
        named = follows if self.reading == INNER else ~np.isin(self.value, OPENER_HASHES)
        self.kind[(first >= 65) & (first <= 90) & (second >= 97) & (second <= 122) & ~single & named] = NAME
        number = DIGIT[first]
        self.kind[number] = NUMBER
        if n > 1:
            unit = np.isin(self.value, UNIT_HASHES)
            self.kind[1:][unit[1:] & number[:-1] & (self.owner[1:] == self.owner[:-1])] = UNIT
        if self.reading == NAMES and n > 1:
            name = self.kind == NAME
            heads = np.flatnonzero(~np.concatenate([[False], name[1:] & name[:-1] & follows[1:]]))
            self.words = np.diff(np.append(heads, n))
            within = np.arange(n) - np.repeat(heads, self.words)
            self.first = self.value[heads]
            self.value = np.add.reduceat(self.value * powers(BASE, int(within.max()) + 1)[within], heads)
            self.ends = self.ends[np.append(heads[1:], n) - 1]
            self.starts, self.owner, self.kind = self.starts[heads], self.owner[heads], self.kind[heads]
        self.canonical = np.where(self.kind == LITERAL, self.value, mix(self.kind.astype(np.uint64) + np.uint64(0x51ED27)))

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of windows, and their hashes: of templates, or of values where the template is vague."""
        n = len(self.starts) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        literal = np.concatenate([[0], np.cumsum(self.kind == LITERAL)])
        vague = 2 * (literal[width:] - literal[:n]) < width
        hashes = np.full(n, width, np.uint64)
        for k in range(width):
            hashes = (hashes + self.canonical[k : k + n]) * np.uint64(0x9FB21C651E98DF25)
        at = np.flatnonzero(vague)
        for k in range(width if len(at) else 0):
            hashes[at] = (hashes[at] + self.value[at + k]) * np.uint64(0x9FB21C651E98DF25)
        usable = self.owner[width - 1 :] == self.owner[:n]
        at = np.flatnonzero(usable)
        return at, mix(hashes[at])


class Side:
    """Windows of some benchmark items in one reading, by hash, with the items' tokens."""

    def __init__(self, ids: list, texts: list[bytes], width: int, reading: int):
        self.ids, self.width, self.reading = ids, width, reading
        tokens = Tokens(*flat(pa.array(texts, pa.binary())), reading)
        bounds = np.searchsorted(tokens.owner, np.arange(len(texts) + 1))
        self.items = [(tokens.value[a:b], tokens.kind[a:b], tokens.words[a:b], tokens.first[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        sizes = np.diff(bounds)
        self.tables = {}
        for w in sorted({width, *(int(s) for s in sizes if 0 < s < width)}):
            at, hashes = tokens.windows(w)
            item = tokens.owner[at]
            if w < width:  # only items that are one such window
                whole = sizes[item] == w
                at, hashes, item = at[whole], hashes[whole], item[whole]
            order = np.argsort(hashes, kind="stable")
            bits = np.zeros(1 << 20, bool)
            bits[(hashes >> np.uint64(44)).astype(np.int64)] = True
            self.tables[w] = (hashes[order], item[order], (at - bounds[item])[order], bits)

    def hits(self, tokens: Tokens) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, place in the text's tokens, place in the item's, width) of equal windows."""
        for w, (known, item, place, bits) in self.tables.items():
            at, hashes = tokens.windows(w)
            some = np.flatnonzero(bits[(hashes >> np.uint64(44)).astype(np.int64)])
            low, high = np.searchsorted(known, hashes[some], side="left"), np.searchsorted(known, hashes[some], side="right")
            for s, a, b in zip(some[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                for k in range(a, b):
                    yield int(tokens.owner[at[s]]), int(item[k]), int(at[s]), int(place[k]), w

    def judge(self, tokens: Tokens, least: int) -> dict[tuple, tuple]:
        """By text and item found: share of its words covered, whether no slot value differs, and the row of both."""
        pairs: dict[tuple, dict] = defaultdict(lambda: defaultdict(list))
        for text, item, i, j, w in self.hits(tokens):
            pairs[text, item][i - j].append((j, w))
        best: dict[tuple, tuple] = {}
        for (text, item), found in pairs.items():
            words = self.items[item][2]
            whole = int(words.sum())
            low, high = (int(x) for x in np.searchsorted(tokens.owner, [text, text + 1]))
            absorbed: set[int] = set()
            for shift in sorted(found, key=lambda s: (-len(found[s]), s)):
                if shift in absorbed:
                    continue
                chain = Chain(self.items[item], tokens, low, high)
                # Outwards from this diagonal, as far as the next one is near.
                for side in ([s for s in sorted(found) if shift <= s <= shift + len(words)], [s for s in sorted(found, reverse=True) if shift - len(words) <= s < shift]):
                    last = shift
                    for s in side:
                        if abs(s - last) > SLACK:
                            break
                        if chain.windows(s, sorted(found[s])):
                            absorbed.add(s)
                            last = s
                chain.edges()
                n = int(words[list(chain.at)].sum())
                if n >= min(least, whole):
                    share = n / whole
                    if (share, not chain.changed) > best.get((text, item), (0.0, False, ()))[:2]:
                        best[text, item] = (share, not chain.changed, (self.ids[item], share, chain.changed))
                        if share == 1 and not chain.changed:
                            break
        return best


class Chain:
    """Tokens of an item with their places in a text, in the order of both, and what stands for what."""

    def __init__(self, item: tuple, tokens: Tokens, low: int, high: int):
        self.value, self.kind, _, self.first = item
        self.tokens, self.low, self.high = tokens, low, high
        self.at: dict[int, int] = {}
        self.order: list[int] = []
        self.maps: dict = {}
        self.changed = False

    def _slot(self, j: int, i: int) -> list[tuple] | None:
        """What tokens j and i map to each other; none if they can't stand for each other."""
        t, v, d = int(self.kind[j]), int(self.value[j]), int(self.tokens.value[i])
        if t != self.tokens.kind[i] or (t == LITERAL and v != d):
            return None
        if t == LITERAL:
            return []
        # Two names may not become one, also not by their first words.
        told = [((0, t, v), d), ((1, t, d), v), ((2, t, int(self.tokens.first[i])), int(self.first[j]))]
        return None if any(self.maps.get(k, x) != x for k, x in told) else told

    def _fits(self, j: int, i: int) -> bool:
        if j in self.at:
            return False
        k = bisect(self.order, j)
        return (not k or self.at[self.order[k - 1]] < i) and (k == len(self.order) or i < self.at[self.order[k]])

    def _add(self, j: int, i: int, told: list[tuple]) -> None:
        self.at[j] = i
        insort(self.order, j)
        self.maps.update(told)
        self.changed |= bool(self.value[j] != self.tokens.value[i])

    def windows(self, shift: int, found: list[tuple]) -> bool:
        """Add windows of a diagonal that agree with what is there; whether any did."""
        any_added = False
        for j, w in found:
            new = [k for k in range(j, j + w) if self._fits(k, k + shift)]
            told: list[tuple] | None = []
            seen: dict = {}
            for k in new:
                slot = self._slot(k, k + shift)
                if slot is None or any(seen.setdefault(a, x) != x for a, x in slot):
                    told = None
                    break
                told += slot
            if told is None:
                continue
            for k in new:
                self._add(k, k + shift, [])
            self.maps.update(told)
            any_added |= bool(new)
        return any_added

    def _run(self, j: int, i: int, step: int) -> list[tuple]:
        out: list[tuple] = []
        seen: dict = {}
        same = 0
        while 0 <= j < len(self.value) and self.low <= i < self.high and self._fits(j, i):
            slot = self._slot(j, i)
            if slot is None or any(seen.setdefault(a, x) != x for a, x in slot):
                break
            same += self.value[j] == self.tokens.value[i]
            out.append((j, i, slot))
            j, i = j + step, i + step
        return out if len(out) >= EDGE and 2 * same >= len(out) else []

    def edges(self) -> None:
        """Go on beyond both ends of each matched part, over inserted or deleted tokens."""
        todo = [(j, step) for j in self.order for step in (-1, 1) if j + step not in self.at]
        while todo and len(self.at) < len(self.value):
            j, step = todo.pop()
            i = self.at[j]
            skips = [(a, b) for a in range(SLACK + 1) for b in range(SLACK + 1) if a != b]
            run = max((self._run(j + step * (1 + a), i + step * (1 + b), step) for a, b in sorted(skips, key=sum)), key=len)
            for a, b, told in run:
                self._add(a, b, told)
            if run:
                todo.append((run[-1][0], step))


class Block:
    """Some benchmark items in all readings."""

    def __init__(self, ids: list, texts: list[bytes], width: int):
        self.sides = [Side(ids, texts, width, r) for r in (WORDS, INNER, NAMES)]

    def judge(self, tokens: Tokens, least: int) -> dict[int, list[tuple]]:
        """By text: (item id, share of its words covered, whether slot values differ) of each item found."""
        best: dict[tuple, tuple] = {}
        for side in self.sides:
            for at, found in side.judge(tokens.read(side.reading), least).items():
                if found[:2] > best.get(at, (0.0, False))[:2]:
                    best[at] = found
        out: dict[int, list] = defaultdict(list)
        for (text, _), (_, _, row) in sorted(best.items(), key=lambda x: x[0]):
            out[text].append(row)
        return out


def _blocks(benchmark: DataFrame, width: int, size: int) -> Iterator[Block]:
    """The items in blocks of ``size`` items or BLOCK_BYTES at most (a longer item stands alone); at least one, maybe empty."""
    ids, texts, given, held = [], [], False, 0
    for row in benchmark.select("item_id", raw("text").alias("text")).orderBy("item_id", "text").toLocalIterator():
        if ids and (len(ids) == size or held + len(row.text) > BLOCK_BYTES):
            yield Block(ids, texts, width)
            ids, texts, given, held = [], [], True, 0
        ids.append(row.item_id)
        texts.append(bytes(row.text))
        held += len(row.text)
    if ids or not given:
        yield Block(ids, texts, width)


def matches(docs: DataFrame, benchmark: DataFrame, width: int = 8, least: int = 13, block: int = 20_000) -> DataFrame:
    """doc_id and the items found in it, for every document; each block adds to the list."""
    context = docs.sparkSession.sparkContext
    kind, item = (t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (benchmark, "item_id")))
    listed = pa.list_(pa.struct([("item_id", to_arrow_type(benchmark.schema["item_id"].dataType)), ("coverage", pa.float64()), ("reparameterised", pa.bool_())]))
    schema = f"doc_id {kind}, text binary, items array<struct<item_id:{item},coverage:double,reparameterised:boolean>>"
    found = None
    for part in _blocks(benchmark, width, block):
        shared = context.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=found is None) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in slices(batch):
                    rows = shared.value.judge(Tokens(*flat(piece.column("text"))), least)
                    before = [[]] * piece.num_rows if first else piece.column("items").to_pylist()
                    items = [b + [dict(zip(("item_id", "coverage", "reparameterised"), r, strict=True)) for r in rows.get(i, [])] for i, b in enumerate(before)]
                    yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("text"), pa.array(items, listed)], ["doc_id", "text", "items"])

        found = (docs.select("doc_id", raw("text").alias("text")) if found is None else found).mapInArrow(run, schema)
    return found.select("doc_id", "items")


def judge(docs: DataFrame, benchmark: DataFrame, width: int = 8, least: int = 13, block: int = 20_000) -> DataFrame:
    """doc_id, contaminated, item_ids, coverage (the largest) and reparameterised for every document."""
    found = matches(docs, benchmark, width, least, block)
    items = F.col("items")
    return found.select(
        "doc_id", (F.size(items) > 0).alias("contaminated"), F.transform(items, lambda i: i.item_id).alias("item_ids"),
        F.coalesce(F.array_max(F.transform(items, lambda i: i.coverage)), F.lit(0.0)).alias("coverage"), F.exists(items, lambda i: i.reparameterised).alias("reparameterised"),
    )


def select(docs: DataFrame, benchmark: DataFrame, width: int = 8, least: int = 13, block: int = 20_000) -> DataFrame:
    """The documents, all their columns, in which no item is found."""
    context = docs.sparkSession.sparkContext
    for part in _blocks(benchmark, width, block):
        shared = context.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in slices(batch):
                    rows = shared.value.judge(Tokens(*flat(piece.column("text"))), least)
                    yield piece.filter(pa.array([i not in rows for i in range(piece.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op2_decontaminate(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
