"""Document fingerprints of improbable features: rare byte windows in chained Bloom filters.

Every window of WIDTH bytes has an entropy; windows whose class of entropy is
rare in the corpus (``rarity``, counted over all windows of all documents) rank
first. Of each SPAN neighbouring windows the one of first rank, the leftmost of
equals, is favoured; windows favoured by LEAST or more neighbourhoods, and each
text's first in rank, are its features. A neighbourhood at the end of a text
is shorter. Features enter Bloom filters of BITS bits in page order, FEATURES
to a filter, then the next filter of the chain begins. ``likeness`` compares
the chain of fewer features with the other: the mean over its filters, by
their features, of the greatest overlap of bits beyond chance, as a share of
the greatest possible.

``fingerprints`` is the operator. ``edits`` pairs each document with the next
one in order of doc_id and fingerprints both and the text spliced of the two.
Documents are dealt to tasks by ranges of (doc_id, digest of the text); the
first document of each range is dealt to the range before it as well, so that
every task reads successors in order and holds a few MB of text.

Defined cases: a null text is an empty one. A text of less than WIDTH bytes is
one feature, an empty one none and its fingerprint is empty; two empty
fingerprints have likeness 1, one beside another 0. Null doc_ids follow all
others; rows of one doc_id follow each other by digest of the text, so equal
rows, which can be exchanged, are neighbours. A lone document is its own
successor. Other columns are ignored, whatever their names; an empty table
gives an empty result. Equal rows that hold a large part of the table go to
one task, as a stream. A text is scanned in blocks, so that beside its bytes
it costs about five bytes a byte.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import BASE, flat, mix, powers, slices
from .shared import raw, table

WIDTH, SPAN, LEAST = 24, 32, 8
BITS, PICKS, FEATURES = 2048, 5, 160
CLASSES = 1000
BLOCK = 1 << 18
#: Bytes of text and number of documents, among the classes of the histogram.
BYTES, DOCS = -1, -2
#: Ranges of documents: bytes of one, and how many at most (beyond that a task streams more).
RANGE_BYTES, MOST_RANGES, SAMPLED = 1 << 25, 1 << 14, 16

_n = np.arange(1, WIDTH + 1)
#: n * log2(n) in steps of 2**-16, as differences: a window's sum is exact whatever its way there.
_GROWTH = np.diff(np.rint(np.concatenate([[0], _n * np.log2(_n)]) * 65536).astype(np.int32), prepend=0)
_FULL = int(_GROWTH.sum())


def _classes(data: np.ndarray) -> np.ndarray:
    """Class of entropy of each window of a short run of bytes.

    W * entropy is W log2 W less the sum of n log2 n over the counts of a
    window's bytes. The count of a byte among the window that it ends, and
    among the one that it begins, tells how the sum changes as a window moves.
    """
    ends, begins = np.ones(len(data), np.uint8), np.ones(len(data), np.uint8)
    for d in range(1, WIDTH):
        same = (data[d:] == data[:-d]).view(np.uint8)
        ends[d:] += same
        begins[:-d] += same
    step = _GROWTH[ends]
    step[WIDTH:] -= _GROWTH[begins[:-WIDTH]]
    sums = np.cumsum(step, dtype=np.int64)[WIDTH - 1 :]
    return ((_FULL - sums) * CLASSES // _FULL).astype(np.int16)


def entropy_classes(data: np.ndarray) -> np.ndarray:
    """Class, 0 to CLASSES, of the window at each byte; WIDTH - 1 fewer than bytes."""
    n = len(data) - WIDTH + 1
    out = np.zeros(max(0, n), np.int16)
    for at in range(0, n, BLOCK):
        out[at : at + BLOCK] = _classes(data[at : min(at + BLOCK, n) + WIDTH - 1])
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(CLASSES + 1, np.int64)
    size = docs = 0
    for batch in batches:
        for part in slices(batch):
            data, offsets = flat(part.column("text"))
            found = entropy_classes(data)
            crossing = np.zeros(len(found), bool)
            for end in offsets[1:-1].tolist():
                crossing[max(0, end - WIDTH + 1) : end] = True
            seen += np.bincount(found[~crossing], minlength=CLASSES + 1)
            size, docs = size + len(data), docs + part.num_rows
    held = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(held, [BYTES, DOCS]), pa.int32()), pa.array(np.append(seen[held], [size, docs]), pa.int64())], ["class", "n"])


def class_counts(docs: DataFrame) -> dict[int, int]:
    """Windows by class of entropy over all texts, with BYTES and DOCS: CLASSES + 3 numbers at most."""
    rows = docs.select(raw("text").alias("text")).mapInArrow(_count, "class int, n long").groupBy("class").agg(F.sum("n").alias("n")).collect()
    return {r["class"]: r["n"] for r in rows}


def rarity(counts: dict[int, int]) -> np.ndarray:
    """Rank of each class, the rarest first, equals by class."""
    seen = np.array([counts.get(c, 0) for c in range(CLASSES + 1)])
    rank = np.empty(CLASSES + 1, np.int16)
    rank[np.lexsort((np.arange(CLASSES + 1), seen))] = np.arange(CLASSES + 1)
    return rank


def _favoured(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that are first in rank among SPAN neighbours from some place on, and among how many."""
    places, times = [], []
    for at in range(0, len(rank), BLOCK):
        near = rank[at : at + BLOCK + SPAN - 1]
        near = np.concatenate([near, np.full(min(at + BLOCK, len(rank)) - at + SPAN - 1 - len(near), CLASSES + 1, rank.dtype)])
        key = near.astype(np.int64) << 32 | np.arange(len(near))
        reach = 1
        while reach < SPAN:
            more = min(reach, SPAN - reach)
            key = np.minimum(key[:-more], key[more:])
            reach += more
        first = ((key & 0xFFFFFFFF) + at)[near[: len(key)] <= CLASSES]  # never falls from one place to the next
        cuts = np.flatnonzero(np.diff(first, prepend=-1))  # neighbourhoods begin at a place of a text, none between texts
        places.append(first[cuts])
        times.append(np.diff(np.append(cuts, len(first))))
    place, count = np.concatenate(places), np.concatenate(times)
    cuts = np.flatnonzero(np.diff(place, prepend=-1))
    return place[cuts], np.add.reduceat(count, cuts)


class Chains(NamedTuple):
    """Bloom filters of texts: those of text k are first[k] up to first[k + 1]."""

    first: np.ndarray
    filters: np.ndarray
    features: np.ndarray

    def text(self, k: int) -> str:
        of = range(self.first[k], self.first[k + 1])
        return ",".join(f"{self.features[i]}:{base64.b64encode(self.filters[i].tobytes()).decode()}" for i in of)


def parse(texts: list[str]) -> Chains:
    """Chains from their text form."""
    parts = [t.split(",") if t else [] for t in texts]
    first = np.cumsum([0, *map(len, parts)])
    flat_parts = [p.split(":") for few in parts for p in few]
    filters = np.frombuffer(b"".join(base64.b64decode(b) for _, b in flat_parts), np.uint8).reshape(-1, BITS // 8)
    return Chains(first, filters, np.array([int(a) for a, _ in flat_parts], np.int64))


def _places(data: np.ndarray, offsets: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and place of the features of all texts of WIDTH bytes and more."""
    lengths = np.diff(offsets)
    long = np.flatnonzero(lengths >= WIDTH)
    if not len(long):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = entropy_classes(data)
    windows = lengths[long] - WIDTH + 1
    laid = np.cumsum(np.append(0, windows + SPAN - 1))
    lined = np.full(laid[-1], CLASSES + 1, np.int16)
    best = []
    for o, s, m in zip(laid.tolist(), offsets[long].tolist(), windows.tolist(), strict=False):
        lined[o : o + m] = rank[found[s : s + m]]
        best.append(o + int(lined[o : o + m].argmin()))
    place, times = _favoured(lined)
    keep = np.union1d(place[times >= LEAST], best)
    text = np.searchsorted(laid, keep, side="right") - 1
    return long[text], keep - laid[text] + offsets[long[text]]


def _hashes(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    out = np.empty(len(places), np.uint64)
    weights = powers(BASE, WIDTH)
    for at in range(0, len(places), 4096):
        window = data[places[at : at + 4096, None] + np.arange(WIDTH)].astype(np.uint64) + np.uint64(1)
        out[at : at + 4096] = mix((window * weights).sum(axis=1, dtype=np.uint64))
    return out


def chains(data: np.ndarray, offsets: np.ndarray, rank: np.ndarray) -> Chains:
    """Chained Bloom filters of every text."""
    n = len(offsets) - 1
    text, place = _places(data, offsets, rank)
    hashed = _hashes(data, place)
    lengths = np.diff(offsets)
    short = np.flatnonzero((lengths > 0) & (lengths < WIDTH))
    padded = np.zeros((len(short), WIDTH), np.uint64)
    for k, t in enumerate(short.tolist()):
        padded[k, : lengths[t]] = data[offsets[t] : offsets[t + 1]].astype(np.uint64) + np.uint64(1)
    text, place = np.append(text, short), np.append(place, offsets[short])
    hashed = np.append(hashed, mix((padded * powers(BASE, WIDTH)).sum(axis=1, dtype=np.uint64)))
    order = np.lexsort((place, hashed, text))
    again = (np.diff(text[order], prepend=-1) == 0) & (np.diff(hashed[order], prepend=np.uint64(0)) == 0)
    again[:1] = False
    keep = np.sort(order[~again]) if not len(short) else order[~again][np.lexsort((place[order[~again]], text[order[~again]]))]
    text, hashed = text[keep], hashed[keep]
    held = np.bincount(text, minlength=n)
    first = np.cumsum(np.append(0, -(-held // FEATURES)))
    at = first[text] + (np.arange(len(text)) - (np.cumsum(held) - held)[text]) // FEATURES
    bits = np.zeros((first[-1], BITS), bool)
    step = (BITS - 1).bit_length()
    for k in range(PICKS):
        bits[at, (hashed >> np.uint64(step * k) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return Chains(first, np.packbits(bits, axis=1), np.bincount(at, minlength=first[-1]))


_SET = 1 - (1 - 1 / BITS) ** (PICKS * np.arange(FEATURES + 1))


def _beyond_chance(common: np.ndarray, most: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    chance = BITS * _SET[a] * _SET[b]
    return np.clip((common - chance) / (most - chance), 0, 1)


def _one_likeness(a: Chains, i: int, b: Chains, j: int) -> float:
    x, y = slice(a.first[i], a.first[i + 1]), slice(b.first[j], b.first[j + 1])
    left, right = (a.filters[x], a.features[x]), (b.filters[y], b.features[y])
    if not len(left[1]) or not len(right[1]):
        return float(len(left[1]) == len(right[1]))
    if (right[1].sum(), right[0].tobytes()) < (left[1].sum(), left[0].tobytes()):
        left, right = right, left
    theirs = np.unpackbits(right[0], axis=1).astype(np.float32)
    score = np.empty(len(left[1]))
    for at in range(0, len(score), 64):
        mine = np.unpackbits(left[0][at : at + 64], axis=1).astype(np.float32)
        most = np.minimum(mine.sum(axis=1)[:, None], theirs.sum(axis=1)[None, :])
        score[at : at + 64] = _beyond_chance(mine @ theirs.T, most, left[1][at : at + 64, None], right[1][None, :]).max(axis=1)
    return float((score * left[1]).sum() / left[1].sum())


def likeness(a: Chains, i: np.ndarray, b: Chains, j: np.ndarray) -> np.ndarray:
    """Likeness, 0 to 1, of texts i of a and texts j of b, pair by pair; the same both ways."""
    out = np.empty(len(i))
    lone = (a.first[i + 1] - a.first[i] == 1) & (b.first[j + 1] - b.first[j] == 1)
    x, y = a.first[i[lone]], b.first[j[lone]]
    left, right = a.filters[x], b.filters[y]
    ones = lambda z: np.bitwise_count(z).sum(axis=1, dtype=np.int64)
    out[lone] = _beyond_chance(ones(left & right), np.minimum(ones(left), ones(right)), a.features[x], b.features[y])
    for k in np.flatnonzero(~lone).tolist():
        out[k] = _one_likeness(a, int(i[k]), b, int(j[k]))
    return out


def fingerprints(docs: DataFrame, rank: np.ndarray) -> DataFrame:
    """doc_id and the fingerprint of every text, in one pass."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = chains(*flat(part.column("text")), rank)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([found.text(k) for k in range(part.num_rows)], pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", raw("text").alias("text")).mapInArrow(run, f"doc_id {kind}, fingerprint string")


def compared(pairs: DataFrame, left: str, right: str, name: str = "likeness") -> DataFrame:
    """``pairs`` with the likeness of two columns of fingerprints; a null one is an empty one."""
    schema = pairs.withColumn(name, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (parse([x or "" for x in batch.column(c).to_pylist()]) for c in (left, right))
            all_rows = np.arange(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != name), pa.array(likeness(a, all_rows, b, all_rows))], [f.name for f in schema])

    return pairs.mapInArrow(run, schema)


KEY = ("unnamed", "doc_id", "digest")


def _bounds(keyed: DataFrame, size: int, count: int) -> list[tuple]:
    """Least keys of ranges: that of the table, and some of a sample, chosen by hash, of about SAMPLED keys a range."""
    ranges = min(MOST_RANGES, size // RANGE_BYTES + 1)
    least = keyed.agg(F.min(F.struct(*KEY)).alias("k")).first()["k"]
    sample = keyed.select(*KEY).where(F.pmod(F.xxhash64("doc_id", "digest"), F.lit(max(1, count // (SAMPLED * ranges)))) == 0).limit(4 * SAMPLED * ranges).collect() if ranges > 1 else []
    found = sorted({(r["unnamed"], r["doc_id"], bytes(r["digest"])) for r in sample})
    step = max(1, len(found) // ranges)
    return sorted({(least["unnamed"], least["doc_id"], bytes(least["digest"])), *found[step::step]})


def _dealt(bounds: list[tuple]):
    """Deals rows to ranges; a bound's own row also goes, as a guest, to the range before (the first one's to the last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in KEY), strict=True))
            home = [bisect_right(bounds, k) - 1 for k in keys]
            heads = [r for r, (k, h) in enumerate(zip(keys, home, strict=True)) if bounds[h] == k]
            rows = pa.array([*range(len(keys)), *heads], pa.int64())
            ranges = pa.array([*home, *((home[r] - 1) % len(bounds) for r in heads)], pa.int32())
            guest = pa.array([False] * len(keys) + [True] * len(heads))
            yield pa.RecordBatch.from_arrays([ranges, guest, *(batch.column(c).take(rows) for c in (*KEY, "text"))], ["range", "guest", *KEY, "text"])

    return run


def splice(text: bytes, following: bytes) -> tuple[int, bytes]:
    """Code points of the text, and the text with its last half replaced by the first code points of another."""
    mine = text.decode("utf-8", "surrogateescape")
    half = len(mine) // 2
    theirs = following[: 4 * half].decode("utf-8", "ignore" if len(following) > 4 * half else "surrogateescape")
    return len(mine), (mine[: len(mine) - half] + theirs[:half]).encode("utf-8", "surrogateescape")


EDITS = "doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(rank: np.ndarray):
    """Rows of a range in order, its guest last: each with the row after it."""

    def rows(held: list[tuple]) -> pa.RecordBatch:
        of = np.array([k for k in range(len(held) - 1) if not held[k][1]], np.int64)
        for k in of.tolist():
            if held[k][0] != held[k + 1][0]:
                raise ValueError("a range of documents ends without the first document of the next one")
        spliced = [splice(held[k][3], held[k + 1][3]) for k in of.tolist()]
        whole = chains(*flat(pa.array([h[3] for h in held], pa.binary())), rank)
        edited = chains(*flat(pa.array([e for _, e in spliced], pa.binary())), rank)
        at = np.arange(len(of))
        columns = [
            pa.array([held[k][2] for k in of.tolist()]), pa.array([n for n, _ in spliced], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for _, e in spliced], pa.string()),
            pa.array([whole.text(k) for k in of.tolist()], pa.string()), pa.array([edited.text(k) for k in at.tolist()], pa.string()),
            pa.array(likeness(whole, of, edited, at)), pa.array(likeness(whole, of, whole, of + 1)),
        ]
        return columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple] = []
        for batch in batches:
            for part in slices(batch):
                held = last + list(zip(*(part.column(c).to_pylist() for c in ("range", "guest", "doc_id", "text")), strict=True))
                columns = rows(held)
                last = held[-1:]
                yield pa.RecordBatch.from_arrays([columns[0].cast(part.schema.field("doc_id").type), *columns[1:]], [c.split()[0] for c in EDITS.split(", ")])
        if last and not last[0][1]:
            raise ValueError("a range of documents ends without the first document of the next one")

    return run


def edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and the likeness to the edited and to the next text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = class_counts(docs)
    if not counts.get(DOCS):
        return docs.sparkSession.createDataFrame([], EDITS.format(kind=kind))
    given = docs.select(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.unhex(F.sha2(raw("text"), 256)).alias("digest"), raw("text").alias("text"))
    bounds = _bounds(given, counts[BYTES], counts[DOCS])
    dealt = given.mapInArrow(_dealt(bounds), f"range int, guest boolean, unnamed boolean, doc_id {kind}, digest binary, text binary")
    lined = dealt.repartitionById(len(bounds), F.col("range")).sortWithinPartitions("range", "guest", *KEY).select("range", "guest", "doc_id", "text")
    return lined.mapInArrow(_edited(rarity(counts)), EDITS.format(kind=kind))


def op11_digests(spark, sf_dir):
    return edits(table(spark, sf_dir, "documents"))


#: What SQL can say of the query: code points and the edited texts.
EDITS_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), (SELECT arg_min(t, doc_id) FROM d)) AS following FROM d)
SELECT doc_id, length(t) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 2) || substr(following, 1, length(t) // 2)) AS edited_sha256 FROM n
"""


def sql_op11_edits(spark, sf_dir):
    """Operator 11's code points and edited texts."""
    return op11_digests(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")
