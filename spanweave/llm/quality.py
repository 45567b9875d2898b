"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text's features are the hashed words and symbol runs that it contains, and
bins of a few ratios. With shared weights w and ordered thresholds,
P(grade <= k) = sigmoid(t_k - w.x); this gives the expected grade and the tail
probabilities P(grade >= k). Labels grade a document 0 (toxic), 1 (poor) or 2
(good). The model is fitted on a bounded sample of labelled documents
(``sample``, those of least hashed id); every whole text is scored.

Defined cases: a null or empty text has only its ratio features; labels with a
null id or rating are ignored, and of several for one id the lowest grade
holds; without any labelled document the weights are 0 and all is kept; null
or repeated doc_ids and equal rows are scored like any other; an empty table
gives an empty result. ``select`` keeps all columns, whatever they are called.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import LOWER, flat, mix, prefix_hash, slices, span_hash, spans
from .shared import raw, table

BITS = 18
GRADES = 3
SPACE_KIND, WORD_KIND, SYMBOL_KIND = 0, 1, 2
KIND = np.full(256, SYMBOL_KIND, np.uint8)
KIND[[0x20, 9, 10, 11, 12, 13]] = SPACE_KIND
KIND[48:58] = KIND[65:91] = KIND[97:123] = KIND[128:] = WORD_KIND
UPPER = np.zeros(256, bool)
UPPER[65:91] = True


def _bin(name: int, value: np.ndarray) -> np.ndarray:
    return mix(np.full(len(value), 1000 + name, np.uint64) * np.uint64(4097) + value.astype(np.uint64))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of each distinct feature, in order of text."""
    n = len(offsets) - 1
    lower, kind = LOWER[data], KIND[data]
    prefix = prefix_hash(lower)
    keys, counts = [], []
    for k in (WORD_KIND, SYMBOL_KIND):
        starts, ends = spans(kind == k, offsets)
        owner = np.searchsorted(offsets, starts, side="right") - 1
        counts.append(np.bincount(owner, minlength=n))
        hashes = mix(span_hash(prefix, starts, ends) ^ np.uint64(k))
        keys.append(owner << BITS | (hashes >> np.uint64(64 - BITS)).astype(np.int64))
    words_of, symbols_of = counts
    keys[0] = np.unique(keys[0])
    distinct = np.bincount(keys[0] >> BITS, minlength=n)
    capitals = np.add.reduceat(np.append(UPPER[data], False), offsets[:-1], dtype=np.int64) * (np.diff(offsets) > 0)
    some = np.maximum(words_of, 1)
    bins = [
        np.log2(1 + words_of),
        np.minimum(15, 16 * symbols_of / some),
        8 * distinct / some,
        8 * capitals / np.maximum(np.diff(offsets), 1),
    ]
    for name, value in enumerate(bins):
        keys.append(np.arange(n) << BITS | (_bin(name, np.floor(value)) >> np.uint64(64 - BITS)).astype(np.int64))
    every = np.unique(np.concatenate(keys))
    return every >> BITS, every & ((1 << BITS) - 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


PART = 1 << 18  # features that the driver's sums take at once, so that their copies in 64 bits stay few


def _parts(owner: np.ndarray) -> list[slice]:
    """Slices of PART features and the rest of a text."""
    ends = [0]
    while ends[-1] < len(owner):
        last = min(ends[-1] + PART, len(owner)) - 1
        ends.append(int(np.searchsorted(owner, owner[last], side="right")))
    return [slice(a, b) for a, b in itertools.pairwise(ends)]


def _by_text(owner: np.ndarray, column: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``value`` at the columns of each text."""
    sums = np.zeros(n)
    for part in _parts(owner):
        first, last = int(owner[part.start]), int(owner[part.stop - 1])
        sums[first : last + 1] = np.bincount(owner[part] - owner[part.start], value[column[part]], last - first + 1)
    return sums


def _associated(owner: np.ndarray, bucket: np.ndarray, grade: np.ndarray, least: float) -> np.ndarray:
    """Which buckets tell the grades apart: their likelihood ratio statistic reaches ``least``."""
    totals = np.bincount(grade, minlength=GRADES).astype(np.float64)
    seen = np.zeros((GRADES, 1 << BITS))
    for part in _parts(owner):
        grade_of = grade[owner[part]]
        for k in range(GRADES):
            seen[k] += np.bincount(bucket[part][grade_of == k], minlength=1 << BITS)
    here = seen.sum(axis=0)
    statistic = np.zeros(1 << BITS)
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in range(GRADES):
            for part, whole in ((seen[k], here), (totals[k] - seen[k], len(grade) - here)):
                statistic += np.where(part > 0, 2 * part * np.log(part * len(grade) / (whole * totals[k])), 0)
    return (statistic >= least) & (here > 0)


def fit(owner: np.ndarray, bucket: np.ndarray, grade: np.ndarray, least: float = 25.0, penalty: float = 1e-4, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights by bucket and GRADES - 1 thresholds.

    Buckets without association with the grade get no weight; the others are
    fitted by accelerated proximal gradient steps with an L1 penalty.
    """
    weights = np.zeros(1 << BITS)
    share = (np.bincount(grade, minlength=GRADES) + 0.5) / (len(grade) + 0.5 * GRADES)
    below = np.cumsum(share)[:-1]
    gaps = np.log(below / (1 - below))
    if not len(grade):
        return weights.astype(np.float32), gaps
    told = _associated(owner, bucket, grade, least)
    used, held = np.flatnonzero(told), told[bucket]
    owner, column = owner[held], np.cumsum(told, dtype=np.int32)[bucket[held]] - np.int32(1)
    del held
    n, w = len(grade), np.zeros(len(used))
    count = np.zeros(len(used), np.int64)
    for part in _parts(owner):
        count += np.bincount(column[part], minlength=len(used))
    scale = np.sqrt(count / n)
    value = 1 / scale  # features of equal spread: rare ones may weigh as much
    ahead, t = w.copy(), 1.0
    step = 4.0 / max(1.0, float(np.mean(_by_text(owner, column, value * value, n))))
    for _ in range(steps):
        x = _by_text(owner, column, ahead * value, n)
        upper = np.where(grade < GRADES - 1, _sigmoid(np.append(gaps, 40.0)[grade] - x), 1.0)
        under = np.where(grade > 0, _sigmoid(np.append(-40.0, gaps)[grade] - x), 0.0)
        p = np.maximum(upper - under, 1e-9)
        up, un = upper * (1 - upper) / p, under * (1 - under) / p
        slope = (up - un) / n  # of the loss, by x
        sums = np.zeros(len(used))
        for part in _parts(owner):
            sums += np.bincount(column[part], slope[owner[part]] * value[column[part]], len(used))
        new = ahead - step * sums
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / after * (new - w), new, after
        for k in range(GRADES - 1):
            gaps[k] += 0.5 * (up[grade == k].sum() - un[grade == k + 1].sum()) / n
        gaps = np.maximum.accumulate(gaps + np.arange(GRADES - 1) * 1e-9)
    weights[used] = w / scale
    return weights.astype(np.float32), gaps


def _one_of_copies(bounds: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """One text of those whose three least features (by a hash) agree, so that copies don't vote many times."""
    least = np.full((len(bounds) - 1, 3), -1, np.int64)
    for k, (a, b) in enumerate(itertools.pairwise(bounds.tolist())):
        mine = bucket[a:b]
        first = mine[np.argsort(mix(mine.astype(np.uint64)))[:3]]
        least[k, : len(first)] = first
    return np.sort(np.unique(least, axis=0, return_index=True)[1])


def _only(chosen: np.ndarray, lengths: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """owner and bucket of the texts of which ``chosen`` is true, numbered anew."""
    kept = lengths[chosen]
    owner = np.repeat(np.arange(len(kept), dtype=np.min_scalar_type(len(kept))), kept)
    return owner, bucket if chosen.all() else bucket[np.repeat(chosen, lengths)]


def _ordered(found: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """grade and number of features of each text, and all features, in order of doc_id and mark."""
    order = pc.sort_indices(found, [("doc_id", "ascending"), ("mark", "ascending")])
    grade = found.column("grade").take(order).to_numpy().astype(np.int64)
    lists = found.column("buckets").combine_chunks()
    del found
    lengths = pc.list_value_length(lists).take(order).to_numpy(zero_copy_only=False).astype(np.int64)
    bucket, at = np.empty(lengths.sum(), np.int32), 0
    for k in range(0, len(order), 500):
        values = lists.take(order[k : k + 500]).flatten()
        bucket[at : at + len(values)] = values
        at += len(values)
    return grade, lengths, bucket


def grades(model: tuple[np.ndarray, np.ndarray], data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected grade and P(grade >= k), k from 1, of each text."""
    weights, cuts = model
    owner, bucket = features(data, offsets)
    x = np.bincount(owner, weights[bucket].astype(np.float64), len(offsets) - 1)
    tails = _sigmoid(x[:, None] - cuts[None, :])
    return tails.sum(axis=1), tails


def _graded(labels: DataFrame) -> DataFrame:
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1)
    rated = labels.where("doc_id is not null and quality is not null and toxic is not null")
    return rated.select("doc_id", grade.alias("grade")).groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, thresholds and the least P(grade >= 2) of what is selected."""
    graded = _graded(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    marked = docs.select("doc_id", F.xxhash64("text").alias("mark"), raw("text").alias("text"))
    # One row of each text of these ids, and no more than ``sample`` of them: ids may be repeated.
    rated = marked.select("doc_id", "mark").join(F.broadcast(graded), "doc_id").distinct()
    chosen = rated.orderBy(F.xxhash64("doc_id", "mark"), "doc_id", "mark").limit(sample)
    rows = marked.join(F.broadcast(chosen), ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                owner, bucket = features(*flat(part.column("text")))
                ends = np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(bucket.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), part.column("grade").cast(pa.int32()), lists], ["doc_id", "mark", "grade", "buckets"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    grade, lengths, bucket = _ordered(rows.mapInArrow(gather, f"doc_id {kind}, mark long, grade int, buckets array<int>").toArrow())
    pa.default_memory_pool().release_unused()
    chosen = _one_of_copies(np.append(0, np.cumsum(lengths)), bucket)
    among = np.zeros(len(grade), bool)
    among[chosen] = True
    bucket = _only(among, lengths, bucket)[1]
    grade, lengths = grade[chosen], lengths[chosen]
    held = np.arange(len(grade)) % 5 == 4
    cut_at = 0.5 if len(grade) else 0.0
    if held.any():
        model = fit(*_only(~held, lengths, bucket), grade[~held])
        tail = _sigmoid(_by_text(*_only(held, lengths, bucket), model[0].astype(np.float64), int(held.sum())) - model[1][-1])
        cut_at = _cut(tail[grade[held] == GRADES - 1], tail[grade[held] < GRADES - 1])
    return *fit(*_only(np.ones(len(grade), bool), lengths, bucket), grade), cut_at


def _cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The tail probability that parts held-out good from other documents best; one half where there are too few."""
    if len(good) < 20 or len(bad) < 20:
        return 0.5
    at = np.linspace(0.05, 0.95, 91)
    right = 1 - np.searchsorted(np.sort(good), at) / len(good) + np.searchsorted(np.sort(bad), at) / len(bad)
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float(at[best[len(best) // 2]])


def _scores(model: tuple) -> Callable:
    *ordinal, cut_at = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                expected, tails = grades(ordinal, *flat(part.column("text")))
                keep = tails[:, -1] >= cut_at
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(expected), pa.array(tails[:, 0]), pa.array(tails[:, 1]), pa.array(keep)], ["doc_id", "expected_grade", "p_at_least_1", "p_at_least_2", "keep"])

    return run


def score(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    """doc_id, expected_grade, p_at_least_1, p_at_least_2 and keep of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    run = _scores(train(docs, labels, sample))
    return docs.select("doc_id", raw("text").alias("text")).mapInArrow(run, f"doc_id {kind}, expected_grade double, p_at_least_1 double, p_at_least_2 double, keep boolean")


def select(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    """The documents, all their columns, that the model selects."""
    *ordinal, cut_at = train(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(grades(ordinal, *flat(part.column("text")))[1][:, -1] >= cut_at))

    return docs.mapInArrow(run, docs.schema)


def op7_quality(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
