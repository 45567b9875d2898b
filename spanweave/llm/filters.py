"""Filter interaction audit: what each of a set of text filters removes, alone and after the others.

``marks`` scans Arrow buffers: tables of byte classes and prefix sums give the
counts of capitals, symbols and code points of every text, runs of non-space
bytes its words, and its sorted word hashes its distinct words. Words of equal
hash are compared byte by byte; where two differ, that text is counted again
by its words. Each text becomes a mask of the filters it fails.

``audit`` counts documents by part and mask; all orders and steps follow from
these 32 counts of a part, by one product with a matrix of ones and zeros.

Copies: documents are counted by digest of the text (SHA-256), part and labels
first, so a text that a third of all rows share is a few rows before any join.

Defined cases: a null text is an empty one; a null part is the empty string,
and one part with it. A document of null doc_id has no labels, fails E never,
and makes no other fail it. Rows of one doc_id are documents of their own, all
with the labels of the id; if their texts are equal, none is a smaller one. A
doc_id with several rows of labels has a label if one of them says so; null
labels say nothing. Other columns are ignored, whatever their names. Without
documents there are no parts and no rows. A task holds a slice of some MB, or
one text if that is longer; words are hashed in blocks of some MB.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import SLICE_BYTES, SPACE, flat, prefix_hash, slices, span_hash, spans
from .shared import raw, table

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
CAPITAL = np.zeros(256, dtype=bool)
CAPITAL[65:91] = True
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#$%&*|")] = True
#: Bytes that begin a code point.
FIRST = np.ones(256, dtype=bool)
FIRST[128:192] = False
COUNTS = ("n", "good", "toxic")


def class_counts(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """How many bytes of the class each text has, by differences of prefix sums."""
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kind[data], out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = SLICE_BYTES) -> np.ndarray:
    """Hash of every word, taken in runs of words over about ``block`` bytes."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + block, side="right")))
        base = starts[at]
        out[at:to] = span_hash(prefix_hash(data[base : ends[to - 1]]), starts[at:to] - base, ends[at:to] - base)
        at = to
    return out


def _differ(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray, block: int = SLICE_BYTES) -> np.ndarray:
    """Numbers of the pairs of equally long spans, at a and b, whose bytes are not the same."""
    found = []
    sums = np.cumsum(lengths)
    at = 0
    while at < len(a):
        done = sums[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sums, done + block, side="right")))
        n = lengths[at:to]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        wrong = data[np.repeat(a[at:to], n) + within] != data[np.repeat(b[at:to], n) + within]
        found.append(np.unique(np.repeat(np.arange(at, to), n)[wrong]))
        at = to
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def word_counts(data: np.ndarray, offsets: np.ndarray, hashed=word_hashes) -> tuple[np.ndarray, np.ndarray]:
    """Words and distinct words of every text; ``hashed`` gives the hash of each word."""
    n = len(offsets) - 1
    starts, ends = spans(~SPACE[data], offsets)
    text = np.searchsorted(offsets, starts, side="right") - 1
    words = np.bincount(text, minlength=n)
    if not len(starts):
        return words, np.zeros(n, np.int64)
    hashes = hashed(data, starts, ends)
    order = np.lexsort((hashes, text))
    same = (hashes[order[1:]] == hashes[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    distinct = words - np.bincount(text[order[1:]][same], minlength=n)
    left, right = order[:-1][same], order[1:][same]
    lengths = ends[left] - starts[left]
    odd = lengths != ends[right] - starts[right]
    wrong = text[left[odd]]
    left, right, lengths = left[~odd], right[~odd], lengths[~odd]
    wrong = np.union1d(wrong, text[left[_differ(data, starts[left], starts[right], lengths)]])
    for t in wrong.tolist():  # a collision of hashes
        mine = np.flatnonzero(text == t)
        distinct[t] = len({data[starts[w] : ends[w]].tobytes() for w in mine.tolist()})
    return words, distinct


def masks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of the filters A to D that each text fails."""
    words, distinct = word_counts(data, offsets)
    fails = (
        words < LEAST_WORDS,
        100 * distinct < DISTINCT_PERCENT * words,
        100 * class_counts(data, offsets, CAPITAL) > CAPITAL_PERCENT * class_counts(data, offsets, FIRST),
        class_counts(data, offsets, SYMBOL) > 0,
    )
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            found = pa.array(masks(*flat(part.column("text"))), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), found], ["doc_id", "part", "digest", "mask"])


def marks(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text and the mask of filters A to D, for every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = raw("text")
    part = F.coalesce(F.col("source").cast("string"), F.lit(""))
    given = docs.select("doc_id", part.alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    return given.mapInArrow(_mark, f"doc_id {kind}, part string, digest binary, mask int")


def _flag(column: str) -> Column:
    return F.coalesce(F.max((F.col(column) == 1).cast("int")), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, good ones and toxic ones by part and mask of all five filters.

    Of the documents with one text, E spares those of the least doc_id. They
    are counted as the text's groups are: by doc_id, then the least of each
    group of text, part and labels, then the least of the text.
    """
    said = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(_flag("quality").alias("good"), _flag("toxic").alias("toxic"))
    # Null ids find no labels; a salt deals them to all tasks of the join.
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(4096)) + 1).otherwise(0)
    found = marks(docs).withColumn("salt", salt).join(said.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left").fillna(0, ["good", "toxic"])
    # The digest decides the mask, so as a key the mask makes no further groups.
    by_id = found.groupBy("digest", "part", "good", "toxic", "mask", "doc_id").agg(F.count("*").alias("n"))
    groups = by_id.groupBy("digest", "part", "good", "toxic", "mask").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least")
    )
    least = groups.groupBy("digest").agg(F.min("least").alias("first"))
    spared = F.col("unnamed") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    parted = groups.join(least, "digest").withColumn("spared", spared)
    sides = F.array(F.struct("mask", F.col("spared").alias("n")), F.struct((F.col("mask") + F.lit(1 << 4)).alias("mask"), (F.col("n") - F.col("spared")).alias("n")))
    rows = parted.select("part", "good", "toxic", F.explode(sides).alias("side")).select("part", "good", "toxic", "side.*").where("n > 0")
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def orders() -> list[str]:
    return ["".join(p) for p in permutations(FILTERS)]


def step_masks() -> dict[str, np.ndarray]:
    """For each of the 120 x 5 steps (rows) and 32 masks (columns): is a document of the mask counted?"""
    mask = np.arange(1 << len(FILTERS))
    kept, removed, redundant, alone = [], [], [], []
    for order in orders():
        before = np.zeros(len(mask), bool)
        for letter in order:
            bit = 1 << FILTERS.index(letter)
            fails = mask & bit != 0
            removed.append(fails & ~before)
            redundant.append(fails & before)
            alone.append(mask == bit)
            before = before | fails
            kept.append(~before)
    removed = np.array(removed)
    letters = np.array([letter for order in orders() for letter in order])
    sums = {letter: removed[letters == letter].sum(axis=0) for letter in FILTERS}
    return {"kept": np.array(kept), "removed": removed, "redundant": np.array(redundant), "unique_fails": np.array(alone), "shapley": np.array([sums[x] for x in letters])}


STEPS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All orders and steps of parts, each a row of three arrays of 32 counts."""
    of = {k: v.astype(np.int64).T for k, v in step_masks().items()}
    names = pa.array([o for o in orders() for _ in FILTERS])
    steps = pa.array([k + 1 for _ in orders() for k in range(len(FILTERS))], pa.int32())
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            few = batch.slice(at, 64)
            n, good, toxic = (np.array(few.column(c).to_pylist(), np.int64).reshape(few.num_rows, -1) for c in COUNTS)
            found = [n @ of[k] for k in ("kept", "removed", "redundant", "unique_fails")] + [good @ of["removed"], toxic @ of["removed"], n @ of["shapley"]]
            part = few.column("part").take(pa.array(np.repeat(np.arange(few.num_rows), len(names))))
            columns = [part, pa.concat_arrays([names] * few.num_rows), pa.concat_arrays([steps] * few.num_rows)] + [pa.array(x.reshape(-1)) for x in found]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in STEPS.split(", ")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a part, order of the filters and step."""
    counts = mask_counts(docs, labels)
    one = [F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)) for c in COUNTS for m in range(1 << len(FILTERS))]
    size = 1 << len(FILTERS)
    wide = counts.groupBy("part").agg(*[F.array(*one[k * size : (k + 1) * size]).alias(c) for k, c in enumerate(COUNTS)])
    return wide.mapInArrow(_steps, STEPS)


def op12_filters(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL = """
WITH words AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM words GROUP BY text),
said AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
fails AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first, false)] AS f
    FROM words JOIN firsts USING (text) LEFT JOIN said USING (doc_id)),
masks AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY ALL),
letters(x) AS (VALUES (1), (2), (3), (4), (5)),
orders AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, s.x AS step, o[s.x] AS letter FROM orders, letters s),
placed AS (SELECT part, o, step, letter, n, good, toxic, f[letter] AS fails, list_bool_or([f[y] for y in o[1:step - 1]]) AS before, len(list_filter(f, lambda y: y)) AS failed FROM masks, steps),
counted AS (SELECT part, o, step, letter, sum(CASE WHEN NOT fails AND NOT coalesce(before, false) THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT coalesce(before, false) THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails AND coalesce(before, false) THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails AND failed = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails AND NOT coalesce(before, false) THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT coalesce(before, false) THEN toxic ELSE 0 END) AS toxic_lost FROM placed GROUP BY ALL)
SELECT part, array_to_string([substr('ABCDE', y, 1) for y in o], '') AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM counted
"""
