"""LM scoring by context-tree weighting, with a smoothed unigram base beside it.

The model codes a text as its lower-cased words joined by single spaces and
closed by an end byte (0xFF, which UTF-8 never has), so that it and the base
give probabilities of the same tokens. Contexts before a text's start are end
bytes.

Nothing of corpus size is sent to all tasks. Texts are dealt into blocks of
about ``block_bytes`` by a hash; a block asks for its distinct grams and words
once each:

1. every block gives its distinct grams and words with their training counts,
   as one compressed row for each bucket of keys;
2. each bucket adds up its counts, block by block, and folds its context trees
   up to depth 2; only these upper nodes (65536 * 255 at most, whatever the
   corpus) meet in one place, where depths 1 and 0 are weighted;
3. with the upper part of the mixture each bucket computes the probability of
   each of its grams, and answers every block's rows;
4. a block meets its answers and adds them up by document.

A gram that training lacks is asked for with count 0 and is coded by the
contexts that are known. Defined cases: a null or empty text codes its end
alone; a null doc_id is held out (as crc32 of nothing is 0); repeated ids and
equal rows are scored each; without training documents every decision has
probability 1/2 and the base score is 0 (N + 0.1 (V + 1) is then 0.1 and c is
0); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ctw
from .kernels import flat, mix, words
from .shared import cut, keyed, raw, table

DEPTH = 5
BLOCK_BYTES = 10 << 20
CHUNK = 4 << 20
END_WORD = np.uint64(0x6A09E667F3BCC909).astype(np.int64)
NOTHING = np.zeros(0, np.int64)


def _pack(array: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(array).tobytes(), 1)


def _unpack(data: bytes, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def _gaps(keys: np.ndarray) -> bytes:
    """Sorted keys as packed differences."""
    return _pack(np.diff(keys, prepend=np.int64(0)))


def _keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data))


def _sum(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else NOTHING
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def coded(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stream that codes the texts, and where each text's symbols begin and end in it."""
    parts = [b" ".join(t.lower().split()) for t in texts]
    gap = b"\xff" * depth
    stream = np.frombuffer(gap + b"".join(x for p in parts for x in (p, gap)), np.uint8)
    lengths = np.array([len(p) for p in parts], np.int64)
    starts = depth + np.concatenate([[0], np.cumsum(lengths + depth)[:-1]]).astype(np.int64) if len(parts) else NOTHING
    return stream, starts, starts + lengths + 1


class Finder:
    """Places of keys in a table without repeats, by hashing into slots; keys that lost their slot go to a next table."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.levels = keys, []
        left, salt = np.arange(len(keys), dtype=np.int32), 0
        while len(left) > 64 and len(self.levels) < 24:
            bits = (2 * len(left)).bit_length()
            at = self._slot(keys[left], salt, bits)
            slots = np.full(1 << bits, -1, np.int32)
            slots[at] = left
            self.levels.append((salt, bits, slots))
            left, salt = left[slots[at] != left], salt + 1
        self.rest = left[np.argsort(keys[left], kind="stable")]

    @staticmethod
    def _slot(keys: np.ndarray, salt: int, bits: int) -> np.ndarray:
        factor = np.uint64((0x9E3779B97F4A7C15 * (2 * salt + 1)) & ((1 << 64) - 1))
        return (keys.view(np.uint64) * factor) >> np.uint64(64 - bits)

    def find(self, asked: np.ndarray) -> np.ndarray:
        """Place of each asked key; all of them must be there."""
        out = np.zeros(len(asked), np.int32)
        open_ = None
        for salt, bits, slots in self.levels:
            mine = asked if open_ is None else asked[open_]
            at = slots[self._slot(mine, salt, bits)]
            hit = self.keys[at] == mine
            if open_ is None:
                out, open_ = at, np.flatnonzero(~hit)
            else:
                out[open_] = at
                open_ = open_[~hit]
            if not len(open_):
                return out
        open_ = np.arange(len(asked)) if open_ is None else open_
        if len(open_) and len(self.rest):
            place = np.minimum(np.searchsorted(self.keys[self.rest], asked[open_]), len(self.rest) - 1)
            out[open_] = self.rest[place]
        return out


def _distinct(values: np.ndarray, counted: bool) -> tuple[np.ndarray, np.ndarray]:
    if counted:
        keys, counts = np.unique(values, return_counts=True)
        return keys, counts.astype(np.int64)
    keys = np.unique(values)
    return keys, np.zeros(len(keys), np.int64)


def block_grams(texts: list[bytes], train: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of the texts with their counts in training texts."""
    keys, counts = [NOTHING], [NOTHING]
    fill = (1 << (8 * (depth + 1))) - 1  # the gram of an empty text's end
    for learnt in (True, False):
        mine = [t for t, x in zip(texts, train, strict=True) if x == learnt]
        stream, starts, ends = coded(mine, depth)
        for at in range(depth, len(stream), CHUNK):
            k, c = _distinct(ctw.grams(stream[at - depth : min(len(stream), at + CHUNK)], depth), learnt)
            gap = (k >> (8 * depth) == 255) & (k & 255 == 255)  # between texts
            keys.append(k[~gap])
            counts.append(c[~gap])
        empty = int((ends - starts == 1).sum())
        if empty:
            keys.append(np.array([fill]))
            counts.append(np.array([empty * learnt]))
    return _sum(np.concatenate(keys), np.concatenate(counts))


def block_words(column: pa.Array, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word hashes (the end's too) with their counts in training texts."""
    tokens, owner = _tokens(column, len(train))
    learnt = train[owner]
    parts = [_distinct(tokens[learnt], True), _distinct(tokens[~learnt], False)]
    return _sum(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _tokens(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word hash and text number of every token."""
    data, offsets = flat(column)
    found: list[np.ndarray] = [np.full(n, END_WORD)]
    owners: list[np.ndarray] = [np.arange(n)]
    at = 0
    while at < n:
        to = min(max(int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1, at + 1), n)
        hashes, _, _, owner = words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        found.append(hashes.view(np.int64))
        owners.append(owner + at)
        at = to
    return np.concatenate(found), np.concatenate(owners)


def gram_buckets(keys: np.ndarray, depth: int, buckets: int) -> np.ndarray:
    """Bucket of each gram, by its two nearest context bytes."""
    return (mix((keys >> (8 * (depth - 1))).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def word_buckets(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _dealt(keys: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, rows) in order of bucket; rows stay in order of key."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for rows in np.split(order, cuts) if len(order) else []:
        yield int(bucket[rows[0]]), rows


ASKED = "kind int, bucket long, block long, keys binary, counts binary"


def _ask(depth: int, buckets: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        column = group.column("text").combine_chunks() if group.num_rows else pa.array([], pa.binary())
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        train = ~group.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        rows: list[tuple] = []
        keys, counts = block_grams(column.to_pylist(), train, depth)
        rows += [(0, b, key[0].as_py(), _gaps(keys[r]), _pack(counts[r])) for b, r in _dealt(keys, gram_buckets(keys, depth, buckets))]
        keys, counts = block_words(column, train)
        rows += [(1, b, key[0].as_py(), _gaps(keys[r]), _pack(counts[r])) for b, r in _dealt(keys, word_buckets(keys, buckets))]
        return pa.table({n: pa.array(v, t) for (n, t), v in zip((("kind", pa.int32()), ("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())), zip(*rows, strict=True), strict=True)})

    return run


def _upper_rows(keys: np.ndarray, counts: np.ndarray, depth: int) -> bytes:
    """Nodes of depth 2 of all decisions: node, zeros, ones, log Pw, packed."""
    out = []
    for k in range(8):
        nodes, zeros, ones, _ = ctw.leaf_nodes(keys, counts, k)
        top = ctw.bottom_up(nodes, zeros, ones, None, k, depth, 2)[0][-1]
        out += [np.array([len(top.keys)], np.int64), top.keys, top.zeros.astype(np.int64), top.ones.astype(np.int64), top.log_pw.view(np.int64)]
    return _pack(np.concatenate(out))


def _read_upper(rows: list[bytes]) -> list[tuple[np.ndarray, ...]]:
    """By decision: nodes of depth 2, sorted, with zeros, ones and log Pw."""
    parts: list[list] = [[] for _ in range(8)]
    for row in rows:
        array, at = _unpack(row), 0
        for k in range(8):
            n = int(array[at])
            parts[k].append(array[at + 1 : at + 1 + 4 * n].reshape(4, n))
            at += 1 + 4 * n
    out = []
    for k in range(8):
        found = np.concatenate([*parts[k], np.zeros((4, 0), np.int64)], axis=1)
        found = found[:, np.argsort(found[0])]
        out.append((found[0], found[1], found[2], found[3].view(np.float64)))
    return out


def shallow_part(upper: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By decision: nodes of depth 2, what depths 0 and 1 give them of the mixture, and the weight left."""
    out = []
    for k, (keys, zeros, ones, log_pw) in enumerate(upper):
        level = ctw.Level.__new__(ctw.Level)
        level.keys, level.zeros, level.ones, level.log_pw = keys, zeros, ones, log_pw
        levels, places = [level], []
        for _ in range(2):
            at = levels[-1]
            above, place, z, o, below = ctw._merge(at.keys >> (8 + k) << k | at.keys & ((1 << k) - 1), at.zeros, at.ones, at.log_pw)
            levels.append(ctw.Level(above, z, o, below))
            places.append(place)
        shallow, left = np.zeros(len(levels[-1].keys)), np.ones(len(levels[-1].keys))
        for upper_level, place in zip(reversed(levels[1:]), reversed(places), strict=True):
            shallow, left = (shallow + left * upper_level.weight * upper_level.p_one)[place], (left * (1 - upper_level.weight))[place]
        out.append((keys, shallow, left))
    return out


def gram_scores(keys: np.ndarray, counts: np.ndarray, upper: list[tuple[np.ndarray, np.ndarray, np.ndarray]], depth: int) -> np.ndarray:
    """log10 of the probability of each gram's byte."""
    out = np.zeros(len(keys))
    for k in range(8):
        nodes, zeros, ones, place = ctw.leaf_nodes(keys, counts, k)
        levels, places = ctw.bottom_up(nodes, zeros, ones, None, k, depth, 2)
        known, shallow, left = upper[k]
        at = np.searchsorted(known, levels[-1].keys)
        p = ctw.top_down(levels, places, shallow[at], left[at])[place]
        out += np.log10(np.where((keys >> (7 - k)) & 1 == 1, p, 1 - p))
    return out


SUMMED = "kind int, bucket long, keys binary, counts binary, upper binary, tokens long, kinds long"


def _add_up(depth: int):
    """Streams rows sorted by kind and bucket; holds the distinct keys of one bucket."""

    def flush(at: tuple[int, int], keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        upper = _upper_rows(keys, counts, depth) if at[0] == 0 else None
        known = counts > 0
        values = [[at[0]], [at[1]], [_gaps(keys)], [_pack(counts)], [upper], [int(counts.sum())], [int(known.sum())]]
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], [c.split()[0] for c in SUMMED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, counts, more, held = None, NOTHING, NOTHING, [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "keys", "counts")), strict=True):
                if row[:2] != at:
                    if at is not None:
                        yield flush(at, *_sum(np.concatenate([keys, *(m[0] for m in more)]), np.concatenate([counts, *(m[1] for m in more)])))
                    at, keys, counts, more, held = row[:2], NOTHING, NOTHING, [], 0
                more.append((_keys(row[2]), _unpack(row[3])))
                held += len(more[-1][0])
                if held > max(1 << 19, len(keys)):
                    keys, counts = _sum(np.concatenate([keys, *(m[0] for m in more)]), np.concatenate([counts, *(m[1] for m in more)]))
                    more, held = [], 0
        if at is not None:
            yield flush(at, *_sum(np.concatenate([keys, *(m[0] for m in more)]), np.concatenate([counts, *(m[1] for m in more)])))

    return run


ANSWERED = "block long, kind int, keys binary, answers binary"


def _answer(upper, depth: int):
    """Streams rows sorted by kind, bucket and block; a bucket's sums (block -1) come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = NOTHING, np.zeros(0)
        for batch in batches:
            out: list[tuple] = []
            for kind, bucket, block, asked, counts in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "block", "keys", "counts")), strict=True):
                if block < 0:
                    keys, values = _keys(asked), _unpack(counts)
                    if kind == 0:
                        values = gram_scores(keys, values, upper.value, depth).astype(np.float32)
                else:
                    out.append((block, kind, asked, _pack(values[np.searchsorted(keys, _keys(asked))])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "kind", "keys", "answers"])

    return run


def _known(answers: pa.Table, kind: int, value: type) -> tuple[Finder, np.ndarray]:
    keys, values = [NOTHING], [np.zeros(0, value)]
    for k, x, y in zip(*(answers.column(c).to_pylist() for c in ("kind", "keys", "answers")), strict=True):
        if k == kind:
            keys.append(_keys(x))
            values.append(_unpack(y, value))
    return Finder(np.concatenate(keys)), np.concatenate(values)


def _score(depth: int, tokens: int, kinds: int):
    total = math.log10(tokens + 0.1 * (kinds + 1))

    def run(key: tuple, group: pa.Table, answers: pa.Table) -> pa.Table:
        column = group.column("text").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        n = group.num_rows
        finder, values = _known(answers, 0, np.float32)
        stream, starts, ends = coded(column.to_pylist(), depth)
        score = np.zeros(n)
        at = 0
        while at < n:  # texts of about CHUNK bytes at a time
            to = min(max(int(np.searchsorted(starts, starts[at] + CHUNK, side="right")), at + 1), n)
            base = starts[at]
            found = values[finder.find(ctw.grams(stream[base - depth : ends[to - 1]], depth))]
            bounds = np.stack([starts[at:to] - base, ends[at:to] - base], axis=1).reshape(-1)
            score[at:to] = np.add.reduceat(np.append(found, np.float32(0)), bounds, dtype=np.float64)[::2]
            at = to
        finder, counts = _known(answers, 1, np.int64)
        token, owner = _tokens(column, n)
        count = counts[finder.find(token)]
        base_score = np.bincount(owner, np.log10(count + 0.1) - total, n)
        n_tokens, n_known = np.bincount(owner, minlength=n), np.bincount(owner, count > 0, n).astype(np.int64)
        n_bytes = ends - starts
        return pa.table({
            "doc_id": group.column("doc_id"), "held_out": group.column("held_out"), "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
            "train_tokens": pa.array(np.full(n, tokens), pa.int64()), "base_score": pa.array(base_score), "score": pa.array(score), "coded_bytes": pa.array(n_bytes, pa.int64()),
            "bits_per_byte": pa.array(-score / math.log10(2) / n_bytes),
        })

    return run


def score(docs: DataFrame, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, coded_bytes and bits_per_byte of every text."""
    spark = docs.sparkSession
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    texts = docs.select("doc_id", held.alias("held_out"), raw("text").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    buckets = max(16, blocks)
    dealt = texts.withColumn("block", F.pmod(F.xxhash64(keyed("doc_id"), "text"), F.lit(blocks)))
    asked = cut(dealt.groupBy("block").applyInArrow(_ask(depth, buckets), ASKED))
    by_bucket = asked.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket")
    sums = cut(by_bucket.mapInArrow(_add_up(depth), SUMMED))
    upper = shallow_part(_read_upper([r.upper for r in sums.where("kind = 0").select("upper").toLocalIterator()]))
    tokens, kinds = sums.where("kind = 1").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    both = sums.select("kind", "bucket", F.lit(-1).cast("long").alias("block"), "keys", "counts").unionByName(asked.select("kind", "bucket", "block", "keys", "counts"))
    answers = both.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", "block").mapInArrow(_answer(spark.sparkContext.broadcast(upper), depth), ANSWERED)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, coded_bytes long, bits_per_byte double"
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(depth, tokens, kinds), schema)


def op5_lm(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"))
