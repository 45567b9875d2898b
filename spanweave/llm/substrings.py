"""Suffix-array dedup: every byte under a string of ``length`` bytes that starts twice.

Texts are dealt into blocks by a hash; each block sorts the suffixes of its
candidate text by induced sorting (see ``suffix``) and finds what repeats
within it from the permuted common prefixes. Blocks are then matched without
bringing their text together:

1. Candidates. Each ``length``-byte window has an anchor, the leftmost least of
   its hashed ``GRAM``-byte strings, which its bytes alone decide. Windows with
   the same anchor form a span. A window can only repeat if its anchor does, so
   text without a repeated anchor is left out of the arrays.
2. Spans. A span whose bytes are in two blocks is repeated as a whole, and one
   fingerprint settles all its windows.
3. Windows. Where an anchor is in several blocks but its spans differ (the ends
   of a shared passage), blocks exchange one fingerprint per distinct window.
   Of a span that is settled, one block takes part, for the others' sake.

All exchanges go by bucket of key, with one row for each batch and bucket or
block and bucket, and count blocks, not occurrences: a passage in a third of
all texts costs each block as much as any other. Rows exchanged are at most
blocks times buckets and at most one for each key. Fingerprints have 64 bits.

Defined cases: a null text is empty; texts shorter than ``length`` lose
nothing; a text longer than a block is in one block with others, which one task
holds; null or repeated doc_ids and equal rows are separate texts (equal
texts of ``length`` bytes and more lose everything); other columns are ignored
or, in ``clean``, kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import BASE, INVERSE, flat, mix, powers, prefix_hash, slices, spans
from .shared import cut, keyed, raw, table
from .suffix import repeated

LENGTH = 200
GRAM = 64
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 12 << 20
PAYLOAD_LEVEL = 5  # of texts that wait: they are written and dealt once more
PLACE = 34
SLICE = 1 << 19
NOTHING = np.zeros(0, np.int64)


def _sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, from running minima of blocks, forward and backward."""
    n = len(key) - width + 1
    padded = np.full(-(-len(key) // width) * width, np.iinfo(np.int64).max)
    padded[: len(key)] = key
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


class Spans:
    """Runs of window starts (first .. last) with one anchor, its hash and the fingerprint of the run's bytes."""

    def __init__(self, first, last, anchor, print_):
        self.first, self.last, self.anchor, self.print = first, last, anchor, print_


def find_spans(data: np.ndarray, offsets: np.ndarray, length: int) -> Spans:
    """Spans of texts that lie one after the other; windows don't cross texts."""
    parts: list[tuple] = []
    n, at = len(offsets) - 1, 0
    gram = min(GRAM, length)
    while at < n:
        to = min(max(int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1, at + 1), n)
        base, own = offsets[at], offsets[at : to + 1] - offsets[at]
        part, at = data[offsets[at] : offsets[to]], to
        if len(part) < length:
            continue
        prefix = prefix_hash(part)
        starts = len(part) - gram + 1
        hashes = mix((prefix[gram:] - prefix[:-gram]) * powers(INVERSE, starts))
        key = (hashes >> np.uint64(PLACE)).astype(np.int64) << PLACE | np.arange(starts)
        place = _sliding_least(key, length - gram + 1) & ((1 << PLACE) - 1)
        valid = np.zeros(len(place) + 1, np.int8)
        long_ = np.flatnonzero(np.diff(own) >= length)
        np.add.at(valid, own[long_], 1)
        np.add.at(valid, own[long_ + 1] - length + 1, -1)
        valid = np.cumsum(valid[:-1], dtype=np.int8).astype(bool)
        turn = np.ones(len(place) + 1, bool)
        turn[1:-1] = (place[1:] != place[:-1]) | ~valid[:-1]
        begins = np.flatnonzero(turn[:-1] & valid)
        stop = np.flatnonzero(valid & np.append(turn[1:-1] | ~valid[1:], True))
        ends = stop + length
        prints = mix((prefix[ends] - prefix[begins]) * powers(INVERSE, len(prefix))[begins] + ends.astype(np.uint64) - begins.astype(np.uint64))
        parts.append((begins + base, stop + base, hashes[place[begins]], prints))
    if not parts:
        return Spans(NOTHING, NOTHING, NOTHING.view(np.uint64), NOTHING.view(np.uint64))
    return Spans(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def window_prints(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints of the windows at the given starts (in order), a slice of the data at a time."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = int(np.searchsorted(starts, base + SLICE))
        prefix = prefix_hash(data[base : starts[to - 1] + length])
        mine = starts[at:to] - base
        out[at:to] = mix((prefix[mine + length] - prefix[mine]) * powers(INVERSE, len(prefix))[mine])
        at = to
    return out


def _pack(array: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(array).tobytes(), 1)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def _gaps(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


def _by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, rows), rows in order of key. Buckets are ranges of hashes, so sorted keys stay sorted."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order].astype(np.int64))) + 1
    for rows in np.split(order, cuts) if len(order) else []:
        yield int(bucket[rows[0]]), rows


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


ANCHORS, SPANS = 0, 1
ASKED = "kind int, bucket int, keys binary, blocks binary, counts binary, low binary, high binary"


def _ask(length: int, buckets: int):
    """Distinct (anchor, block) and (span, block) of each batch, a row for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=4 * SLICE):
                data, offsets = flat(part.column("text"))
                found = find_spans(data, offsets, length)
                block = part.column("block").to_numpy().astype(np.int32)[np.searchsorted(offsets, found.first, side="right") - 1]
                rows = []
                order = np.lexsort((block, found.anchor))
                key, own, low = found.anchor[order], block[order], (found.print[order] >> np.uint64(32)).astype(np.uint32)
                first = _firsts(key, own)
                if len(first):
                    counts = np.minimum(2, np.diff(np.append(first, len(key)))).astype(np.uint8)
                    least, most = np.minimum.reduceat(low, first), np.maximum.reduceat(low, first)
                    key, own = key[first], own[first]
                    rows += [(ANCHORS, b, _gaps(key[r]), _pack(own[r]), _pack(counts[r]), _pack(least[r]), _pack(most[r] - least[r])) for b, r in _by_bucket(key, buckets)]
                    key = mix(found.print + found.anchor * np.uint64(BASE))
                    order = np.lexsort((block, key))
                    key, own = key[order], block[order]
                    first = _firsts(key, own)
                    key, own = key[first], own[first]
                    rows += [(SPANS, b, _gaps(key[r]), _pack(own[r]), None, None, None) for b, r in _by_bucket(key, buckets)]
                    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 5)
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["kind", "bucket", "keys", "blocks", "counts", "low", "high"])

    return run


ANSWERED = "block long, kind int, keys binary, codes binary"
SHARED, CROSS, VARIED = 1, 2, 4
SETTLED, CHOSEN = 1, 2


def _meet(key: tuple, group: pa.Table) -> pa.Table:
    """Tells each block which of its anchors and spans are elsewhere too."""
    anchors = key[0].as_py() == ANCHORS
    columns = [[_keys(x) for x in group.column("keys").to_pylist()], [_unpack(x, np.int32) for x in group.column("blocks").to_pylist()]]
    keys, blocks = (np.concatenate(c) for c in columns)
    order = np.lexsort((blocks, keys))
    keys, blocks = keys[order], blocks[order]
    first = _firsts(keys)
    place = np.cumsum(np.isin(np.arange(len(keys)), first, assume_unique=True)) - 1
    several = np.maximum.reduceat(blocks, first) != np.minimum.reduceat(blocks, first)
    if anchors:
        counts = np.concatenate([_unpack(x, np.uint8) for x in group.column("counts").to_pylist()])[order]
        low = np.concatenate([_unpack(x, np.uint32) for x in group.column("low").to_pylist()])[order]
        high = np.concatenate([_unpack(x, np.uint32) for x in group.column("high").to_pylist()])[order] + low
        varied = np.minimum.reduceat(low, first) != np.maximum.reduceat(high, first)
        shared = np.add.reduceat(counts.astype(np.int64), first) > 1
        codes = (shared * SHARED + several * CROSS + varied * VARIED)[place]
        told = shared[place]
    else:
        chosen = np.zeros(len(keys), bool)
        chosen = blocks == np.minimum.reduceat(blocks, first)[place]
        codes, told = SETTLED + CHOSEN * chosen, several[place]
    keys, blocks, codes = keys[told], blocks[told], codes[told].astype(np.uint8)
    order = np.lexsort((keys, blocks))
    keys, blocks, codes = keys[order], blocks[order], codes[order]
    first = _firsts(keys, blocks)  # the same pair may come from several batches
    keys, blocks, codes = keys[first], blocks[first], codes[first]
    rows = np.split(np.arange(len(keys)), np.flatnonzero(np.diff(blocks)) + 1) if len(keys) else []
    return pa.table({
        "block": pa.array([int(blocks[r[0]]) for r in rows], pa.int64()), "kind": pa.array([key[0].as_py()] * len(rows), pa.int32()),
        "keys": pa.array([_gaps(keys[r]) for r in rows], pa.binary()), "codes": pa.array([_pack(codes[r]) for r in rows], pa.binary()),
    })


def _told(answers: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    keys, codes = [NOTHING.view(np.uint64)], [np.zeros(0, np.uint8)]
    for k, x, y in zip(*(answers.column(c).to_pylist() for c in ("kind", "keys", "codes")), strict=True):
        if k == kind:
            keys.append(_keys(x))
            codes.append(_unpack(y, np.uint8))
    keys, codes = np.concatenate(keys), np.concatenate(codes)
    order = np.argsort(keys)
    return keys[order], codes[order]


def _lookup(table_: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    known, codes = table_
    if not len(known):
        return np.zeros(len(keys), np.uint8)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, codes[at], 0).astype(np.uint8)


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers of the ranges first .. last."""
    sizes = last - first + 1
    if not len(sizes):
        return NOTHING
    return np.arange(sizes.sum()) + np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)


def in_block(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """Starts of windows of the given spans that repeat within the data, by suffix array."""
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, last + length, -1)
    begins, ends = spans(np.cumsum(edge[:-1]) > 0, offsets)
    if not len(begins):
        return NOTHING
    sizes = ends - begins + 1  # with a separator
    text = np.ones(sizes.sum() + 1, np.uint16)
    where = np.full(len(text), -1, np.int64)
    inner = _ranges(np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.cumsum(sizes) - 2)
    where[inner] = _ranges(begins, ends - 1)
    text[inner] = data[where[inner]].astype(np.uint16) + 2
    text[-1] = 0
    twice = repeated(text, length)
    whole = np.zeros(len(text), bool)
    whole[_ranges(np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.cumsum(sizes) - 1 - length)] = True
    return where[twice & whole]


def _resolve(length: int, buckets: int, want_text: bool, names: list[str], schema: pa.Schema):
    """A block's windows: repeated here, settled by spans, or asked for."""

    def run(key: tuple, group: pa.Table, answers: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        data, offsets = flat(_column(group, "bytes"))
        found = find_spans(data, offsets, length)
        code = _lookup(_told(answers, ANCHORS), found.anchor)
        shared = code > 0
        first, last, code = found.first[shared], found.last[shared], code[shared]
        span = _lookup(_told(answers, SPANS), mix(found.print[shared] + found.anchor[shared] * np.uint64(BASE)))
        here = in_block(data, offsets, first, last, length)
        hit = np.zeros(len(data) + 1, bool)
        hit[here] = True
        settled = span & SETTLED > 0
        hit[_ranges(first[settled], last[settled])] = True
        asks = (code & CROSS > 0) & (~settled | ((span & CHOSEN > 0) & (code & VARIED > 0)))
        starts = _ranges(first[asks], last[asks])
        prints = window_prints(data, starts, length) if len(starts) else NOTHING.view(np.uint64)
        prints, at = np.unique(prints, return_index=True)
        starts = np.where(hit[starts[at]], -1, starts[at])
        rows, order = [], []
        for b, r in _by_bucket(prints, buckets):
            rows.append({"kind": 3, "bucket": b, "keys": _gaps(prints[r])})
            order.append(starts[r])
        # Texts with a window that repeats or is asked for wait for the answers; the others are done.
        waits = np.zeros(len(offsets) - 1, bool)
        touched = np.concatenate([np.flatnonzero(hit), starts[starts >= 0]])
        waits[np.searchsorted(offsets, touched, side="right") - 1] = True
        if want_text:
            waits[:] = True
        mine = np.flatnonzero(waits)
        moved = np.full(len(data) + 1, -1, np.int64)
        held = _ranges(offsets[mine], offsets[mine + 1] - 1)
        moved[held] = np.arange(len(held))
        if len(mine):
            hits = np.flatnonzero(hit[:-1][held])
            asked = np.concatenate([NOTHING, *order])
            asked = np.where(asked >= 0, moved[asked], -1)
            buffer = io.BytesIO()
            with pa.ipc.new_stream(buffer, group.schema) as out:
                out.write_table(group.take(pa.array(mine)))
            rows.append({"kind": 4, "keys": zstandard.compress(buffer.getvalue(), PAYLOAD_LEVEL), "hits": _pack(np.diff(hits, prepend=0)), "asked": _pack(asked)})
        done = np.flatnonzero(~waits)
        block = key[0].as_py()
        out = pa.Table.from_pylist([{"block": block} | r for r in rows], schema=PARTS)
        out = _widen(out, schema)
        if len(done):
            kept = _finish(group.take(pa.array(done)), np.zeros(0, np.int64), length, want_text, names)
            out = pa.concat_tables([out, _widen(kept.append_column("block", pa.array(np.full(len(done), block))).append_column("kind", pa.array(np.full(len(done), 2, np.int32))), schema)])
        return out

    return run


PARTS = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("hits", pa.binary()), ("asked", pa.binary())])


def _column(group: pa.Table, name: str) -> pa.Array:
    found = group.column(name).combine_chunks()
    return found.chunk(0) if isinstance(found, pa.ChunkedArray) else found


def _widen(found: pa.Table, schema: pa.Schema) -> pa.Table:
    return pa.table([found.column(f.name).cast(f.type) if f.name in found.column_names else pa.nulls(found.num_rows, f.type) for f in schema], schema=schema)


def _finish(group: pa.Table, hits: np.ndarray, length: int, want_text: bool, names: list[str]) -> pa.Table:
    """Result rows of texts in which the given windows repeat."""
    data, offsets = flat(_column(group, "bytes"))
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, hits, 1)
    np.add.at(edge, hits + length, -1)
    gone = np.cumsum(edge[:-1]) > 0
    begins, ends = spans(gone, offsets)
    n = len(offsets) - 1
    owner = np.searchsorted(offsets, begins, side="right") - 1
    n_spans, n_removed = np.bincount(owner, minlength=n), np.bincount(owner, ends - begins, n).astype(np.int64)
    kept = data[~gone].tobytes()
    at = np.concatenate([[0], np.cumsum(np.diff(offsets) - n_removed)]).tolist()
    rest = [kept[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    columns = {name: group.column(name) for name in names}
    columns |= {"n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(n_removed), "n_spans": pa.array(n_spans, pa.int64())}
    if want_text:
        columns["kept"] = pa.array([x.decode("utf-8", "ignore").encode() if k else x for x, k in zip(rest, n_removed.tolist(), strict=True)], pa.binary())
    else:
        columns["kept_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in rest])
    return pa.table(columns)


def _match(key: tuple, group: pa.Table) -> pa.Table:
    """Tells each block which of the windows it asked for are in another block."""
    keys = [_keys(x) for x in group.column("keys").to_pylist()]
    blocks = group.column("block").to_numpy()
    every = np.concatenate(keys)
    owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    order = np.argsort(every, kind="stable")
    first = _firsts(every[order])
    size = np.diff(np.append(first, len(every)))
    twice = np.empty(len(every), bool)
    twice[order] = np.repeat(size > 1, size)  # a block asks for a window once
    del owner
    ends = np.cumsum([0, *map(len, keys)])
    return pa.table({
        "block": pa.array(blocks), "bucket": pa.array([key[0].as_py()] * len(keys), pa.int32()),
        "answer": pa.array([_pack(np.packbits(twice[a:b])) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
        "asked": pa.array([len(k) for k in keys], pa.int32()),
    })


def _conclude(length: int, want_text: bool, names: list[str], schema: pa.Schema):
    def run(key: tuple, group: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for texts, hits, asked in zip(*(group.column(c).to_pylist() for c in ("keys", "hits", "asked")), strict=True):
            found = pa.ipc.open_stream(zstandard.decompress(texts)).read_all()
            starts, place = _unpack(asked, np.int64), np.cumsum(_unpack(hits, np.int64))
            order = np.argsort(answers.column("bucket").to_numpy())
            said = [np.unpackbits(_unpack(a, np.uint8), count=n) for a, n in zip((answers.column("answer").to_pylist()[i] for i in order), (answers.column("asked").to_pylist()[i] for i in order), strict=True)]
            yes = np.concatenate([np.zeros(0, np.uint8), *said]).astype(bool)
            more = starts[yes]
            out.append(_widen(_finish(found.combine_chunks(), np.unique(np.concatenate([place, more[more >= 0]])), length, want_text, names), schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def _run(docs: DataFrame, length: int, want_text: bool, block_bytes: int) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [c for c in docs.columns if c != "text"] if want_text else ["doc_id"]
    source = docs.select(*[F.col(f"`{c}`") for c in names], raw("text").alias("bytes"))
    size = source.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    buckets = max(8, -(-size // BUCKET_BYTES))
    block = F.pmod(F.xxhash64(keyed("doc_id"), "bytes"), F.lit(blocks))
    dealt = source.withColumn("block", block)
    asked = dealt.select(F.col("bytes").alias("text"), "block").mapInArrow(_ask(length, buckets), ASKED)
    answers = asked.groupBy("kind", "bucket").applyInArrow(_meet, ANSWERED)
    result = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in names), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType()) if want_text else T.StructField("kept_sha256", T.StringType())])
    rows = T.StructType([T.StructField(f.name, {"int64": T.LongType(), "int32": T.IntegerType(), "binary": T.BinaryType()}[str(f.type)]) for f in PARTS] + [T.StructField(f"r_{f.name}", f.dataType) for f in result])
    inner = to_arrow_schema(rows)
    plain = to_arrow_schema(result)
    resolve = _resolve(length, buckets, want_text, names, pa.schema([*PARTS, *plain]))

    def resolved(key: tuple, group: pa.Table, told: pa.Table) -> pa.Table:
        return resolve(key, group, told).rename_columns(inner.names)

    parts = cut(dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(resolved, rows))
    matched = parts.where("kind = 3").select("block", "bucket", "keys").groupBy("bucket").applyInArrow(_match, "block long, bucket int, answer binary, asked int")
    waiting = parts.where("kind = 4").select("block", "keys", "hits", "asked")
    late = waiting.groupBy("block").cogroup(matched.groupBy("block")).applyInArrow(_conclude(length, want_text, names, plain), result)
    return parts.where("kind = 2").select(*(F.col(f"`r_{c}`").alias(c) for c in result.names)).unionByName(late)


def digests(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every text."""
    return _run(docs, length, False, block_bytes)


def clean(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of ``docs`` with repeated strings taken out of ``text``.

    Characters cut in two go; a text that loses everything goes as a row; a
    column n_chars, if there is one, is counted anew.
    """
    rest = [c for c in docs.columns if c != "text"]
    inner = {c: f"_c{k}" for k, c in enumerate(rest)}  # the columns' own names may be in use inside
    marked = docs.select("doc_id", "text", F.col("text").isNull().alias("_null"), *[F.col(f"`{c}`").alias(x) for c, x in inner.items()])
    found = _run(marked, length, True, block_bytes).where("n_removed = 0 or n_removed < n_bytes")
    columns = {c: F.col(x) for c, x in inner.items()} | {"text": F.when(~F.col("_null"), F.col("kept").cast("string"))}
    if "n_chars" in rest:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length(F.col("kept").cast("string"))).otherwise(columns["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return found.select(*[columns[c].alias(c) for c in docs.columns])


def op1_substrings(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"))
