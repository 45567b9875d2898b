"""Collocations: frequent phrases by positional inverted lists, scored by their weakest cut.

Texts of one language are indexed in blocks: a block holds, word by word, the
sorted positions of its occurrences; a position is skipped between pieces and
between texts, so words are adjacent where positions are. All blocks of a
language add up the lengths of their lists, which gives exact frequencies;
lists of phrases under ``least`` are dropped. A phrase of k + 1 words occurs
where its first k words begin and its last k begin one position later, that
is, where the next word's postings meet the end of the phrase: so the lists of
the frequent phrases of k words are merge-joined with themselves, one position
on, and the lengths of the new lists are added up again.

Between levels blocks and the frequent phrases are Parquet tables in the
shared folder; those of a level go when the next one's lists are written, and
only a row for each frequent phrase stays. A phrase is named by its first slot (block and number within
it), so names are exact and need no counter. A block asks one row for each
candidate it holds, however often.

Scores are exact decimals of 38 digits: 1000 * a * n must have no more, which
holds for n up to 10**17.

Defined cases: a null text is an empty one, a null lang is ``und`` and one
language with it; doc_id is not used, equal rows count each. Ties of score
and frequency are ordered by the phrase's bytes. Other columns are ignored,
whatever their names; an empty table gives an empty result. A task holds a
block of BLOCK_BYTES of text, or one text if that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import LOWER, flat, spans
from .shared import discard, raw, table, written

LONGEST, LEAST, COVER_PERCENT, BEST = 5, 100, 100, 2000
BLOCK_BYTES = 1 << 23
#: A slot is a block's number and one of up to 2**SLOT candidates; a block's number is its task's and one of 2**SEQUENCE.
SLOT, SEQUENCE = 28, 14

GAP = np.zeros(256, dtype=bool)
GAP[[0x20, 9]] = True
BREAK = np.zeros(256, dtype=bool)
BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True


def packed(numbers: np.ndarray) -> bytes:
    """Differences of 32-bit numbers, low bytes first together, compressed."""
    steps = np.diff(numbers.astype(np.int32), prepend=np.int32(0))
    return pa.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True) if len(steps) else b""


def unpacked(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int32)
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int32).ravel(), dtype=np.int32)


def word_lists(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the lengths of their lists, and the lists of positions one after another."""
    lower = LOWER[data]
    inside = ~(GAP | BREAK)[lower]
    starts, ends = spans(inside, offsets)
    lengths = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=lengths[1:])
    bare = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(lengths), pa.py_buffer(lower[inside])])
    coded = bare.dictionary_encode()
    breaks = np.zeros(len(data) + 1, np.int32)
    np.cumsum(BREAK[lower], out=breaks[1:])
    text = np.searchsorted(offsets, starts, side="right")
    apart = np.zeros(len(starts), bool)
    apart[1:] = (text[1:] != text[:-1]) | (breaks[starts[1:]] != breaks[ends[:-1]])
    positions = np.arange(len(starts)) + np.cumsum(apart)
    codes = coded.indices.to_numpy()
    return coded.dictionary, np.bincount(codes, minlength=len(coded.dictionary)), positions[np.argsort(codes, kind="stable")]


def extended(lengths: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merge-join of lists with themselves one position on: pairs of lists, and the joined lists."""
    order = np.argsort(positions)
    at, which = positions[order], np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)[order]
    near = np.flatnonzero(np.diff(at) == 1)
    pair = which[near] * len(lengths) + which[near + 1]
    by_pair = np.argsort(pair, kind="stable")
    first = np.flatnonzero(np.diff(pair[by_pair], prepend=-1))
    found = pair[by_pair[first]]
    n = max(1, len(lengths))
    return found // n, found % n, np.diff(np.append(first, len(pair))), at[near][by_pair]


def chosen(lengths: np.ndarray, positions: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists of the numbers ``keep``, which ascend."""
    held = np.zeros(len(lengths), bool)
    held[keep] = True
    return lengths[keep], positions[np.repeat(held, lengths)]


INDEX = "block long, lang string, words array<string>, lengths binary, size int, positions binary"


def _indexer(block_bytes: int):
    def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of the texts of each language, in the order in which they come."""
        waiting: dict[str, list[pa.Array]] = {}
        sizes: dict[str, int] = {}
        block = TaskContext.get().partitionId() << SEQUENCE
        last = block + (1 << SEQUENCE)

        def flush(lang: str) -> pa.RecordBatch:
            nonlocal block
            if block == last:
                raise ValueError("a task has too many blocks: use more partitions")
            words, lengths, positions = word_lists(*flat(pa.concat_arrays(waiting.pop(lang))))
            sizes.pop(lang)
            row = [pa.array([block]), pa.array([lang]), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.large_string()).cast(pa.string())), pa.array([packed(lengths)], pa.binary()), pa.array([len(positions)], pa.int32()), pa.array([packed(positions)], pa.binary())]
            block += 1
            return pa.RecordBatch.from_arrays(row, [c.split()[0] for c in INDEX.split(", ")])

        for batch in batches:
            text = batch.column("text").cast(pa.large_binary())
            langs = batch.column("lang").dictionary_encode()
            codes = langs.indices.to_numpy()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                mine = np.flatnonzero(codes == code)
                cost = np.cumsum(np.diff(flat(text)[1])[mine])
                at = 0
                while at < len(mine):
                    used = sizes.get(lang, 0)
                    base = cost[at - 1] if at else 0
                    to = int(np.searchsorted(cost, base + block_bytes - used, side="right"))
                    to = max(to, at if used else at + 1)
                    if to > at:
                        waiting.setdefault(lang, []).append(text.take(pa.array(mine[at:to])))
                        sizes[lang] = used + int(cost[to - 1] - base)
                    if to < len(mine):
                        yield flush(lang)
                    at = to
            while sum(sizes.values()) > 2 * block_bytes:
                yield flush(max(sizes, key=sizes.__getitem__))
        for lang in list(waiting):
            yield flush(lang)

    return _index


def index(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Positional inverted lists of all words, a row for each block of a language."""
    given = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), raw("text").alias("text"))
    return given.mapInArrow(_indexer(block_bytes), INDEX)


def _slot(block: int, n: int) -> np.ndarray:
    if n >> SLOT:
        raise ValueError("a block has too many phrases: use smaller texts or blocks")
    return (block << SLOT) + np.arange(n)


def _ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            words = batch.column("words").slice(row, 1).flatten()
            n = unpacked(batch.column("lengths")[row].as_py(), len(words))
            lang = pa.array([batch.column("lang")[row].as_py()]).take(pa.array(np.zeros(len(words), np.int8)))
            yield pa.RecordBatch.from_arrays([pa.array(_slot(batch.column("block")[row].as_py(), len(words))), lang, words, pa.array(n)], ["slot", "lang", "word", "n"])


def _ask_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            count = batch.column("count")[row].as_py()
            ids = batch.column("ids").slice(row, 1).flatten().to_numpy()
            left, right, n = (unpacked(batch.column(c)[row].as_py(), count) for c in ("lefts", "rights", "lengths"))
            yield pa.RecordBatch.from_arrays([pa.array(_slot(batch.column("block")[row].as_py(), count)), pa.array(ids[left]), pa.array(ids[right]), pa.array(n)], ["slot", "left", "right", "n"])


def _frequent(asks: DataFrame, least: int, *keys: str) -> DataFrame:
    """Rows of the phrases with ``least`` occurrences in all blocks together, with these and the phrase's name.

    The rows of a phrase are one a block that holds it.
    """
    of = Window.partitionBy(*keys)
    return asks.select("slot", *keys, F.sum("n").over(of).alias("f"), F.min("slot").over(of).alias("id")).where(F.col("f") >= least)


PAIRS = "block long, ids array<long>, lefts binary, rights binary, lengths binary, count int, size int, positions binary"


def _joined(state: pa.Table, told: pa.Table, last: bool) -> pa.Table:
    """The lists of a block, those of its frequent phrases kept and joined; of the ``last`` level only their lengths."""
    out = [c.split()[0] for c in PAIRS.split(", ")]
    if not state.num_rows or not told.num_rows:
        return pa.table({"block": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), **{c: pa.array([], pa.int32() if c in ("count", "size") else pa.binary()) for c in out[2:]}})
    row = state.to_pylist()[0]
    order = np.argsort(told.column("slot").to_numpy())
    keep = told.column("slot").to_numpy()[order] & ((1 << SLOT) - 1)
    ids = told.column("id").to_numpy()[order]
    lengths, positions = chosen(unpacked(row["lengths"], row["count"]), unpacked(row["positions"], row["size"]), keep)
    left, right, n, at = extended(lengths, positions)
    if last:
        at = at[:0]
    values = [[row["block"]], [ids], [packed(left)], [packed(right)], [packed(n)], [len(n)], [len(at)], [packed(at)]]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]
    return pa.table([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=out)


def _extend(state: pa.Table, told: pa.Table) -> pa.Table:
    return _joined(state, told, last=False)


def _extend_last(state: pa.Table, told: pa.Table) -> pa.Table:
    return _joined(state, told, last=True)


def _levels(docs: DataFrame, least: int, longest: int, block_bytes: int) -> tuple[DataFrame, list[DataFrame]]:
    """All words by language, and the frequent phrases of 1 to ``longest`` words: id, f, and left, right or lang, word."""
    state = written(index(docs, block_bytes), "phrases")
    sizes = written(state.groupBy("lang").agg(F.sum("size").alias("n")), "phrases")
    asks = state.select("block", "lang", "words", "lengths").mapInArrow(_ask_words, "slot long, lang string, word string, n int")
    told = written(_frequent(asks, least, "lang", "word"), "phrases")
    names = lambda: written(told.where("slot = id").drop("slot"), "phrases")
    levels = [names()]
    lists = state.select("block", "lengths", F.size("words").alias("count"), "size", "positions")
    for k in range(2, longest + 1):
        answers = told.select(F.shiftright("slot", SLOT).alias("block"), "slot", "id")
        new = written(lists.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_extend if k < longest else _extend_last, PAIRS), "phrases")
        discard(state)
        discard(told)
        state = new
        asks = state.select("block", "ids", "lefts", "rights", "lengths", "count").mapInArrow(_ask_pairs, "slot long, left long, right long, n int")
        told = written(_frequent(asks, least, "left", "right"), "phrases")
        levels.append(names())
        lists = state.select("block", "lengths", "count", "size", "positions")
    discard(state)
    discard(told)
    return sizes, levels


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Words by language (lang, n), and every phrase of 1 to ``longest`` words with ``least`` occurrences or more.

    Columns of the second: level, id, lang, phrase, f, covered (the greatest f
    of a phrase of one more word that holds it, or null), and heads and tails
    (f of its first and of its last 1, 2, .. words).
    """
    sizes, levels = _levels(docs, least, longest, block_bytes)
    whole = levels[0].select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.array("f").alias("heads"), F.array("f").alias("tails"))
    out = []
    for k, level in enumerate(levels):
        if k:
            left = whole.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("begin"), "heads")
            right = whole.select(F.col("id").alias("right"), "last", "tails")
            whole = written(level.join(left, "left").join(right, "right").select("id", "lang", F.concat_ws(" ", "begin", "last").alias("phrase"), "last", "f", F.concat("heads", F.array("f")).alias("heads"), F.concat("tails", F.array("f")).alias("tails")), "phrases")
        longer = levels[k + 1] if k + 1 < len(levels) else level.limit(0).select("id", F.lit(0).cast("long").alias("left"), F.lit(0).cast("long").alias("right"), "f")
        ends = longer.select(F.col("left").alias("id"), "f").unionByName(longer.select(F.col("right").alias("id"), "f"))
        cover = ends.groupBy("id").agg(F.max("f").alias("covered"))
        out.append(whole.join(cover, "id", "left").select(F.lit(k + 1).alias("level"), "id", "lang", "phrase", "f", "covered", "heads", "tails"))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return sizes, found


def cut_score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)), exactly.

    A quotient of decimals is rounded; less the remainder, there is nothing to round.
    """
    whole = lambda x: x.cast("decimal(17,0)")
    over, under = F.lit(1000).cast("decimal(4,0)") * whole(a) * whole(n), whole(left) * whole(right)
    return ((over - over % under) / under).cast("decimal(38,0)")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, cover_percent: int = COVER_PERCENT, best: int = BEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``best`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase goes if a longer frequent one holds it with ``cover_percent`` of
    its occurrences; of the longer ones those of one more word tell this, as
    they have the most occurrences.
    """
    sizes, found = frequent_phrases(docs, least, longest, block_bytes)
    kept = found.where((F.col("level") > 1) & (F.col("covered").isNull() | (100 * F.col("covered") < cover_percent * F.col("f")))).join(sizes, "lang")
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "n", "heads", "tails", F.explode(F.sequence(F.lit(1), F.col("level") - 1)).alias("k"), "level")
    parts = cuts.select("lang", "phrase", "a", "n", "k", F.expr("heads[k - 1]").alias("l"), F.expr("tails[level - k - 1]").alias("r"))
    scored = parts.withColumn("score", cut_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    weakest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    flat_rows = weakest.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    ranked = flat_rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op13_phrases(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH pieces AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
numbered AS (SELECT row_number() OVER () AS p, lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w)) AS n FROM numbered GROUP BY lang),
words AS (SELECT p, lang, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM numbered),
runs AS (SELECT lang, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c, lead(a, 3) OVER o AS d, lead(a, 4) OVER o AS e FROM words WINDOW o AS (PARTITION BY p ORDER BY i)),
grams AS (SELECT lang, 1 AS m, a AS phrase FROM runs UNION ALL SELECT lang, 2, a || ' ' || b FROM runs WHERE b IS NOT NULL UNION ALL SELECT lang, 3, a || ' ' || b || ' ' || c FROM runs WHERE c IS NOT NULL
    UNION ALL SELECT lang, 4, a || ' ' || b || ' ' || c || ' ' || d FROM runs WHERE d IS NOT NULL UNION ALL SELECT lang, 5, a || ' ' || b || ' ' || c || ' ' || d || ' ' || e FROM runs WHERE e IS NOT NULL),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
long AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
inner_parts AS (SELECT lang, f, array_to_string(w[s.s:s.s + k.k - 1], ' ') AS phrase FROM long, (VALUES (1), (2), (3), (4)) s(s), (VALUES (2), (3), (4)) k(k) WHERE k.k < m AND s.s + k.k - 1 <= m),
covered AS (SELECT DISTINCT i.lang, i.phrase FROM inner_parts i JOIN f b ON b.lang = i.lang AND b.phrase = i.phrase WHERE 100 * i.f >= 100 * b.f),
cuts AS (SELECT c.lang, c.phrase, c.f AS a, k.k, l.f AS l, r.f AS r FROM long c JOIN (VALUES (1), (2), (3), (4)) k(k) ON k.k < c.m JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k.k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k.k + 1:c.m], ' ')),
scored AS (SELECT lang, phrase, a, k, l, r, n, (1000::HUGEINT * a::HUGEINT * n::HUGEINT) // (l::HUGEINT * r::HUGEINT) AS score FROM cuts JOIN sizes USING (lang)),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM weakest ANTI JOIN covered USING (lang, phrase))
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
