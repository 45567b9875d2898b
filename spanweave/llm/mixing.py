"""Mixing sources to target weights by pivotal dependent rounding.

Native: only DataFrame functions run on the data.

Every document of a source should be taken ``x = target / source_size`` times,
a number from 0 to 2. The whole part is taken outright. The fractions are
rounded by the pivotal method, in words: of two documents, one hands words of
its expected share to the other until one of them is integral; which one gives
is drawn so that neither's expectation changes. The words expected of the pair
stay the same at each step. The pairings form a tree: documents fall in chunks by a
hash, each chunk is folded (large documents first) to one fractional document
at most, and these residuals are chunked again, until a source has one chunk.
The last fraction of a source goes to the nearer whole number, so its words
miss the target by half a document at most.

Defined cases: a null text has size 0 and is never taken; a null source is a
source of its own, ranked last; null and repeated doc_ids are told apart by
their texts; equal rows are separate documents, numbered, each with draws of its own; an empty table gives an empty result;
further columns of the input are ignored. If all texts are empty, nothing is
taken and every target is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, keyed, unit

WORD = r"[^\x20\x09-\x0D]+"
FAN_IN = 48
RUN = 1 << 12
NEAR = 1e-12


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and a hash of the text (of equal rows: and of the row's number) of each document."""
    count = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0))
    found = docs.select("doc_id", F.col("source").cast("string").alias("source"), count.cast("long").alias("size"), F.xxhash64("text").alias("mark"))
    # Equal rows are counted and numbered, so that a chunk holds no more of them than of others.
    runs = F.sequence(F.lit(0).cast("long"), F.col("equal") - 1, F.lit(RUN).cast("long"))
    counted = found.groupBy("doc_id", "source", "size", "mark").agg(F.count("*").alias("equal")).withColumn("run", F.explode(runs))
    each = counted.withColumn("number", F.explode(F.sequence("run", F.least(F.col("run") + RUN, F.col("equal")) - 1)))
    return each.select("doc_id", "source", "size", F.when(F.col("number") == 0, F.col("mark")).otherwise(F.xxhash64("mark", "number")).alias("mark"))


def targets(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Per source: source_size, documents, target.

    Sources in code point order (null last) take the weights in turn. Water
    filling has a closed form: with sources ordered by the level at which they
    are full, ``most * size / weight``, the first k are full where the level
    that the others would reach lies below the next one's own.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    per = per.withColumn("weight", turn.cast("double")).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    per = per.withColumn("full_at", F.col("cap") / F.col("weight"))
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / open_weight)
    # The first row (by level) that is not full fixes the level of all after it.
    stands = F.when(F.col("level") < F.col("full_at"), F.col("level"))
    level = F.first(stands, ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("cap"), F.coalesce(level, F.col("full_at")) * F.col("weight"))
    return per.select("source", "source_size", "documents", target.alias("target"))


def _step(left: Column, right: Column) -> Column:
    """One pivotal exchange: both items with their new fractions; ``left`` is the residual so far."""
    give = F.least(left.p * left.size, (1.0 - right.p) * right.size)
    get = F.least((1.0 - left.p) * left.size, right.p * right.size)
    gives = right.u * (give + get) < get
    moved = F.when(gives, give).otherwise(-get)

    def settle(p: Column) -> Column:
        return F.when(p < NEAR, F.lit(0.0)).when(p > 1.0 - NEAR, F.lit(1.0)).otherwise(p)

    # The side that reaches its bound is set to it exactly; rounding may not leave it short.
    left_full = F.when(gives, left.p * left.size <= (1.0 - right.p) * right.size).otherwise((1.0 - left.p) * left.size <= right.p * right.size)
    right_full = F.when(gives, left.p * left.size >= (1.0 - right.p) * right.size).otherwise((1.0 - left.p) * left.size >= right.p * right.size)
    new_left = F.when(left_full, F.when(gives, 0.0).otherwise(1.0)).otherwise(settle(left.p - moved / left.size))
    new_right = F.when(right_full, F.when(gives, 1.0).otherwise(0.0)).otherwise(settle(right.p + moved / right.size))
    return F.struct(left.withField("p", new_left).alias("l"), right.withField("p", new_right).alias("r"))


def _fold(items: Column, kind: str) -> Column:
    """A chunk's items as (done, residual)."""
    nothing, none = F.array().cast(f"array<{kind}>"), F.lit(None).cast(kind)

    def integral(item: Column) -> Column:
        return (item.p <= 0.0) | (item.p >= 1.0)

    def merge(state: Column, item: Column) -> Column:
        met = F.transform(F.array(_step(state.residual, item)), lambda m: F.struct(
            F.concat(state.done, F.filter(F.array(m.l, m.r), integral)).alias("done"),
            F.element_at(F.concat(F.filter(F.array(m.l, m.r), lambda i: ~integral(i)), F.array(none)), 1).alias("residual"),
        ))[0]
        return F.when(state.residual.isNull(), F.struct(state.done.alias("done"), item.alias("residual"))).otherwise(met)

    return F.aggregate(items, F.struct(nothing.alias("done"), none.alias("residual")), merge)


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every document."""
    sized = cut(sizes(docs))
    per = cut(targets(sized, weights, share, most))
    largest = per.agg(F.max("documents")).first()[0] or 0
    x = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    items = (
        sized.withColumn("k", F.coalesce("source", F.lit("\x00null")))
        .join(per.withColumn("k", F.coalesce("source", F.lit("\x00null"))).drop("source"), "k")
        .withColumn("x", x)
        .withColumn("whole", F.when(F.ceil("x") - F.col("x") < NEAR, F.ceil("x")).otherwise(F.floor("x")).cast("long"))
        .withColumn("p", F.greatest(F.lit(0.0), F.col("x") - F.col("whole")))
        .withColumn("p", F.when((F.col("p") < NEAR) | (F.col("size") == 0), 0.0).otherwise(F.col("p")))
    )
    done = items.where("p = 0")
    pending = items.where("p > 0")
    columns = ["doc_id", "source", "size", "mark", "source_size", "documents", "target", "whole", "p"]
    parts = [done.select(columns)]
    expected, level = largest, 0
    while expected:
        chunks = F.greatest(F.lit(1), F.ceil(F.col("documents") / F.lit(float(FAN_IN) ** (level + 1)))).cast("long")
        dealt = pending.select(
            F.coalesce("source", F.lit("\x00null")).alias("k"),
            F.pmod(F.xxhash64(keyed("doc_id"), F.col("mark"), F.lit(seed), F.lit(level)), chunks).alias("chunk"),
            F.struct(F.col("size").alias("order"), unit(keyed("doc_id"), F.col("mark"), F.lit(seed), F.lit(~level)).alias("u"), *columns).alias("item"),
        )
        kind = dealt.schema["item"].dataType.simpleString()
        folded = dealt.groupBy("k", "chunk").agg(F.sort_array(F.collect_list("item"), asc=False).alias("items"))
        folded = cut(folded.select(_fold(F.col("items"), kind).alias("state")))
        parts.append(folded.select(F.inline("state.done")).select(columns))
        pending = folded.where("state.residual is not null").select("state.residual.*")
        if expected <= 1:
            break
        expected, level = -(-expected // FAN_IN), level + 1
    # What is left is one fraction a source at most. It goes to the nearer end, so a source misses its target by half a document at most.
    parts.append(pending.withColumn("p", F.when(F.col("p") > 0.5, 1.0).otherwise(0.0)).select(columns))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    copies = F.col("whole") + F.round("p").cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op6_mixing(spark, sf_dir):
    from .shared import table

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
