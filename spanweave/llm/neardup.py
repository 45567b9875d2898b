"""MinHash near-duplicates: an inverted join over coordinate-value pairs.

A document's set holds its distinct word shingles as 64-bit hashes. Documents
of equal sets are one node. Each node has ``coordinates`` minima; two nodes are
candidates if at least ``least`` of these agree, where ``least`` lies five
standard deviations under the expectation at the similarity asked for (a true
pair is missed about once in a million).

Candidates come from posting lists, one for each coordinate-value pair:

* Values of one node only are dropped; a node left with fewer than ``least``
  shared values has no partner.
* Prefix: two nodes with ``least`` common values must share one among all but
  ``least - 1`` of their values, whatever the order. The rarest values come
  first, so a passage that very many documents hold is not posted by documents
  that have enough else.
* Merging skips what is settled. Members of a list are compared with one pivot
  of it, a star, and linked members become one class. Where a pivot's members
  are still of different classes, up to NEAR of them are compared by their
  coordinates, all with all, and those that agree in ``least`` by their sets.
  Where more than NEAR_PAIRS pairs each agree, and in groups of more than NEAR,
  tasks count what all pairs share of their differences from the pivot, block
  by block, with DENSE_WORK comparisons of these in a task at most (see
  ``_join_dense``). What takes more than BLOCKS blocks is told apart by a
  posting: with R removed from P and A added shingles, two members have
  |P| - r1 - r2 + |R1 & R2| + |A1 & A2| in common, so they are similar only if
  they share at least u1 + u2 differences, where u grows with r and t = |A|.
  Pairs with u1 + u2 <= 0 both belong to P's class; all others share a
  difference among the first few of each, and these differences are posted in
  their turn (see ``_differences`` and ``_settle``): one star at a time, classes
  joined after each, until no list holds two classes, or so few members outside
  of its largest class that their pairs are no more than the rows posted.

So a dense group costs stars, not pairs, and no pair of different classes stays
undecided. Collisions of a pair with its pivot are counted over all coordinates
before full sets are compared. Links form components; a document is kept if its
id is the least.

Defined cases: null and empty texts have empty sets and are linked with
nothing; a text shorter than a shingle is one shingle; a very long text is one
set, held by one task; of equal rows each is returned, with the same class, and
the id decides which are kept; rows that share an id but not the text are
documents of their own; a null doc_id never represents a class with another
id, and is kept if nothing represents its class; other columns are ignored; an
empty table gives an empty result. ``select`` keeps one row of each class, also
of equal rows and null ids, and every row without words.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graphs import components
from .kernels import flat, mix, slices, words
from .shared import cut, raw, table

COORDINATES = 48
_draw = np.random.default_rng(20240607)
FACTOR = _draw.integers(0, 1 << 32, COORDINATES, dtype=np.uint32) | np.uint32(1)
SHIFT = _draw.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)


def least_matches(similarity: float, coordinates: int = COORDINATES) -> int:
    return max(1, math.floor(coordinates * similarity - 5 * math.sqrt(coordinates * similarity * (1 - similarity))))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, _, _, owner = words(data, offsets)
    bounds = np.searchsorted(owner, np.arange(len(offsets)))
    rolled = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        rolled = (rolled + hashes[k : k + len(rolled)]) * np.uint64(0x9FB21C651E98DF25)
    rolled = mix(rolled)
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            sets.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            short = np.uint64(b - a)
            for h in hashes[a:b]:
                short = mix(np.array([short], np.uint64) ^ h)[0]
            sets.append(np.array([short], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima by coordinate of non-empty sets, as uint32."""
    if not sets:
        return np.zeros((0, COORDINATES), np.uint32)
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    return np.stack([np.minimum.reduceat(x * a + b, starts) for a, b in zip(FACTOR, SHIFT, strict=True)], axis=1)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _describe(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(*flat(part.column("text")), width)
                some = [i for i, s in enumerate(sets) if len(s)]
                values = signatures([sets[i] for i in some]).astype(np.int64) | np.arange(COORDINATES, dtype=np.int64) << 32
                ends = np.zeros(len(sets) + 1, np.int32)
                ends[1:] = np.cumsum([COORDINATES * (len(s) > 0) for s in sets])
                keys = [_digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values.reshape(-1)))],
                    ["doc_id", "row", "n_shingles", "same", "signature"],
                )

    return run


def _sets(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal rows come one after the other
        for batch in batches:
            for part in slices(batch):
                rows = []
                ids, same = part.column("id").to_pylist(), part.column("same").to_pylist()
                for k, shingles in enumerate(shingle_sets(*flat(part.column("text")), width)):
                    if ids[k] not in seen and _digest(shingles) == same[k]:
                        seen.add(ids[k])
                        rows.append((ids[k], shingles.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["id", "hashes"])

    return run


def _confirm(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
                one, two = (np.frombuffer(x.as_buffer(), np.uint64) for x in (left, right))
                if 100 * min(len(one), len(two)) < percent * max(len(one), len(two)):
                    keep.append(False)
                    continue
                both = np.concatenate([one, two])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


DIFFERENCES = "pivot long, id long, element long, u double, left double, b0 long, b1 long, b2 long, b3 long, spare long"
SKETCH = ("b0", "b1", "b2", "b3")
BOUNDS = ("u", "left", *SKETCH, "spare")


def _differences(percent: int) -> Callable:
    """The first differences of each member from its pivot, one row each.

    J >= c means |S1 & S2| >= g (|S1| + |S2|) with g = c / (1 + c). In terms of
    r removed and t added shingles: shared differences >= u1 + u2, where
    u = (1 - g) r + g t - (1/2 - g) |P|. Any fixed order of the differences
    serves the prefix; added ones come first, as they are the rarer. With each
    goes a 256-bit sketch of all differences: two members share at most as many
    as their sketches have bits in common, plus ``spare`` (differences that
    fell on a bit already set) of either.
    """
    c = percent / 100
    g = c / (1 + c)
    base = 0.5 - g  # of |P|: what u falls short by

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, elements, bounds, lefts, sketches, spares = [], [], [], [], [], []
            for k, (mine, pivot) in enumerate(zip(batch.column("hashes"), batch.column("other"), strict=True)):
                own, of = (np.frombuffer(x.as_buffer(), np.uint64) for x in (mine, pivot))
                added, removed = np.setdiff1d(own, of, True), np.setdiff1d(of, own, True)
                n, size = len(added) + len(removed), len(of)
                u = (1 - g) * len(removed) + g * len(added) - base * size
                # A partner has |D2| <= (u2 + base |P|) / g differences, and must have u + u2 of them.
                least_u2 = max(-base * size, (u - base * size / g) / (1 / g - 1))
                need = max(1, int(np.ceil(u + least_u2 - 1e-6)))
                every = np.concatenate([mix(added ^ np.uint64(1)), mix(removed)])
                first = every[: max(0, n - need + 1)]
                bits = np.zeros(256, bool)
                bits[(every & np.uint64(255)).astype(np.int64)] = True
                sketches.append(np.broadcast_to(np.packbits(bits).view(np.int64), (len(first), 4)))
                spares.append(np.full(len(first), n - int(bits.sum())))
                rows.append(np.full(len(first), k))
                elements.append(first)
                bounds.append(np.full(len(first), u - 1e-6))
                lefts.append(n - np.arange(len(first), dtype=np.float64))
            if rows:
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("pivot").take(at), batch.column("id").take(at), pa.array(np.concatenate(elements).view(np.int64)), pa.array(np.concatenate(bounds)), pa.array(np.concatenate(lefts)), *(pa.array(x) for x in np.concatenate(sketches).T.copy()), pa.array(np.concatenate(spares))],
                    ["pivot", "id", "element", *BOUNDS],
                )

    return run


class _Links:
    """Tests candidate pairs (a, b) of nodes and joins what is linked into classes."""

    def __init__(self, nodes: DataFrame, sets: DataFrame, least: int, percent: int):
        self.nodes, self.sets, self.least, self.percent = nodes, sets, least, percent
        self.labels: DataFrame | None = None  # id, label

    def colliding(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs with enough equal coordinates."""
        signature = self.nodes.select("id", "signature")
        for side in ("a", "b"):
            pairs = pairs.join(signature.withColumnsRenamed({"id": side, "signature": f"s{side}"}), side)
        return pairs.where(F.size(F.array_intersect("sa", "sb")) >= self.least).drop("sa", "sb")

    def similar(self, pairs: DataFrame) -> DataFrame:
        """The classes x and y, as a and b, of the pairs whose full sets are similar."""
        for side, name in (("a", "left"), ("b", "right")):
            pairs = pairs.join(self.sets.withColumnsRenamed({"id": side, "hashes": name}), side)
        return pairs.select("x", "y", "left", "right").mapInArrow(_confirm(self.percent), "a long, b long")

    def classed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the class of each ``id``."""
        return rows.join(self.labels, "id", "left").withColumn("class", F.coalesce("label", "id")).drop("label")

    def join(self, pairs: DataFrame) -> None:
        """Test the pairs and join the classes of those that are linked."""
        self.merge(self.similar(pairs).distinct())

    def merge(self, links: DataFrame) -> None:
        """Join the classes that ``links`` (a, b) name."""
        linked = cut(links)
        if self.labels is None:
            self.labels = components(linked)
        elif not linked.isEmpty():
            moved = components(linked)
            upper = moved.select(F.col("id").alias("label"), F.col("label").alias("upper"))
            old = self.labels.join(upper, "label", "left").select("id", F.coalesce("upper", "label").alias("label"))
            self.labels = cut(old.unionByName(moved.join(self.labels, "id", "left_anti")))


def _pairs(rows: DataFrame) -> DataFrame:
    """The distinct pairs (a, b), a < b, of nodes i and j in different classes x and y."""
    ahead = F.col("i") < F.col("j")
    ends = [F.when(ahead, F.col(one)).otherwise(F.col(two)).alias(name) for one, two, name in (("i", "j", "a"), ("j", "i", "b"), ("x", "y", "x"), ("y", "x", "y"))]
    return rows.where("i <> j and x <> y").select(*ends).distinct()


def _may_link() -> Column:
    """Whether the differences of two members (the other's have a 2) can be as many as a link needs."""
    need = F.col("u") + F.col("u2")
    common = sum((F.bit_count(F.col(c).bitwiseAND(F.col(f"{c}2"))) for c in SKETCH), F.least("spare", "spare2"))
    return (F.col("left") >= need) & (F.col("left2") >= need) & (common >= need)


PAIRS_A_ROW = 64


def _settle(links: _Links, posted: DataFrame) -> None:
    """Join classes within lists of ``posted`` (pivot, element) until none holds two that could be linked.

    Every round takes one member of each list that holds several classes, in
    turn one that is near the list's pivot or any, tests it against the members
    of other classes, joins what is linked, and is done with it. What is left
    to tell apart are pairs with a member outside of its list's largest class.
    They are tested at once when comparing them takes PAIRS_A_ROW comparisons
    for a posted row at most (twice as many after every round, which bounds the
    rounds), and when no more of them are likely to be linked than there are
    rows, by the share that the last stars found.
    """
    key, turn, share, budget = ["pivot", "element"], 0, 1.0, posted.count()
    while True:
        rows = links.classed(posted)
        near = F.round(F.col("u")) if turn % 2 == 0 else F.lit(0.0)
        rank = F.struct(-near, F.xxhash64("id", "pivot", "element", F.lit(turn)), "id")
        member = F.struct("id", "class", *BOUNDS)
        by_class = rows.groupBy(*key, "class").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(rank.alias("rank"), member.alias("member"))).alias("first"))
        lists = by_class.groupBy(*key).agg(F.sum("n").alias("n"), F.max(F.struct("n", F.col("class").alias("k"))).alias("major"), F.count(F.lit(1)).alias("classes"), F.max("first").alias("first"))
        lists = cut(lists.where("classes > 1").select(*key, "n", F.col("major.n").alias("n_major"), F.col("major.k").alias("major"), F.col("first.member").alias("star")))
        work, members = lists.agg(F.sum(F.col("n") * (F.col("n") - F.col("n_major"))), F.sum("n")).first()
        if not members:
            return
        rows = rows.join(lists.select(*key, "major", "star"), key)
        if work <= budget * PAIRS_A_ROW * 2**turn and work * share <= budget:
            rest = cut(rows.drop("star"))
            other = rest.where("class <> major").select(*key, F.col("id").alias("j"), F.col("class").alias("y"), *(F.col(c).alias(f"{c}2") for c in BOUNDS))
            found = rest.withColumnsRenamed({"id": "i", "class": "x"}).join(other, key).where("x <> y").where(_may_link())
            links.join(_pairs(found))
            return
        star = F.col("star")
        found = rows.select(F.col("id").alias("i"), F.col("class").alias("x"), star.id.alias("j"), star["class"].alias("y"), *BOUNDS, *(star[c].alias(f"{c}2") for c in BOUNDS))
        pairs = cut(_pairs(found.where("x <> y").where(_may_link())))
        share = pairs.count() / members
        if share:
            links.join(pairs)
        posted = cut(rows.where(F.col("id") != star.id).select(*posted.columns))
        turn += 1


NEAR, NEAR_PAIRS = 4096, 8
NEAR_FOUND = "pivot long, i long, j long, x long, y long"


def _agreeing(least: int) -> Callable:
    """Pairs of a pivot's members of different classes with enough equal coordinates; one row without members if they are too many."""

    def run(group: pa.Table) -> pa.Table:
        pivot, ids, classes = (group.column(c).to_numpy() for c in ("pivot", "id", "class"))
        values = group.column("signature").combine_chunks().flatten().to_numpy().reshape(len(ids), COORDINATES)
        i, j, found = [], [], 0
        for k in range(len(ids) - 1):
            others = k + 1 + np.flatnonzero(classes[k + 1 :] != classes[k])
            hits = others[(values[others] == values[k]).sum(axis=1) >= least]
            found += len(hits)
            if found > NEAR_PAIRS * len(ids):
                return pa.table({c.split()[0]: pa.array([pivot[0] if c == "pivot long" else None], pa.int64()) for c in NEAR_FOUND.split(", ")})
            i.append(np.full(len(hits), k))
            j.append(hits)
        i, j = np.concatenate([np.zeros(0, np.int64), *i]), np.concatenate([np.zeros(0, np.int64), *j])
        return pa.table({"pivot": pivot[i], "i": ids[i], "j": ids[j], "x": classes[i], "y": classes[j]})

    return run


def _join_near(links: _Links, members: DataFrame) -> DataFrame:
    """Join classes within the groups of at most NEAR members, and give the pivots of the groups that this does not settle."""
    several = lambda of: cut(links.classed(of).groupBy("pivot").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("pivot", "n"))
    groups = several(members)
    known = links.classed(members.join(groups.where(F.col("n") <= NEAR), "pivot", "left_semi")).join(links.nodes.select("id", "signature"), "id")
    found = cut(known.groupBy("pivot").applyInArrow(_agreeing(links.least), NEAR_FOUND))
    links.join(_pairs(found.where("i IS NOT NULL")))
    dense = members.join(found.where("i IS NULL").select("pivot"), "pivot", "left_semi")
    large = several(members.join(groups.where(F.col("n") > NEAR), "pivot", "left_semi"))
    dense = dense.join(several(dense), "pivot", "left_semi").unionByName(members.join(large.where(F.col("n") <= NEAR * BLOCKS), "pivot", "left_semi"))
    return large.where(F.col("n") > NEAR * BLOCKS).select("pivot").unionByName(_join_dense(links, dense))


DENSE, DENSE_WORK, BLOCKS = 1 << 20, 1 << 30, 64
APART = "pivot long, id long, size long, removed long, added long, base long, elements binary"


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How each member differs from its pivot: counts and elements of what is removed and added."""
    for batch in batches:
        rows = []
        for mine, pivot in zip(batch.column("hashes"), batch.column("other"), strict=True):
            own, of = (np.frombuffer(x.as_buffer(), np.uint64) for x in (mine, pivot))
            added, removed = np.setdiff1d(own, of, True), np.setdiff1d(of, own, True)
            rows.append((len(own), len(removed), len(added), len(of), np.concatenate([removed, added]).tobytes()))
        sizes = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
        yield pa.RecordBatch.from_arrays([batch.column("pivot"), batch.column("id"), *sizes, pa.array([r[4] for r in rows], pa.binary())], [c.split()[0] for c in APART.split(", ")])


def _linking(percent: int, work: int) -> Callable:
    """Links that join the classes of similar members of a pivot, one ``inner`` and one ``outer``, by exact counts of the differences that two share; one row without ends if these are more than ``work``.

    |S1 & S2| = |P| - r1 - r2 + |R1 & R2| + |A1 & A2|. (No element is removed from one and added to another.)
    """

    def run(group: pa.Table) -> pa.Table:
        pivot, classes, size, removed, base, inner, outer = (group.column(c).to_numpy() for c in ("pivot", "class", "size", "removed", "base", "inner", "outer"))
        n, each = len(pivot), [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("elements").combine_chunks()]
        ends = np.cumsum([0, *map(len, each)])
        _, element = np.unique(np.concatenate(each), return_inverse=True)
        owner = np.repeat(np.arange(n), np.diff(ends))
        held = inner[owner]
        counts = np.bincount(element[held], minlength=element.max(initial=-1) + 1)
        if int(counts[element[outer[owner]]].sum()) > work:
            return pa.table({"pivot": pa.array(pivot[:1]), "a": pa.array([None], pa.int64()), "b": pa.array([None], pa.int64())})
        holders = owner[held][np.argsort(element[held], kind="stable")]
        starts = np.cumsum(counts) - counts
        label, a, b = classes.copy(), [], []
        for k in np.flatnonzero(outer).tolist():
            own = element[ends[k] : ends[k + 1]]
            many = counts[own]
            at = np.arange(many.sum()) + np.repeat(starts[own] - (np.cumsum(many) - many), many)
            common = base - removed[k] - removed + np.bincount(holders[at], minlength=n)
            hits = np.flatnonzero(inner & (label != label[k]) & (100 * common >= percent * (size[k] + size - common)))
            for j in hits[np.unique(label[hits], return_index=True)[1]]:
                a.append(classes[k])
                b.append(classes[j])
                label[label == label[j]] = label[k]
        return pa.table({"pivot": pa.array(np.full(len(a), pivot[0])), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _join_dense(links: _Links, members: DataFrame) -> DataFrame:
    """Join classes within groups of whom many agree, or of more than NEAR members, all pairs by their differences; gives the pivots of the groups that take more than BLOCKS blocks.

    The members of a pivot's largest class are dealt to blocks, and all others
    to further blocks; each pair of blocks but for two of the largest class is
    a group of its own. A block has so few members that its pairs stay under
    DENSE_WORK, even if all members had the same differences; a pivot whose
    members are so few has one block.
    """
    if members.isEmpty():
        return members.select("pivot")
    apart = cut(_beside_pivots(members, links.sets).mapInArrow(_apart, APART))
    known = links.classed(apart)
    by_class = known.groupBy("pivot", "class").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("removed") + F.col("added")).alias("differences"))
    of = by_class.groupBy("pivot").agg(F.sum("n").alias("n"), F.sum("differences").alias("differences"), F.max(F.struct("n", "class")).alias("major"))
    share = F.sqrt(F.col("differences") / F.col("n") / max(1, DENSE_WORK)) * 2.4  # of a block, by each member
    blocks = lambda rows: F.greatest(F.lit(1), F.ceil(rows * share)).cast("long")
    one = F.col("n") * share <= 2
    held = cut(of.select("pivot", "differences", F.col("major.class").alias("major"), F.when(one, 0).otherwise(blocks(F.col("major.n"))).alias("lower"), F.when(one, 1).otherwise(blocks(F.col("n") - F.col("major.n"))).alias("upper")))
    fits = (F.col("differences") <= DENSE * BLOCKS) & (F.col("lower") + F.col("upper") <= BLOCKS)
    at = F.pmod(F.xxhash64("id"), F.when((F.col("class") == F.col("major")) & (F.col("lower") > 0), F.col("lower")).otherwise(F.col("upper")))
    dealt = known.join(held.where(fits), "pivot").withColumn("block", F.when(F.col("class") == F.col("major"), at).otherwise(F.col("lower") + at))
    block = F.col("block")
    partners = F.transform(F.sequence(F.lit(0).cast("long"), F.col("lower") + F.col("upper") - 1), lambda x: F.struct(F.least(x, block).alias("one"), F.greatest(x, block).alias("two"), (block <= x).alias("inner"), (block >= x).alias("outer")))
    pairs = dealt.select("*", F.inline(F.filter(partners, lambda x: x.two >= F.col("lower")))).select("pivot", "class", "size", "removed", "base", "elements", "one", "two", "inner", "outer")
    found = cut(pairs.groupBy("pivot", "one", "two").applyInArrow(_linking(links.percent, DENSE_WORK), "pivot long, a long, b long"))
    links.merge(found.where("a IS NOT NULL").select("a", "b").distinct())
    return held.where(~fits).select("pivot").unionByName(found.where("a IS NULL").select("pivot").distinct())


SALT_ROWS = 500


def _beside_pivots(members: DataFrame, sets: DataFrame) -> DataFrame:
    """pivot, id, hashes of the member and ``other``, those of its pivot.

    A pivot's set is repeated for every SALT_ROWS of its members, which are dealt
    to the repeats, so that no task holds all members of a pivot.
    """
    copies = members.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).alias("copies"))
    mine = members.join(copies, "pivot").withColumn("salt", F.pmod(F.xxhash64("id"), "copies")).select("pivot", "id", "salt")
    others = sets.withColumnsRenamed({"id": "pivot", "hashes": "other"}).join(copies, "pivot")
    others = others.select("pivot", "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("salt"))
    return mine.join(sets, "id").join(others, ["pivot", "salt"]).select("pivot", "id", "hashes", "other")


def _classes(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Every row's (doc_id, row, n_shingles, same), and by distinct set (same) its class: component and first row."""
    least = least_matches(percent / 100)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.xxhash64("text").alias("row"), raw("text").alias("text"))
    found = cut(texts.mapInArrow(_describe(width), f"doc_id {kind}, row long, n_shingles long, same binary, signature array<long>"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")).alias("first")
    nodes = cut(found.where("n_shingles > 0").groupBy("same").agg(first, F.first("signature").alias("signature")).withColumn("id", F.monotonically_increasing_id()))

    posted = nodes.select("id", F.explode("signature").alias("value"))
    shared = posted.groupBy("value").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1")
    rarest = posted.join(shared, "value").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("holders", "value"))).alias("values"))
    prefix = F.slice("values", 1, F.size("values") - (least - 1))
    entries = cut(rarest.where(F.size("values") >= least).select("id", F.size("values").alias("shared"), F.explode(prefix.value).alias("value")))

    wanted = nodes.join(entries.select("id").distinct(), "id", "left_semi").select("id", "same", F.col("first.doc_id").alias("doc"), F.col("first.row").alias("at"))
    its = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("row") == F.col("at"))).select("id", "same", "text")
    sets = cut(its.mapInArrow(_sets(width), "id long, hashes binary"))
    links = _Links(nodes, sets, least, percent)

    # One pivot for each list: the member that shares most of its values, so mostly the same and near the middle of its group.
    pivots = entries.groupBy("value").agg(F.max_by("id", F.struct("shared", F.xxhash64("id"), "id")).alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut(entries.join(pivots, "value").where("id <> pivot").select("id", "pivot").distinct())
    links.join(links.colliding(_pairs(members.select(F.col("id").alias("i"), F.col("pivot").alias("j"), F.col("id").alias("x"), F.col("pivot").alias("y")))))

    # Groups whose members, the pivot apart, are in several classes.
    beyond = cut(members.join(_join_near(links, members), "pivot", "left_semi"))
    if not beyond.isEmpty():
        _settle(links, cut(_beside_pivots(beyond, sets).mapInArrow(_differences(percent), DIFFERENCES)))

    linked = links.labels.join(nodes.select("id", "first"), "id")
    first = linked.groupBy("label").agg(F.min("first").alias("least"))
    label = links.labels.join(first, "label").select("id", "least")
    return found.drop("signature"), nodes.join(label, "id", "left").select("same", F.coalesce("least", "first").alias("first"))


def classes(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document.

    Documents are linked where 100 * intersection >= percent * union of their
    sets of ``width``-word shingles.
    """
    rows, by_set = _classes(docs, width, percent)
    joined = rows.join(by_set.select("same", F.col("first.doc_id").alias("component")), "same", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def select(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each class, with all its columns: one of least doc_id and, among its rows, of least hash.

    Rows without words are in no class and stay.
    """
    keep = _classes(docs, width, percent)[1].select(F.col("first.doc_id").alias("doc"), F.col("first.row").alias("at")).distinct()
    worded = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    rows = docs.where(worded).select(F.struct("*").alias("whole"), F.col("doc_id").alias("key"), F.xxhash64("text").alias("row"), F.xxhash64(*plain).alias("order"))
    kept = rows.join(keep, F.col("key").eqNullSafe(F.col("doc")) & (F.col("row") == F.col("at")))
    one = kept.groupBy("key", "row").agg(F.min_by("whole", "order").alias("whole")).select("whole.*")
    return docs.where(~worded).unionByName(one)


def op4_neardup(spark, sf_dir):
    return classes(table(spark, sf_dir, "documents"), width=3, percent=85)


ORACLE_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(w[i], w[i + 1], w[i + 2]) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)
  UNION ALL SELECT doc_id, hash(w) FROM words WHERE len(w) BETWEEN 1 AND 2
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)
), twoway AS MATERIALIZED (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT twoway.b, reach.root FROM reach JOIN twoway ON twoway.a = reach.node
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) JOIN (SELECT node AS doc_id, min(root) AS component_id FROM reach GROUP BY node) USING (doc_id)
"""
