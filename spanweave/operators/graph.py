"""Graph traversal, ranking, paths, components and flow on edges (src, dst, ...).

Traversals move a frontier by joins and stop when it is empty; every loop has
a bound and cuts its lineage. Ties are broken by names, so results do not
depend on partitioning. The sequential algorithms (depth-first order,
articulation points, flow) run on one machine for graphs of checked size.
"""

from __future__ import annotations

import itertools
from collections import defaultdict, deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

SMALL = 200_000


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def hops_from(edges: DataFrame, roots: DataFrame, most: int = 16) -> DataFrame:
    """root, node, hops of every node that a root reaches in at most ``most`` steps, itself at 0."""
    steps = cut(edges.select("src", "dst").distinct())  # read once, not once a level
    seen = cut(roots.select(F.col("root"), F.col("root").alias("node"), F.lit(0).alias("hops")))
    frontier = seen
    for k in range(1, most + 1):
        found = frontier.join(steps, frontier.node == steps.src).select("root", F.col("dst").alias("node")).distinct()
        frontier = cut(found.join(seen, ["root", "node"], "left_anti").withColumn("hops", F.lit(k)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def reachable(edges: DataFrame, source: str, most: int = 16) -> DataFrame:
    """node and hops of what a source reaches, without itself."""
    root = edges.sparkSession.createDataFrame([(source,)], "root string")
    return hops_from(edges, root, most).where("hops > 0").select("node", "hops")


def paths(edges: DataFrame, source: str, most: int, score: str = "score", keep: int | None = None) -> DataFrame:
    """Simple paths from a source: path (array), node (its end), hops, score (product over its edges).

    ``keep`` bounds the paths held at each end; a path of highest score is
    never lost, as all prefixes of it are best at their ends.
    """
    steps = cut(edges.select("src", "dst", F.col(score).alias("_s")))
    start = edges.sparkSession.createDataFrame([([source], source, 0, 1.0)], "path array<string>, node string, hops int, score double")
    every, frontier = None, start
    for _ in range(most):
        grown = frontier.join(steps, (frontier.node == steps.src) & ~F.array_contains("path", F.col("dst")))
        grown = grown.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("node"), (F.col("hops") + 1).alias("hops"), (F.col("score") * F.col("_s")).alias("score"))
        if keep:
            w = Window.partitionBy("node").orderBy(F.col("score").desc(), "hops", "path")
            grown = grown.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")
        frontier = cut(grown)
        if frontier.isEmpty():
            break
        every = frontier if every is None else every.unionByName(frontier)
    return every if every is not None else start.where("false")


def shortest(edges: DataFrame, source: str, cost: str) -> DataFrame:
    """node, cost, hops, path of least cost, then fewest hops, then least names (relaxation until nothing improves)."""
    steps = cut(edges.groupBy("src", "dst").agg(F.min(cost).alias("_c")))
    best = cut(edges.sparkSession.createDataFrame([(source, 0.0, 0, [source])], "node string, cost double, hops int, path array<string>"))
    rank = F.struct("cost", "hops", "path")
    while True:
        grown = best.join(steps, (best.node == steps.src) & ~F.array_contains("path", F.col("dst"))).select(F.col("dst").alias("node"), (F.col("cost") + F.col("_c")).alias("cost"), (F.col("hops") + 1).alias("hops"), F.concat("path", F.array("dst")).alias("path"))
        new = cut(best.unionByName(grown).groupBy("node").agg(F.min(rank).alias("r")).select("node", "r.cost", "r.hops", "r.path"))
        if new.exceptAll(best).isEmpty():
            return new
        best = new


def _sweeps(nodes: DataFrame, edges: DataFrame, damping: float, weight: str | None):
    """Endless ranks, one parallel update after the other; what dangling nodes hold is dealt to all."""
    w = F.col(weight) if weight else F.lit(1.0)
    steps = edges.select("src", "dst", w.alias("_w")).where("_w > 0")
    out = steps.groupBy("src").agg(F.sum("_w").alias("_t"))
    steps = cut(steps.join(out, "src").groupBy("src", "dst").agg((F.sum("_w") / F.first("_t")).alias("_p")))
    nodes = cut(nodes.select("node"))
    n = max(nodes.count(), 1)
    senders = steps.select(F.col("src").alias("node")).distinct()
    ranks, k = nodes.select("node", F.lit(1.0 / n).alias("rank")), 0
    while True:
        lost = ranks.join(senders, "node", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        told = ranks.join(steps, ranks.node == steps.src).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("_p")).alias("told"))
        new = nodes.join(told, "node", "left").crossJoin(F.broadcast(lost))  # lost is one row
        ranks = new.select("node", (F.lit((1 - damping) / n) + damping * (F.coalesce("told", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        k += 1
        if k % 4 == 0:
            ranks = cut(ranks)
        yield ranks


def pagerank(nodes: DataFrame, edges: DataFrame, sweeps: int = 20, damping: float = 0.85, weight: str | None = None, renormalise: bool = False) -> DataFrame:
    """node, rank after ``sweeps`` updates."""
    ranks = next(itertools.islice(_sweeps(nodes, edges, damping, weight), sweeps - 1, None))
    if renormalise:
        ranks = ranks.crossJoin(F.broadcast(ranks.agg(F.sum("rank").alias("_all")))).select("node", (F.col("rank") / F.col("_all")).alias("rank"))
    return ranks


def pagerank_until(nodes: DataFrame, edges: DataFrame, tolerance: float = 1e-10, most: int = 200, damping: float = 0.85, weight: str | None = None) -> DataFrame:
    """Ranks when an update changes them by less than ``tolerance`` in all (seen at every fourth); an error if none does."""
    before = None
    for k, ranks in enumerate(itertools.islice(_sweeps(nodes, edges, damping, weight), most), 1):
        if k % 4 == 0 and before is not None:
            change = ranks.join(before.withColumnRenamed("rank", "was"), "node").agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0]
            if (change or 0) < tolerance:
                return ranks
        before = ranks
    raise ValueError("the ranks did not settle")


def diffuse(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, sweeps: int, damping: float) -> DataFrame:
    """Linear propagation: value <- seed + damping * sum of neighbours' value * weight, a fixed number of times."""
    edges = cut(edges.select("src", "dst", "weight"))
    base = cut(nodes.join(seeds, "node", "left").select("node", F.coalesce("value", F.lit(0.0)).alias("seed")))
    value = base.select("node", F.col("seed").alias("value"))
    for _ in range(sweeps):
        told = value.join(edges, value.node == edges.src).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("value") * F.col("weight")).alias("told"))
        value = cut(base.join(told, "node", "left").select("node", (F.col("seed") + damping * F.coalesce("told", F.lit(0.0))).alias("value")))
    return value


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component (least name), by least neighbour labels and labels of labels."""
    steps = cut(both_ways(edges).distinct())
    labels = cut(nodes.select("node", F.col("node").alias("component")))
    while True:
        told = steps.join(labels, steps.src == labels.node).groupBy("dst").agg(F.min("component").alias("told"))
        near = labels.join(told, labels.node == told.dst, "left").select("node", F.least("component", "told").alias("next"), F.col("component").alias("was"))
        above = labels.select(F.col("node").alias("next"), F.col("component").alias("above"))
        step = cut(near.join(above, "next", "left").select("node", F.least("next", F.coalesce("above", "next")).alias("component"), "was"))
        labels = step.select("node", "component")
        if step.where("component <> was").isEmpty():
            break
    return labels


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component (least name of those that reach it and that it reaches).

    Rounds of forward and backward colouring: the least label flows along the
    edges; where it also flows back to a node, the node is settled and leaves.
    """
    left, done = cut(nodes.select("node")), None
    while True:
        steps = cut(edges.select("src", "dst").distinct().join(left.withColumnRenamed("node", "src"), "src", "left_semi").join(left.withColumnRenamed("node", "dst"), "dst", "left_semi"))
        colour = cut(left.select("node", F.col("node").alias("colour")))
        while True:
            told = steps.join(colour, steps.src == colour.node).groupBy("dst").agg(F.min("colour").alias("told"))
            new = cut(colour.join(told, colour.node == told.dst, "left").select("node", F.least("colour", "told").alias("colour"), F.col("colour").alias("was")))
            colour = new.select("node", "colour")
            if new.where("colour <> was").isEmpty():
                break
        # Back from each colour's own node, within the colour.
        inside = steps.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("c1")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("c2")), "dst").where("c1 = c2")
        back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        roots = colour.where("node = colour").select(F.col("node").alias("root"))
        found = hops_from(back, roots, left.count()).select("node", F.col("root").alias("component"))
        done = found if done is None else done.unionByName(found)
        left = cut(left.join(found, "node", "left_anti"))
        if left.isEmpty():
            break
    return done


def closeness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Out-closeness (r / sum of hops) * (r / (n - 1)), r the number of nodes reached."""
    n = nodes.count()
    hops = hops_from(edges, nodes.select(F.col("node").alias("root")), n).where("hops > 0")
    per = hops.groupBy(F.col("root").alias("node")).agg(F.count("*").alias("r"), F.sum("hops").alias("d"))
    return nodes.join(per, "node", "left").select("node", F.coalesce(F.col("r") / F.col("d") * (F.col("r") / max(n - 1, 1)), F.lit(0.0)).alias("closeness"))


def betweenness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Share of shortest paths through each node, directed and unweighted: counts forward by level, dependencies back."""
    n = nodes.count()
    steps = cut(edges.select("src", "dst").where("src <> dst").distinct())
    hops = cut(hops_from(steps, nodes.select(F.col("node").alias("root")), n))
    deepest = hops.agg(F.max("hops")).first()[0] or 0
    on_way = hops.select("root", F.col("node").alias("src"), F.col("hops").alias("h")).join(steps, "src").join(hops.select("root", F.col("node").alias("dst"), F.col("hops").alias("h2")), ["root", "dst"]).where("h2 = h + 1")
    on_way = cut(on_way.select("root", "src", "dst", "h"))
    sigma = [cut(hops.where("hops = 0").select("root", "node", F.lit(1.0).alias("sigma")))]
    for k in range(deepest):
        level = on_way.where(F.col("h") == k).join(sigma[-1].withColumnRenamed("node", "src"), ["root", "src"])
        sigma.append(cut(level.groupBy("root", F.col("dst").alias("node")).agg(F.sum("sigma").alias("sigma"))))
    delta = sigma[-1].select("root", "node", "sigma", F.lit(0.0).alias("delta"))
    total = delta
    for k in range(deepest - 1, -1, -1):
        later = delta.select("root", F.col("node").alias("dst"), F.col("sigma").alias("s2"), "delta")
        part = on_way.where(F.col("h") == k).join(later, ["root", "dst"]).join(sigma[k].withColumnRenamed("node", "src"), ["root", "src"])
        back = part.groupBy("root", F.col("src").alias("node")).agg(F.sum(F.col("sigma") / F.col("s2") * (1 + F.col("delta"))).alias("delta"))
        delta = cut(sigma[k].join(back, ["root", "node"], "left").select("root", "node", "sigma", F.coalesce("delta", F.lit(0.0)).alias("delta")))
        total = total.unionByName(delta)
    per = total.where("root <> node").groupBy("node").agg(F.sum("delta").alias("b"))
    return nodes.join(per, "node", "left").select("node", (F.coalesce("b", F.lit(0.0)) / max((n - 1) * (n - 2), 1)).alias("betweenness"))


def _anchored(steps: DataFrame, degree: DataFrame) -> DataFrame:
    """node, up, d: of each node with one incoming edge, the nearest node above it that has none or several, and how far it is.

    Pointers double each round, so a chain of n nodes takes log2 n rounds; one
    that stands after that runs in a cycle.
    """
    chain = cut(steps.join(degree.where("n = 1"), steps.dst == degree.node).select("node", F.col("src").alias("up"), F.lit(1).cast("long").alias("d")))
    count = chain.count()
    for _ in range(count.bit_length() + 1):
        ahead = chain.select(F.col("node").alias("up"), F.col("up").alias("further"), F.col("d").alias("more"))
        jumped = cut(chain.join(ahead, "up", "left").select("node", F.coalesce("further", "up").alias("up"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d"), F.col("further").isNotNull().alias("moved")))
        chain = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return chain
    raise ValueError("the graph has a cycle")


def topological_levels(nodes: DataFrame | None, edges: DataFrame) -> DataFrame:
    """node, level: the longest way from a node without incoming edges; an error on a cycle. Without ``nodes``, those are meant that edges have.

    Chains are drawn together first (see ``_anchored``). The rest is taken
    level by level: a node is done when all edges to it have come from nodes
    that are done. So rounds grow with the joins of ways on a path, and with
    the logarithm of its length, and edges move once.
    """
    steps = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    if nodes is not None:
        nodes = cut(nodes.select("node").distinct())
        known = lambda c: nodes.select(F.col("node").alias(c))
        steps = steps.join(known("src"), "src", "left_semi").join(known("dst"), "dst", "left_semi")
    steps = cut(steps)
    ends = steps.select(F.col("dst").alias("node"), F.lit(1).cast("long").alias("n"))
    others = steps.select(F.col("src").alias("node")) if nodes is None else nodes
    degree = cut(ends.unionByName(others.select("node", F.lit(0).cast("long").alias("n"))).groupBy("node").agg(F.sum("n").alias("n")))
    chain = _anchored(steps, degree)
    joins = degree.where("n > 1").select(F.col("node").alias("dst"), F.col("n").alias("need"))
    ways = steps.join(joins, "dst").join(chain.withColumnRenamed("node", "src"), "src", "left")
    # Of several chains from one node to another the longest counts, and all of them have come with it.
    ways = cut(ways.groupBy(F.coalesce("up", "src").alias("node"), "dst", "need").agg(F.max(F.coalesce("d", F.lit(0)) + 1).alias("d"), F.count("*").alias("came")))
    fresh = cut(degree.where("n = 0").select("node", F.lit(0).cast("long").alias("level")))
    done, open_ = fresh, None
    while not fresh.isEmpty():
        step = ways.join(fresh, "node").groupBy("dst", "need").agg(F.max(F.col("level") + F.col("d")).alias("level"), F.sum("came").alias("came"))
        step = step if open_ is None else open_.unionByName(step).groupBy("dst", "need").agg(F.max("level").alias("level"), F.sum("came").alias("came"))
        step = cut(step)
        fresh = cut(step.where("came = need").select(F.col("dst").alias("node"), "level"))
        open_ = step.where("came < need")
        done = done.unionByName(fresh)
    if done.count() < degree.where("n <> 1").count():
        raise ValueError("the graph has a cycle")
    return done.unionByName(chain.join(done.select(F.col("node").alias("up"), F.col("level").alias("above")), "up").select("node", (F.col("above") + F.col("d")).alias("level"))).select("node", F.col("level").cast("int").alias("level"))


def _adjacency(edges: DataFrame, *columns: str) -> list:
    rows = edges.select("src", "dst", *columns).orderBy("src", "dst", *columns).limit(SMALL + 1).collect()
    if len(rows) > SMALL:
        raise ValueError(f"this algorithm takes up to {SMALL} edges")
    return rows


def depth_first(edges: DataFrame, source: str | None) -> DataFrame:
    """place, node in the order of a stack that marks nodes as they are pushed; no rows from a null source."""
    if source is None:
        return edges.sparkSession.createDataFrame([], "place int, node string")
    out = defaultdict(list)
    for r in _adjacency(edges):
        out[r.src].append(r.dst)
    stack, seen, order = [source], {source}, []
    while stack:
        node = stack.pop()
        order.append((len(order), node))
        for to in sorted(set(out[node]), reverse=True):
            if to not in seen:
                seen.add(to)
                stack.append(to)
    return edges.sparkSession.createDataFrame(order, "place int, node string")


def articulation_points(edges: DataFrame) -> DataFrame:
    """Nodes whose removal parts their undirected component (an iterative walk with low points)."""
    near = defaultdict(set)
    for r in _adjacency(edges):
        if r.src != r.dst:
            near[r.src].add(r.dst)
            near[r.dst].add(r.src)
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    found = set()
    for root in sorted(near):
        if root in number:
            continue
        number[root] = low[root] = len(number)
        walk, branches = [(root, None, iter(sorted(near[root])))], 0
        while walk:
            node, parent, rest = walk[-1]
            to = next(rest, None)
            if to is None:
                walk.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[node])
                    if parent == root:
                        branches += 1
                    elif low[node] >= number[parent]:
                        found.add(parent)
            elif to not in number:
                number[to] = low[to] = len(number)
                walk.append((to, node, iter(sorted(near[to]))))
            elif to != parent:
                low[node] = min(low[node], number[to])
        if branches > 1:
            found.add(root)
    return edges.sparkSession.createDataFrame([(x,) for x in sorted(found)], "node string")


def max_flow(edges: DataFrame, source: str | None, sink: str | None, capacity: str = "weight") -> tuple[float, list[tuple[str, str, float]], set[str]]:
    """Value, flow by edge and the source's side of a least cut (shortest augmenting paths); nothing flows without a source and another node as sink."""
    rows = _adjacency(edges, capacity)
    if source is None or sink is None or source == sink:
        return 0.0, [(r.src, r.dst, 0.0) for r in rows], set()
    to, room, out = [], [], defaultdict(list)
    for r in rows:
        for a, b, c in ((r.src, r.dst, float(r[capacity])), (r.dst, r.src, 0.0)):
            out[a].append(len(to))
            to.append(b)
            room.append(c)
    value = 0.0
    while True:
        came: dict[str, int | None] = {source: None}
        queue = deque([source])
        while queue and sink not in came:
            node = queue.popleft()
            for e in out[node]:
                if room[e] > 1e-15 and to[e] not in came:
                    came[to[e]] = e
                    queue.append(to[e])
        if sink not in came:
            flows = [(r.src, r.dst, room[2 * i + 1]) for i, r in enumerate(rows)]
            return value, flows, set(came)
        way, node = [], sink
        while came[node] is not None:
            way.append(came[node])
            node = to[came[node] ^ 1]
        least = min(room[e] for e in way)
        for e in way:
            room[e] -= least
            room[e ^ 1] += least
        value += least
