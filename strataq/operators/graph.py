"""Graph operators on edge tables.

Components contract the edge table: each round points every node to the least of
itself and its neighbours, follows the pointers twice and replaces the end points
of the edges.  Loops and repeats fall away.  Where a round leaves more than half of
the edges, as along a path in the order of its names, the next follows all pointers to
their ends first, so the table shrinks to nothing in a number of rounds that grows with
the logarithm of its size.  Counts per
node are partial aggregates, so a node with many edges makes no large group;
nothing reaches the driver but a flag, and every round is a written table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import Store


def _to_roots(up: DataFrame, store: Store) -> DataFrame:
    """Every node with the end of its chain of pointers, which are doubled until none moves."""
    while True:
        hop = up.select(F.col("node").alias("to"), F.col("to").alias("next"))
        new = store.put(up.join(hop, "to").select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
        still = new.where("moved").isEmpty()
        store.drop(up)
        up = new
        if still:
            return up


def components(edges: DataFrame, store: Store) -> DataFrame:
    """(a long, b long) edges to (node, label): the least node of its component.

    Nodes without an edge to another node are not listed; null ends are ignored.
    """
    live = store.put(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    labels, left, slow = None, live.count(), False
    while left:
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = store.put(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("to")))
        if slow:
            up = _to_roots(up, store)
        hop = up.select(F.col("node").alias("to"), F.col("to").alias("next"))
        up2 = up.join(hop, "to").select("node", F.col("next").alias("to"))
        up2 = store.put(up2.join(hop, "to").select("node", F.col("next").alias("to")))
        a, b = up2.select(F.col("node").alias("a"), F.col("to").alias("x")), up2.select(F.col("node").alias("b"), F.col("to").alias("y"))
        old = live
        live = store.put(live.join(a, "a").join(b, "b").where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
        before, left = left, live.count()
        slow = 2 * left > before
        if labels is None:
            labels = up2.select("node", F.col("to").alias("label"))
        else:
            step = up2.select(F.col("node").alias("label"), F.col("to").alias("further"))
            new = store.put(labels.join(step, "label", "left").select("node", F.coalesce("further", "label").alias("label")))
            labels = new
        store.drop(old, up)
    return labels if labels is not None else live.select(F.col("a").alias("node"), F.col("b").alias("label"))


def simple_edges(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Undirected edges without loops or repeats, a < b."""
    return df.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))


def triangles(edges: DataFrame) -> DataFrame:
    """Triangles (x, y, z) of simple edges, each once.

    Edges point from the node of lower degree to that of higher degree, which
    bounds the wedges of a hub by the square root of the number of edges.
    """
    d = degrees(edges)
    e = edges.join(d.select(F.col("node").alias("a"), F.col("degree").alias("da")), "a").join(d.select(F.col("node").alias("b"), F.col("degree").alias("db")), "b")
    up = F.struct("da", "a") < F.struct("db", "b")
    e = e.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("s"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("t"))
    wedges = e.select("s", F.col("t").alias("y")).join(e.select("s", F.col("t").alias("z")), "s").where("y <> z")
    return wedges.join(e.select(F.col("s").alias("y"), F.col("t").alias("z")), ["y", "z"]).select(F.col("s").alias("x"), "y", "z")


def clustering(edges: DataFrame) -> DataFrame:
    """Local clustering coefficient of every node with an edge."""
    t = triangles(edges)
    per = t.select(F.explode(F.array("x", "y", "z")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    d = degrees(edges).join(per, "node", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
    return d.withColumn("clustering", F.when(F.col("degree") > 1, 2 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0))


def cycles(edges: DataFrame, longest: int) -> DataFrame:
    """(src, dst, weight) to simple directed cycles of up to ``longest`` edges, from their least node."""
    step = edges.select(F.col("src").alias("s"), F.col("dst").alias("d"), F.col("weight").alias("w"))
    paths = step.where("s <= d").select(F.array("s").alias("path"), F.col("s").alias("root"), F.col("d").alias("end"), F.col("w").alias("gain"))
    closed = [paths.where("root = end").select("path", "gain")]
    paths = paths.where("root < end")
    for _ in range(longest - 1):
        paths = paths.join(step, paths.end == step.s).where("d >= root AND NOT array_contains(path, end)").select(F.array_append("path", F.col("end")).alias("path"), "root", F.col("d").alias("end"), (F.col("gain") * F.col("w")).alias("gain"))
        closed.append(paths.where("root = end").select("path", "gain"))
        paths = paths.where("root < end AND NOT array_contains(path, end)")
    return reduce(DataFrame.unionByName, closed).withColumn("polarity", F.when(F.col("gain") < 0, "balancing").otherwise("reinforcing"))


def descend(parents: DataFrame, roots: DataFrame, spark: SparkSession, deepest: int | None = None) -> DataFrame:
    """(id, parent) and root ids to (root, id, depth), breadth first, to a stated depth or to the end.

    Every level is written, so the plan stays short; a pair of root and id is met once, so
    cycles end.
    """
    store = Store(spark, "descend")
    step = store.put(parents.where("parent IS NOT NULL").select("id", "parent"))
    level = store.put(roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")).distinct())
    found = level
    depth = 0
    while (deepest is None or depth < deepest) and not level.isEmpty():
        depth += 1
        below = level.select("root", F.col("id").alias("parent")).join(step, "parent").select("root", "id").distinct()
        level = store.put(below.join(found, ["root", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        found = found.unionByName(level)
    return found


def ancestors(parents: DataFrame, starts: DataFrame, spark: SparkSession) -> DataFrame:
    """(id, parent) and ids to (start, id, depth) of everything above them, to the roots."""
    turned = parents.where("parent IS NOT NULL").select(F.col("parent").alias("id"), F.col("id").alias("parent"))
    return descend(turned, starts, spark).where("depth > 0").withColumnRenamed("root", "start")


def eigenvector(edges: DataFrame, store: Store, rounds: int = 30, shift: float = 1.0) -> DataFrame:
    """Shifted power iteration on an undirected graph, scores summing to 1.

    Every round is written, so each is one join on the edges whatever their number.
    """
    both = store.put(both_ways(edges))
    score, total = store.put(both.select(F.col("a").alias("node")).distinct().withColumn("x", F.lit(1.0))), 1.0
    for _ in range(rounds):
        near = both.join(score.select(F.col("node").alias("b"), "x"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("x").alias("y"))
        new = store.put(score.join(near, "node").select("node", ((F.col("x") * shift + F.col("y")) / F.lit(total)).alias("x")))
        store.drop(score)
        score, total = new, new.agg(F.sum("x")).first()[0] or 1.0
    return score.select("node", (F.col("x") / F.lit(total)).alias("x"))


def k_core(edges: DataFrame, k: int, store: Store) -> DataFrame:
    """Edges of the k-core, by peeling until nothing falls below k."""
    live = store.put(edges)
    while True:
        weak = degrees(live).where(F.col("degree") < k).select("node")
        if weak.isEmpty():
            return live
        live = store.put(live.join(weak, live.a == weak.node, "left_anti").join(weak, F.col("b") == weak.node, "left_anti"))


def path_lengths(edges: DataFrame, sources: DataFrame, spark: SparkSession) -> DataFrame:
    """(source, node, distance) over connected pairs, breadth first from a stated set of sources.

    ``edges`` are undirected (a, b), ``sources`` (node); each round is one join on the edges.
    """
    return descend(both_ways(edges).select(F.col("a").alias("parent"), F.col("b").alias("id")), sources.select(F.col("node").alias("id")), spark).where("depth > 0").select(F.col("root").alias("source"), F.col("id").alias("node"), F.col("depth").alias("distance"))


def path_summary(paths: DataFrame, n_nodes: int, n_sources: int) -> DataFrame:
    """Mean length and longest path over connected pairs, and the share of pairs that are connected."""
    total = n_sources * (n_nodes - 1)
    return paths.agg(F.avg("distance").alias("mean_path_length"), F.max("distance").alias("diameter"), (F.count("*") / F.lit(max(1, total))).alias("connected_fraction"))


def cross_community(edges: DataFrame, labels: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs of nodes of different communities: all, connected ones, and edges between them.

    ``labels`` (node, community) lists every node, ``parts`` (node, label) the components of
    nodes with edges.  Pairs are counted from sizes, never listed.
    """
    pairs = lambda c: (c * (c - 1) / 2).cast("double")
    every = labels.join(parts, "node", "left").withColumn("label", F.coalesce("label", "node"))
    cells = every.groupBy("label", "community").agg(F.count("*").alias("k"))
    inside = cells.groupBy("label").agg((pairs(F.sum("k")) - F.sum(pairs(F.col("k")))).alias("x")).agg(F.sum("x").alias("connected_cross_pairs"))
    sizes = cells.groupBy("community").agg(F.sum("k").alias("k")).agg((pairs(F.sum("k")) - F.sum(pairs(F.col("k")))).alias("total_cross_pairs"))
    side = lambda n, c: labels.select(F.col("node").alias(n), F.col("community").alias(c))
    cross = edges.join(side("a", "ca"), "a").join(side("b", "cb"), "b").agg(F.count_if(F.col("ca") != F.col("cb")).alias("cross_edges"))
    return inside.crossJoin(sizes).crossJoin(cross).withColumn("fraction", F.coalesce(F.col("connected_cross_pairs") / F.nullif("total_cross_pairs", F.lit(0.0)), F.lit(0.0)))  # one row each


def remove_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    gone = nodes.select("node")
    return edges.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti")


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges less those of ``gone``, in either direction."""
    return edges.join(both_ways(gone), ["a", "b"], "left_anti")


def loop_dominance(loops: DataFrame, top: int = 10) -> DataFrame:
    """(loop, gain, polarity, length) ranked by absolute gain, with the share of all gains."""
    total = loops.agg(F.sum(F.abs("gain")).alias("_all"))  # one row
    best = loops.orderBy(F.desc(F.abs("gain")), "length", "loop").limit(top)
    w = Window.orderBy(F.desc(F.abs("gain")), "length", "loop")
    return best.crossJoin(total).select("loop", "polarity", "gain", F.row_number().over(w).alias("rank"), (F.abs("gain") / F.nullif("_all", F.lit(0))).alias("gain_share"))


def on_cycles(edges: DataFrame, spark: SparkSession) -> DataFrame:
    """Nodes of (src, dst) edges that lie on a directed cycle: justifications that rest on themselves.

    Nodes without a way in or out are peeled first, which leaves only cycles and what lies
    between them; then each is asked whether it reaches itself.
    """
    store = Store(spark, "cycles")
    live = store.put(edges.select("src", "dst").distinct())
    n, before = live.count(), -1
    while n != before:
        before = n
        live = store.put(live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
        n = live.count()
    step = live.select(F.col("src").alias("parent"), F.col("dst").alias("id"))
    loops = live.where("src = dst").select(F.col("src").alias("node"))
    starts = live.where("src <> dst").select(F.col("dst").alias("id")).distinct()
    back = descend(step, starts, spark).select(F.col("root").alias("dst"), F.col("id").alias("src"))  # dst reaches src
    return live.where("src <> dst").join(back, ["src", "dst"], "left_semi").select(F.col("src").alias("node")).union(loops).distinct()


MOST_TRAVERSALS = 64  # Fixed value: loop budget of a cyclic component


def validate_topology(nodes: DataFrame, edges: DataFrame, spark: SparkSession) -> DataFrame:
    """(rule, item) of everything that keeps a topology from running.

    ``nodes`` (id, is_entry, is_terminal); ``edges`` (src, dst, probability, max_traversals or null,
    attempts).  Rules: reachable from the entry, reaches a terminal, no cycle of unbounded
    edges, loop budget within bounds, outgoing probability in (0, 1], and 1 at the entry.
    """
    step = edges.select(F.col("src").alias("parent"), F.col("dst").alias("id"))
    turned = edges.select(F.col("dst").alias("parent"), F.col("src").alias("id"))
    seen = descend(step, nodes.where("is_entry").select("id"), spark).select("id").distinct()
    ends = descend(turned, nodes.where("is_terminal").select("id"), spark).select("id").distinct()
    loops = on_cycles(edges, spark)
    free = on_cycles(edges.where("max_traversals IS NULL"), spark)
    # of the edges inside cycles, by component
    inside = edges.join(loops.select(F.col("node").alias("src")), "src", "left_semi").join(loops.select(F.col("node").alias("dst")), "dst", "left_semi")
    store = Store(spark, "topology")
    ids = nodes.select("id", F.xxhash64("id").alias("h"))
    inside = store.put(inside.join(ids.select(F.col("id").alias("src"), F.col("h").alias("a")), "src").join(ids.select(F.col("id").alias("dst"), F.col("h").alias("b")), "dst"))
    label = components(inside, store)
    budget = inside.join(label.select(F.col("node").alias("a"), "label"), "a", "left").groupBy(F.coalesce("label", "a").alias("label")).agg(F.sum(F.col("max_traversals") * F.col("attempts")).alias("budget"), F.min("src").alias("item"))
    mass = nodes.join(edges.groupBy(F.col("src").alias("id")).agg(F.sum("probability").alias("mass")), "id", "left")
    found = lambda df, rule, item="id": df.select(F.lit(rule).alias("rule"), F.col(item).cast("string").alias("item"))
    parts = [
        found(nodes.join(seen, "id", "left_anti"), "unreachable"),
        found(nodes.join(ends, "id", "left_anti"), "cannot_end"),
        found(free, "unbounded_cycle", "node"),
        found(budget.where(F.col("budget") > MOST_TRAVERSALS), "loop_budget", "item"),
        found(mass.where("NOT is_terminal AND mass IS NULL"), "no_way_out"),
        found(mass.where("mass <= 0 OR mass > 1.000001"), "probability_mass"),
        found(mass.where("is_entry AND abs(coalesce(mass, 0) - 1) > 0.000001"), "entry_mass"),
    ]
    return reduce(DataFrame.unionByName, parts)


def label_propagation(edges: DataFrame, spark: SparkSession, rounds: int = 20) -> DataFrame:
    """(node, community): each round a node takes the most frequent label around it, the least of equals.

    Rounds are synchronous, with the node's own label counted once; they end when nothing
    changes or after ``rounds``.
    """
    store = Store(spark, "labels")
    both = store.put(both_ways(edges))
    label = store.put(both.select(F.col("a").alias("node"), F.col("a").alias("community")).distinct())
    for _ in range(rounds):
        votes = both.join(label.select(F.col("node").alias("b"), "community"), "b").select(F.col("a").alias("node"), "community").unionByName(label)
        new = votes.groupBy("node", "community").agg(F.count("*").alias("k")).groupBy("node").agg(F.min_by("community", F.struct(-F.col("k"), F.col("community"))).alias("community"))
        new = store.put(new)
        changed = new.join(label.withColumnRenamed("community", "old"), "node").where("community <> old")
        done = changed.isEmpty()
        store.drop(label)
        label = new
        if done:
            break
    return label


def betweenness(edges: DataFrame, sources: DataFrame, most_edges: int = 5_000_000) -> DataFrame:
    """(node, betweenness) of an undirected graph, summed over a stated set of sources.

    Up to ``most_edges`` (16 bytes each) the edge list is broadcast, one breadth-first pass per
    source, and sources are spread over tasks.  Beyond, the levels are written tables.
    """
    import numpy as np
    import pandas as pd

    store = Store(edges.sparkSession, "betweenness")
    edges = store.put(edges.select("a", "b"))
    if edges.count() > most_edges:
        return _betweenness_by_levels(edges, sources, store)
    got = edges.select("a", "b").toArrow()
    shared = edges.sparkSession.sparkContext.broadcast((got["a"].to_numpy(), got["b"].to_numpy()))

    def step(batches):
        a, b = shared.value
        ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
        src, dst = np.concatenate([flat[: len(a)], flat[len(a) :]]), np.concatenate([flat[len(a) :], flat[: len(a)]])
        total = np.zeros(len(ids))
        for pdf in batches:
            for s in pdf.node:
                at = int(np.searchsorted(ids, s))
                if at == len(ids) or ids[at] != s:
                    continue
                depth, ways, level = np.full(len(ids), -1), np.zeros(len(ids)), 0
                depth[at], ways[at] = 0, 1
                while True:  # level by level over all edges
                    front = (depth[src] == level) & ((depth[dst] < 0) | (depth[dst] == level + 1))
                    if not front.any():
                        break
                    depth[dst[front]] = level + 1
                    np.add.at(ways, dst[front], ways[src[front]])
                    level += 1
                owed = np.zeros(len(ids))
                for k in range(level, 0, -1):
                    down = (depth[dst] == k) & (depth[src] == k - 1)
                    np.add.at(owed, src[down], ways[src[down]] / ways[dst[down]] * (1 + owed[dst[down]]))
                owed[at] = 0
                total += owed
        hit = total > 0
        yield pd.DataFrame({"node": ids[hit], "x": total[hit]})

    return sources.select("node").mapInPandas(step, "node long, x double").groupBy("node").agg((F.sum("x") / 2).alias("betweenness"))


def _betweenness_by_levels(edges: DataFrame, sources: DataFrame, store: Store) -> DataFrame:
    """The same by joins: shortest ways from every source level by level, and what is owed back up."""
    both = store.put(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    times = store.put(sources.groupBy(F.col("node").alias("source")).agg(F.count("*").alias("times")))
    levels = [store.put(times.select("source", F.col("source").alias("node"), F.lit(1.0).alias("ways")))]
    while True:
        front = levels[-1].select("source", F.col("node").alias("a"), "ways")
        near = both.join(front, "a").groupBy("source", F.col("b").alias("node")).agg(F.sum("ways").alias("ways"))
        for seen in levels[-2:]:  # neighbours are at most one level apart
            near = near.join(seen.select("source", "node"), ["source", "node"], "left_anti")
        levels.append(store.put(near))
        if levels[-1].isEmpty():
            break
    owed, out = levels.pop().select("source", "node", F.lit(0.0).alias("share")), []
    for level in levels[:0:-1]:
        due = both.join(owed.withColumnRenamed("node", "a"), "a").groupBy("source", F.col("b").alias("node")).agg(F.sum("share").alias("due"))
        level = store.put(level.join(due, ["source", "node"], "left").select("source", "node", "ways", (F.col("ways") * F.coalesce("due", F.lit(0.0))).alias("owed")))
        owed = level.select("source", "node", ((1 + F.col("owed")) / F.col("ways")).alias("share"))
        out.append(level.where("owed > 0").select("source", "node", "owed"))
    if not out:
        return levels[0].select("node", F.lit(0.0).alias("betweenness")).limit(0)
    return reduce(DataFrame.unionByName, out).join(times, "source").groupBy("node").agg((F.sum(F.col("owed") * F.col("times")) / 2).alias("betweenness"))


def small_world(nodes: DataFrame, key: str, n: int, near: int, rewire: float, seed: str = "31") -> DataFrame:
    """(a, k, b): ring of nodes 0 .. n - 1, each linked to the next ``near``, ends moved with a probability, by keyed draws."""
    from .calibration import uniform

    e = nodes.select(F.col(key).cast("long").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(near))).alias("k"))
    far = F.floor(uniform(seed, F.col("a"), F.col("k"), "to") * n)
    return e.select("a", "k", F.when(uniform(seed, F.col("a"), F.col("k"), "move") < rewire, far).otherwise((F.col("a") + F.col("k")) % n).cast("long").alias("b"))


def block_model(nodes: DataFrame, inside: float, between: float, seed: str = "37", most: int = 20_000) -> DataFrame:
    """(a, b) of a stochastic block model over (node, community), by a keyed draw for every pair.

    With equal probabilities this is the random graph of Erdos and Renyi.  The model itself
    asks every pair, so it is refused beyond ``most`` nodes.
    """
    from .calibration import uniform

    if (n := nodes.count()) > most:
        raise ValueError(f"{n} nodes; every pair of them would be drawn")
    x, y = nodes.select(F.col("node").alias("a"), F.col("community").alias("ca")), nodes.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    p = F.when(F.col("ca") == F.col("cb"), inside).otherwise(between)
    return x.join(y, F.col("a") < F.col("b")).where(uniform(seed, F.col("a"), F.col("b")) < p).select("a", "b")
