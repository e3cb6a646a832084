"""Iterative graph operators over edge tables. Each round is a join; lineage is cut by a checkpoint."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.operators.skew import first_by, top_k
from pathloom.session import cut_lineage, stored


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def stored_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges written once, laid out by source, so rounds neither derive nor shuffle them again."""
    return cut_lineage(edges.select("src", "dst").distinct().repartition("src"))


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, stored: bool = False) -> DataFrame:
    """Every (seed, node) with its least depth, seeds at depth 0; ``edges(src, dst)``, ``seeds(seed, node)``.

    A round extends only the pairs first found in the round before, less all pairs already known. ``stored`` says
    the edges are a table already.
    """
    edges = edges if stored else stored_edges(edges)
    frontier = cut_lineage(seeds.select("seed", "node").distinct())
    parts, depth = [frontier.withColumn("depth", F.lit(0))], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(edges, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        frontier = cut_lineage(step.join(_union(parts), ["seed", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        parts.append(frontier.withColumn("depth", F.lit(depth)))
    return _union(parts)


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def hop_distance(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, stored: bool = False) -> DataFrame:
    """Least hops from any seed node to each node: ``node, depth``."""
    one = seeds.select(F.lit(0).alias("seed"), "node")
    return reach(edges, one, max_depth, stored).drop("seed")


def cheapest(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Least summed ``cost`` from any seed to each node, with the parent on the best path (least parent on ties)."""
    edges = cut_lineage(edges.groupBy("src", "dst").agg(F.min("cost").alias("step")).repartition("src"))
    known = cut_lineage(seeds.select("node").distinct().select("node", F.lit(0).cast("long").alias("cost"), F.lit(None).cast(dict(edges.dtypes)["src"]).alias("parent")))
    changed = known
    while True:
        offers = (
            changed.join(edges, F.col("node") == F.col("src"))
            .select(F.col("dst").alias("node"), (F.col("cost") + F.col("step")).alias("cost"), F.col("src").alias("parent"))
        )
        offers = first_by(offers, ["node"], ["cost", "parent"])
        better = offers.join(known.select("node", F.col("cost").alias("__old"), F.col("parent").alias("__p")), "node", "left").filter(
            F.col("__old").isNull() | (F.col("cost") < F.col("__old"))
            | ((F.col("cost") == F.col("__old")) & F.col("__p").isNotNull() & (F.col("parent") < F.col("__p")))
        ).select("node", "cost", "parent")
        changed = cut_lineage(better)
        if changed.isEmpty():
            return known
        known = cut_lineage(known.join(changed.select("node"), "node", "left_anti").unionByName(changed))


def meet_nodes(edges: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """Nodes on a source-to-sink walk, with the cost of the cheapest one through each."""
    edges = cut_lineage(edges)
    ahead = cheapest(edges, sources).select("node", F.col("cost").alias("from_source"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost")
    behind = cheapest(back, sinks).select("node", F.col("cost").alias("to_sink"))
    return ahead.join(behind, "node").withColumn("total", F.col("from_source") + F.col("to_sink"))


def components(edges: DataFrame) -> DataFrame:
    """Least node id of each undirected component.

    A round points every node at its least neighbour, follows the pointers to their ends and keeps only the edges between
    different ends. An end has a neighbour that is none, so at most half the nodes are left: rounds are few and their
    tables shrink. A node's component is then the end of its end.
    """
    known = edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL")
    both = stored(known.unionByName(reverse(known)).distinct())
    ends = []
    while True:
        up = stored(both.groupBy("src").agg(F.min("dst").alias("least")).select(F.col("src").alias("node"), F.least("src", "least").alias("up")))
        while True:
            further = up.select(F.col("node").alias("up"), F.col("up").alias("end"))
            jumped = stored(up.select("node", "up").join(further, "up").select("node", F.col("end").alias("up"), (F.col("end") != F.col("up")).alias("moved")))
            up = jumped
            if jumped.filter("moved").isEmpty():
                break
        up = up.select("node", "up")
        ends.append(up)
        left, right = up.select(F.col("node").alias("src"), F.col("up").alias("a")), up.select(F.col("node").alias("dst"), F.col("up").alias("b"))
        both = stored(both.join(left, "src").join(right, "dst").filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
        if both.isEmpty():
            break
    labels = ends.pop().select("node", F.col("up").alias("label"))
    for up in reversed(ends):
        later = labels.select(F.col("node").alias("up"), "label")
        labels = up.join(later, "up", "left").select("node", F.coalesce("label", "up").alias("label"))
    return stored(labels)


def simple_paths(
    edges: DataFrame, inputs: DataFrame, effects: DataFrame, max_depth: int, per_pair: int | None,
    order: Sequence[Column] | None = None,
) -> DataFrame:
    """Cycle-free paths from inputs to the first effect met, in depth-first edge order, ``per_pair`` kept.

    A branch is dropped early only when no effect lies within its remaining depth, so nothing found is lost.
    ``path`` is the node list; ``step_keys`` is the list of edge order keys that ranks paths within a pair.
    """
    edges, effects = cut_lineage(edges), cut_lineage(effects.select("node").distinct())
    within = hop_distance(reverse(edges), effects, max_depth)
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order or [F.col("dst")])])
    steps = edges.withColumn("__key", key).select("src", "dst", "__key").join(
        within.select(F.col("node").alias("dst"), F.col("depth").alias("__left")), "dst")
    steps = cut_lineage(steps.repartition("src"))
    goal = effects.select(F.col("node").alias("last")).distinct()
    start = inputs.select("node").distinct()
    start = start.join(within.select("node"), "node", "left_semi")
    open_ = start.select(F.col("node").alias("first"), F.col("node").alias("last"), F.array("node").alias("path"))
    open_ = open_.withColumn("step_keys", F.array().cast(f"array<{steps.schema['__key'].dataType.simpleString()}>"))
    done = []
    for depth in range(1, max_depth + 1):
        grown = (
            open_.join(steps, F.col("last") == F.col("src"))
            .filter((F.col("__left") <= max_depth - depth) & ~F.array_contains("path", F.col("dst")))
            .select("first", F.col("dst").alias("last"), F.concat("path", F.array("dst")).alias("path"),
                    F.concat("step_keys", F.array("__key")).alias("step_keys"))
        )
        grown = cut_lineage(grown.join(goal.withColumn("__hit", F.lit(True)), "last", "left"))
        done.append(grown.filter("__hit").drop("__hit"))
        open_ = grown.filter("__hit IS NULL").drop("__hit")
        if depth < max_depth and open_.isEmpty():
            break
    found = _union(done).select(F.col("first").alias("input"), F.col("last").alias("effect"), "path", "step_keys")
    found = found.withColumn("length", F.size("path") - 1)
    if per_pair is None:
        return found
    return top_k(found, ["input", "effect"], [F.col("step_keys")], per_pair).drop("rank")


def search_counters(edges: DataFrame, inputs: DataFrame, effects: DataFrame, paths: DataFrame) -> DataFrame:
    """Paths kept, pairs reached and pairs left without a path."""
    pairs = paths.select("input", "effect").distinct().agg(F.count(F.lit(1)).alias("reached_pairs"))
    total = paths.agg(F.count(F.lit(1)).alias("paths"), F.max("length").alias("longest"))
    ends = inputs.select("node").distinct().agg(F.count(F.lit(1)).alias("__i")).join(
        F.broadcast(effects.select("node").distinct().agg(F.count(F.lit(1)).alias("__e"))))
    return total.join(F.broadcast(pairs)).join(F.broadcast(ends)).select(
        "paths", "longest", "reached_pairs", (F.col("__i") * F.col("__e") - F.col("reached_pairs")).alias("no_path_pairs"))


def subgraph(edges: DataFrame, seeds: DataFrame, max_depth: int, max_nodes: int, max_edges: int) -> DataFrame:
    """Edges between the first ``max_nodes`` nodes by (depth, id), at most ``max_edges``, with a truncated flag."""
    edges = stored_edges(edges)
    near = cut_lineage(hop_distance(edges, seeds, max_depth, stored=True))
    nodes = near.orderBy("depth", "node").limit(max_nodes)
    inside = edges.join(nodes.select(F.col("node").alias("src"), F.col("depth").alias("__d")).filter(F.col("__d") < max_depth), "src")
    inside = inside.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst", "__d")
    size = near.agg((F.count(F.lit(1)) > max_nodes).alias("__n")).join(F.broadcast(inside.agg((F.count(F.lit(1)) > max_edges).alias("__e"))))
    kept = inside.orderBy("__d", "src", "dst").limit(max_edges)
    return kept.join(F.broadcast(size)).select("src", "dst", F.col("__d").alias("depth"), (F.col("__n") | F.col("__e")).alias("truncated"))


def nearest(edges: DataFrame, seeds: DataFrame, flagged: DataFrame, max_depth: int) -> DataFrame:
    """Per seed the least-depth flagged node on a walk of at most ``max_depth`` edges (least id on ties)."""
    hits = reach(edges, seeds, max_depth).join(flagged.select("node").distinct(), "node", "left_semi")
    return first_by(hits, ["seed"], ["depth", "node"])
