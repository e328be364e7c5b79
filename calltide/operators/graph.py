"""Call-graph traversal, level by level over all roots at once.

Every level is one join of the frontier with the edges, without the nodes that a root has met before; a level's rows
are at most the pairs (root, node) that it finds first. Edges and levels are written, so lineage stays short and a lost
executor costs one level. Depths are shortest ones; where several edges lead to a node, the least path is taken. A hub's edges
are dealt out in blocks of some ``HUB``, which its rows of the frontier meet one by one, so that no task holds all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltide.operators.merge import top_per_group
from calltide.session import Scratch

#: Edges of a node, at most, that are met as one block, in the mean.
HUB = 10_000
RANK = {"high": 3, "medium": 2, "low": 1}


def blocks(step: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """step (node, next) with the ``block`` of each edge, and the hubs (node, blocks): nodes with more than ``HUB`` edges, at most
    one for so many edges. Without hubs there are no blocks, and None."""
    hubs = step.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > HUB)
    hubs = hubs.select("node", F.ceil(F.col("n") / HUB).cast("int").alias("blocks"))
    if hubs.isEmpty():
        return step, None
    dealt = step.join(hubs, "node", "left").withColumn("block", F.pmod(F.xxhash64("next"), F.coalesce("blocks", F.lit(1))).cast("int"))
    return dealt.drop("blocks"), hubs


def moved(frontier: DataFrame, step: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """frontier joined with the edges of its nodes."""
    if hubs is None:
        return frontier.join(step, "node")
    asked = frontier.join(hubs, "node", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    return asked.drop("blocks").join(step, ["node", "block"]).drop("block")


def reach(edges: DataFrame, roots: DataFrame, depth: int, backward: bool = False, paths: bool = False, ahead: bool = False) -> DataFrame:
    """(root, node, depth[, path]) within ``depth`` steps of each root (a column ``root``), the root itself at 0.
    ``edges`` has (source, target). Paths lead from the root to the node; with ``ahead`` from the node to the root."""
    scratch = Scratch(edges.sparkSession)
    near, far = ("target", "source") if backward else ("source", "target")
    step = scratch.keep(edges.select(F.col(near).alias("node"), F.col(far).alias("next")).distinct())  # made once for all levels
    dealt, hubs = blocks(step)
    if hubs is not None:
        dealt, hubs = scratch.keep(dealt), scratch.keep(hubs)
    keep = ["path"] if paths else []
    frontier = roots.select("root", F.col("root").alias("node")).distinct()
    if paths:
        frontier = frontier.withColumn("path", F.array("node"))
    frontier = scratch.keep(frontier)
    known = frontier.withColumn("depth", F.lit(0))
    longer = F.concat(F.array("next"), "path") if ahead else F.concat("path", F.array("next"))
    for k in range(1, depth + 1):
        found = moved(frontier, dealt, hubs).select("root", F.col("next").alias("node"), *([longer.alias("path")] if paths else []))
        found = found.groupBy("root", "node").agg(F.min("path").alias("path")) if paths else found.distinct()
        frontier = scratch.keep(found.join(known.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", *keep))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier.withColumn("depth", F.lit(k)))
    return known.select("root", "node", "depth", *keep)


def between(edges: DataFrame, pairs: DataFrame, depth: int = 5) -> DataFrame:
    """(root, node, depth, path) of the pairs (root, node) that a path of ``depth`` steps or fewer connects, searched from both ends:
    half of the steps forward from the roots, half backward from the other ends, which meet by a join. What grows with the number
    of steps as a power is thus two searches of half the depth. The path is the least of the shortest ones."""
    scratch = Scratch(edges.sparkSession)
    edges = scratch.keep(edges.select("source", "target").distinct())  # made once for both searches
    asked = scratch.keep(pairs.select("root", F.col("node").alias("end")).distinct())
    there = reach(edges, asked.select("root"), depth - depth // 2, paths=True).withColumnRenamed("depth", "gone")
    back = reach(edges, asked.select(F.col("end").alias("root")), depth // 2, backward=True, paths=True, ahead=True)
    back = back.select(F.col("root").alias("end"), "node", F.col("depth").alias("left"), F.col("path").alias("rest"))
    met = asked.join(there, "root").join(back, ["end", "node"])
    whole = F.concat("path", F.slice("rest", 2, depth + 1))
    best = met.groupBy("root", "end").agg(F.min(F.struct((F.col("gone") + F.col("left")).alias("depth"), whole.alias("path"))).alias("best"))
    return best.select("root", F.col("end").alias("node"), "best.depth", "best.path")


def shortest_paths(edges: DataFrame, pairs: DataFrame, depth: int = 5) -> DataFrame:
    """(root, node, depth, path) of the pairs (root, node) that a path of ``depth`` steps or fewer connects."""
    return reach(edges, pairs.select("root"), depth, paths=True).join(pairs.select("root", "node").distinct(), ["root", "node"])


def shortest_to(edges: DataFrame, roots: DataFrame, ends: DataFrame, depth: int = 5) -> DataFrame:
    """(root, node, depth, path) from roots (root) to ends (node). Depths are found backwards from the ends, without paths, and
    only edges on a shortest way are then walked forwards."""
    scratch = Scratch(edges.sparkSession)
    edges = scratch.keep(edges.select("source", "target").distinct())  # made once for both directions and all steps
    back = reach(edges, ends.select(F.col("node").alias("root")), depth, backward=True)
    back = scratch.keep(back.select(F.col("root").alias("end"), "node", F.col("depth").alias("left")))
    step = edges.select(F.col("source").alias("node"), F.col("target").alias("next"))
    at = back.join(roots.select(F.col("root").alias("node")).distinct(), "node", "left_semi")
    at = scratch.keep(at.select(F.col("node").alias("root"), "end", "node", "left", F.col("left").alias("depth"), F.array("node").alias("path")))
    done = at.where("left = 0")
    for _ in range(depth):
        ways = at.where("left > 0").join(step, "node")
        ways = ways.select("root", "end", F.col("next").alias("node"), (F.col("left") - 1).alias("left"), "depth", F.concat("path", F.array("next")).alias("path"))
        at = ways.join(back, ["end", "node", "left"], "left_semi").groupBy("root", "end", "node", "left", "depth").agg(F.min("path").alias("path"))
        at = scratch.keep(at)
        done = done.unionByName(at.where("left = 0").select(*done.columns))
    return done.select("root", F.col("end").alias("node"), "depth", "path")


def impact(edges: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """(root, n): how many different nodes reach each root within ``depth`` steps, itself included."""
    return reach(edges, roots, depth, backward=True).groupBy("root").agg(F.count("*").alias("n"))


def chain_confidence(depth: Column, source: Column) -> Column:
    return F.when(depth == 0, source).when((depth <= 2) & (source == "high"), F.lit("high")).when(depth <= 2, F.lit("medium")).otherwise(F.lit("low"))


def confidence_rank(confidence: Column) -> Column:
    return F.coalesce(*(F.when(confidence == k, F.lit(v)) for k, v in RANK.items()), F.lit(0))


def chains(edges: DataFrame, sinks: DataFrame, sources: DataFrame, depth: int = 5) -> DataFrame:
    """Every source (node, confidence, reason) met within ``depth`` steps back from each sink (root), with the path from
    the source to the sink and the chain's confidence."""
    back = reach(edges, sinks, depth, backward=True, paths=True)
    met = back.join(sources.select("node", F.col("confidence").alias("source_confidence"), "reason"), "node")
    return met.select("root", F.col("node").alias("source"), "depth", F.reverse("path").alias("path"), "reason", chain_confidence(F.col("depth"), F.col("source_confidence")).alias("confidence"))


def best_chain(found: DataFrame) -> DataFrame:
    """One chain per sink: one that leaves the sink's own method if there is one, then the surest, then the longest."""
    order = [F.desc(F.col("depth") >= 1), F.desc(confidence_rank(F.col("confidence"))), F.desc("depth"), F.asc("source")]
    return top_per_group(found, ["root"], order).drop("rank")


def propagation(path: Column) -> Column:
    return F.array_join(path, " → ")


def cross_edges(edges: DataFrame, nodes: DataFrame, place: str) -> DataFrame:
    """Edges whose ends are in different places (files, say). ``nodes`` has (node, place)."""
    a = nodes.select(F.col("node").alias("source"), F.col(place).alias("source_place"))
    b = nodes.select(F.col("node").alias("target"), F.col(place).alias("target_place"))
    return edges.join(a, "source").join(b, "target").where("source_place <> target_place")


def stats(methods: DataFrame, sources: DataFrame, found: DataFrame) -> DataFrame:
    """One row: methods looked at, sources among them, sinks with a chain, chains."""
    counted = [methods.agg(F.count("*").alias("n")).select(F.lit("methods").alias("what"), "n"), sources.agg(F.count("*").alias("n")).select(F.lit("sources").alias("what"), "n")]
    counted.append(found.agg(F.count_distinct("root").alias("n")).select(F.lit("sinks").alias("what"), "n"))
    counted.append(found.agg(F.count("*").alias("n")).select(F.lit("chains").alias("what"), "n"))
    every = counted[0].unionByName(counted[1]).unionByName(counted[2]).unionByName(counted[3])
    return every.agg(*(F.max(F.when(F.col("what") == c, F.col("n"))).alias(c) for c in ("methods", "sources", "sinks", "chains")))
