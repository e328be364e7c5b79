"""Queries of the graph operators. Orders are methods; an order calls the customer's next order, and the next order that
holds the same part from the same supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calltide.operators import codegraph, graph, merge
from calltide.session import read_table


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    by_customer = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    own = orders.select(F.col("o_orderkey").alias("source"), F.lead("o_orderkey").over(by_customer).alias("target"), F.lit("calls").alias("kind"))
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    by_part = Window.partitionBy("l_partkey", "l_suppkey").orderBy("l_orderkey")
    shared = lines.select(F.col("l_orderkey").alias("source"), F.lead("l_orderkey").over(by_part).alias("target"), F.lit("references").alias("kind"))
    return own.unionByName(shared).where("target is not null").distinct()


EDGES = """
  e AS (SELECT DISTINCT source, target, kind FROM (
    SELECT o_orderkey AS source, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS target, 'calls' AS kind FROM orders
    UNION ALL
    SELECT l_orderkey, lead(l_orderkey) OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey), 'references' FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem)
  ) WHERE target IS NOT NULL)"""


def _walk(roots: str, near: str, far: str, depth: int, path: bool = False) -> str:
    """A recursive CTE over the edges; with paths it enumerates them."""
    p0, p1 = (", [o_orderkey] AS path", f", list_append(r.path, s.{far})") if path else ("", "")
    join = "UNION ALL" if path else "UNION"
    return f"""{EDGES}, s AS (SELECT DISTINCT source, target FROM e),
  r AS (SELECT o_orderkey AS root, o_orderkey AS node, 0 AS depth{p0} FROM orders WHERE {roots}
    {join} SELECT r.root, s.{far}, r.depth + 1{p1} FROM r JOIN s ON s.{near} = r.node WHERE r.depth < {depth})"""


def _roots(spark: SparkSession, sf_dir: str, condition: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").where(condition).select(F.col("o_orderkey").alias("root"))


EVERY, URGENT, DEAR = "o_orderkey IS NOT NULL", "o_orderpriority = '1-URGENT'", "o_totalprice > 400000 AND o_orderstatus = 'F'"


def callers_depth1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per edge into a method, so parallel edges of different kinds repeat a caller."""
    found = codegraph.edges_of(edges(spark, sf_dir), _roots(spark, sf_dir, EVERY).withColumnRenamed("root", "id"), incoming=True)
    return found.select(F.col("id").alias("root"), F.col("other").alias("node"), "kind")


def callers_depth3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reach(edges(spark, sf_dir), _roots(spark, sf_dir, EVERY), 3, backward=True)


def callees_depth3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reach(edges(spark, sf_dir), _roots(spark, sf_dir, EVERY), 3)


def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From urgent orders to every dear finished order within five calls; the search begins at the fewer ends."""
    sinks = _roots(spark, sf_dir, DEAR).withColumnRenamed("root", "node")
    found = graph.shortest_to(edges(spark, sf_dir), _roots(spark, sf_dir, URGENT), sinks, 5)
    return found.select("root", "node", "depth", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


def pair_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many calls lead from each order to its customer's last one, four at most, searched from both ends."""
    orders = read_table(spark, sf_dir, "orders")
    last = orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("node"))
    pairs = orders.join(last, "o_custkey").select(F.col("o_orderkey").alias("root"), "node")
    found = graph.between(edges(spark, sf_dir), pairs, 4)
    return found.select("root", "node", "depth", F.size("path").alias("length"))


def impact_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.impact(edges(spark, sf_dir), _roots(spark, sf_dir, EVERY), 3)


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ways to be a source, the first that holds wins: the order's parts, its priority, its status."""
    orders = read_table(spark, sf_dir, "orders")
    named = read_table(spark, sf_dir, "lineitem").join(read_table(spark, sf_dir, "part").where("p_name rlike '^red .*(ring|gear)$' and p_size > 45"), F.col("l_partkey") == F.col("p_partkey"))
    by_name = named.select(F.col("l_orderkey").alias("node")).distinct().select("node", F.lit(1).alias("seq"), F.lit("medium").alias("confidence"), F.lit("parameter name").alias("reason"))
    rule = lambda condition, seq, confidence, reason: orders.where(condition).select(F.col("o_orderkey").alias("node"), F.lit(seq).alias("seq"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"))
    every = by_name.unionByName(rule("o_orderpriority = '1-URGENT' and o_totalprice > 450000", 2, "high", "source method")).unionByName(rule("o_orderstatus = 'P' and o_totalprice > 480000", 3, "medium", "handler class"))
    return merge.first_wins(every, ["node"], ["seq"]).select("node", "confidence", "reason")


SOURCES = """
  src AS (SELECT node, arg_min(confidence, seq) AS confidence, arg_min(reason, seq) AS reason FROM (
    SELECT DISTINCT l_orderkey AS node, 1 AS seq, 'medium' AS confidence, 'parameter name' AS reason FROM lineitem JOIN part ON l_partkey = p_partkey WHERE regexp_matches(p_name, '^red .*(ring|gear)$') AND p_size > 45
    UNION ALL SELECT o_orderkey, 2, 'high', 'source method' FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 450000
    UNION ALL SELECT o_orderkey, 3, 'medium', 'handler class' FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 480000) GROUP BY node)"""


def taint_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sources(spark, sf_dir)


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.chains(edges(spark, sf_dir), _roots(spark, sf_dir, DEAR), _sources(spark, sf_dir), 5)


def taint_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chains(spark, sf_dir).select("root", "source", "depth", "reason", "confidence")


def taint_best_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.best_chain(_chains(spark, sf_dir)).select("root", "source", "depth", "confidence", F.size("path").alias("length"))


def taint_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.best_chain(_chains(spark, sf_dir))
    return found.groupBy("confidence", "depth").agg(F.count("*").alias("chains"), F.count_distinct("source").alias("sources"))


CHAINS = f"""{_walk(DEAR, 'target', 'source', 5)}, {SOURCES.strip()},
  b AS (SELECT root, node, min(depth) AS depth FROM r GROUP BY root, node),
  c AS (SELECT root, node AS source, depth, reason, CASE WHEN depth = 0 THEN confidence WHEN depth <= 2 AND confidence = 'high' THEN 'high' WHEN depth <= 2 THEN 'medium' ELSE 'low' END AS confidence FROM b JOIN src USING (node)),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY (depth >= 1) DESC, CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, depth DESC, source) AS rn FROM c) WHERE rn = 1)"""


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_custkey").alias("place"))


def cross_file_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between orders of different customers."""
    return graph.cross_edges(edges(spark, sf_dir), _places(spark, sf_dir), "place").select("source", "target", "kind", "source_place", "target_place")


def edge_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-degree and in-degree of each method by kind of edge."""
    e, every = edges(spark, sf_dir), _roots(spark, sf_dir, EVERY).withColumnRenamed("root", "id")
    count = lambda found, way: found.groupBy(F.col("id").alias("node"), "kind").agg(F.count("*").alias("n")).withColumn("way", F.lit(way))
    return count(codegraph.edges_of(e, every), "out").unionByName(count(codegraph.edges_of(e, every, incoming=True), "in"))


def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of each method in order, as one list."""
    found = codegraph.adjacency(edges(spark, sf_dir).select("source", "target").distinct().withColumn("seq", F.col("target")), ["seq"])
    return found.select("source", F.array_join(F.col("targets").cast("array<string>"), ",").alias("targets"))


QUERIES = {
    "callers_depth1": (callers_depth1, f"WITH {EDGES} SELECT target AS root, source AS node, kind FROM e"),
    "callers_depth3": (callers_depth3, f"WITH RECURSIVE {_walk(EVERY, 'target', 'source', 3)} SELECT root, node, min(depth) AS depth FROM r GROUP BY root, node"),
    "callees_depth3": (callees_depth3, f"WITH RECURSIVE {_walk(EVERY, 'source', 'target', 3)} SELECT root, node, min(depth) AS depth FROM r GROUP BY root, node"),
    "shortest_path": (
        shortest_path,
        f"WITH RECURSIVE {_walk(URGENT, 'source', 'target', 5, path=True)}, m AS (SELECT root, node, min(depth) AS depth FROM r GROUP BY root, node) SELECT root, node, depth, array_to_string(min(path), '>') AS path FROM r JOIN m USING (root, node, depth) WHERE node IN (SELECT o_orderkey FROM orders WHERE {DEAR}) GROUP BY root, node, depth",
    ),
    "pair_paths": (
        pair_paths,
        f"""WITH RECURSIVE {EDGES}, s AS (SELECT DISTINCT source, target FROM e),
  l AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS node FROM orders GROUP BY o_custkey),
  r AS (SELECT DISTINCT node AS last, node, 0 AS depth FROM l UNION SELECT r.last, s.source, r.depth + 1 FROM r JOIN s ON s.target = r.node WHERE r.depth < 4),
  b AS (SELECT last, node, min(depth) AS depth FROM r GROUP BY last, node)
SELECT o_orderkey AS root, b.last AS node, depth, CAST(depth + 1 AS INTEGER) AS length FROM orders JOIN l USING (o_custkey) JOIN b ON b.last = l.node AND b.node = o_orderkey""",
    ),
    "impact_radius": (impact_radius, f"WITH RECURSIVE {_walk(EVERY, 'target', 'source', 3)} SELECT root, count(DISTINCT node) AS n FROM r GROUP BY root"),
    "taint_sources": (taint_sources, f"WITH {SOURCES} SELECT * FROM src"),
    "taint_chains": (taint_chains, f"WITH RECURSIVE {CHAINS} SELECT * FROM c"),
    "taint_best_chain": (taint_best_chain, f"WITH RECURSIVE {CHAINS} SELECT root, source, depth, confidence, CAST(depth + 1 AS INTEGER) AS length FROM best"),
    "taint_stats": (taint_stats, f"WITH RECURSIVE {CHAINS} SELECT confidence, depth, count(*) AS chains, count(DISTINCT source) AS sources FROM best GROUP BY confidence, depth"),
    "cross_file_edges": (
        cross_file_edges,
        f"WITH {EDGES} SELECT source, target, kind, a.o_custkey AS source_place, b.o_custkey AS target_place FROM e JOIN orders a ON a.o_orderkey = source JOIN orders b ON b.o_orderkey = target WHERE a.o_custkey <> b.o_custkey",
    ),
    "edge_kinds": (
        edge_kinds,
        f"WITH {EDGES} SELECT source AS node, kind, count(*) AS n, 'out' AS way FROM e GROUP BY ALL UNION ALL SELECT target, kind, count(*), 'in' FROM e GROUP BY ALL",
    ),
    "adjacency": (adjacency, f"WITH {EDGES} SELECT source, string_agg(target, ',' ORDER BY target) AS targets FROM (SELECT DISTINCT source, target FROM e) GROUP BY source"),
}
