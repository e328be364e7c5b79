"""Queries of the code-graph joins: orders as nodes, the edges of ``graph_queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calltide.operators import codegraph
from calltide.plans.graph_queries import EDGES, edges
from calltide.session import read_table


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("name"), F.col("o_custkey").alias("path"), F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("line"))


def resolved_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = codegraph.resolved_calls(edges(spark, sf_dir), nodes(spark, sf_dir).where("kind <> 'P'"))
    return found.select("caller_id", "callee_id", "caller_path", "caller_name", "callee_name", "caller_line")


def unresolved_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines refer to suppliers by name; a customer's imports know some of them."""
    lines = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_linenumber") == 1, "this").otherwise(F.concat(F.lit("S"), F.col("l_suppkey") % 10)).alias("receiver"), F.col("l_returnflag").alias("name")).distinct()
    imports = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), F.concat(F.lit("S"), F.col("c_nationkey") % 10).alias("short_name"), F.concat(F.lit("pkg."), "c_mktsegment", F.lit(".S"), F.col("c_nationkey") % 10).alias("fqn"))
    return codegraph.unresolved_calls(lines, nodes(spark, sf_dir), imports).groupBy("id", "name").agg(F.max("target").alias("target"), F.count_if("known").alias("known"), F.count("*").alias("n"))


def method_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codegraph.method_nodes(nodes(spark, sf_dir), "1-urgent", "F").select("id", "path", "line")


def node_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codegraph.node_of(nodes(spark, sf_dir)).select("path", "name", "id")


def container(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codegraph.container(edges(spark, sf_dir), nodes(spark, sf_dir), "F", "references")


def class_referencers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codegraph.referencers(edges(spark, sf_dir), ["references", "instantiates"]).groupBy("id").agg(F.count("*").alias("n"), F.min("source").alias("first"))


def object_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user's purchases of one kind were before and after it."""
    events = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    found = codegraph.history(events, ["user_id", "k"], ["event_id"], F.concat_ws(":", "event_type", "event_id"), F.col("event_type").isin("purchase", "error"))
    return found.select("event_id", "n_prior", "n_later", F.coalesce("previous", F.lit("")).alias("previous"), F.coalesce("next", F.lit("")).alias("next"))


def object_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's purchases and errors of one kind, as one list."""
    events = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    found = codegraph.histories(events, ["user_id", "k"], ["event_id"], F.concat_ws(":", "event_type", "event_id"), F.col("event_type").isin("purchase", "error"))
    return found.select("user_id", "k", F.array_join("records", ",").alias("records"))


def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of the graph and those told by name only, counted by what they meet."""
    lines = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("S"), F.col("l_suppkey") % 10).alias("receiver"), F.col("l_returnflag").alias("name")).distinct()
    imports = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), F.concat(F.lit("S"), F.col("c_nationkey") % 10).alias("short_name"), F.concat(F.lit("pkg."), "c_mktsegment").alias("fqn"))
    return codegraph.all_calls(edges(spark, sf_dir), nodes(spark, sf_dir), lines, imports).groupBy("target", "resolved").agg(F.count("*").alias("n"), F.min("id").alias("first"))


def class_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by exact name, and those of one file."""
    found = codegraph.class_nodes(nodes(spark, sf_dir), "1-URGENT", "O").select("id", F.lit("name").alias("by"))
    return found.unionByName(codegraph.in_file(nodes(spark, sf_dir), 7, "O").select("id", F.lit("file").alias("by")))


def edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that leave finished orders, of all kinds, and calls that enter them."""
    some = nodes(spark, sf_dir).where("kind = 'F'")
    out = codegraph.edges_of(edges(spark, sf_dir), some).withColumn("way", F.lit("out"))
    return out.unionByName(codegraph.edges_of(edges(spark, sf_dir), some, ["calls"], incoming=True).withColumn("way", F.lit("in")))


def node_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order asked for by customer, priority and day; every third one without the day, every fifth with a wrong one."""
    n = nodes(spark, sf_dir)
    line = F.when(F.col("id") % 3 == 0, F.lit(None).cast("int")).when(F.col("id") % 5 == 0, 1).otherwise(F.col("line"))
    return codegraph.node_at(n, n.select("path", "name", line.alias("line"), F.col("id").alias("asked"))).select("asked", "id")


def method_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).where("kind <> 'O'").withColumn("signature", F.concat_ws(" ", "kind", "id"))
    sites = nodes(spark, sf_dir).select("path", F.col("kind").alias("class_name"), "name", F.col("id").alias("site"))
    return codegraph.method_info(sites, n).select("site", F.coalesce("id", F.lit(-1)).alias("id"), "signature")


def parameter_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of an order as types, by the customer's imports."""
    lines = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat(F.lit("S"), F.col("l_suppkey") % 10).alias("t")))).alias("x"))
    rows = lines.join(nodes(spark, sf_dir), F.col("l_orderkey") == F.col("id")).select("id", "path", F.col("x.t").alias("types"))
    imports = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), F.concat(F.lit("S"), F.col("c_nationkey") % 10).alias("short_name"), F.concat(F.lit("pkg."), "c_mktsegment").alias("fqn"))
    return codegraph.parameter_types(rows, imports).select("id", F.array_join("types", ",").alias("types"))


def first_caller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codegraph.first_caller(edges(spark, sf_dir).withColumn("seq", F.col("source")), nodes(spark, sf_dir))


_NODES = "n AS (SELECT o_orderkey AS id, o_orderstatus AS kind, o_orderpriority AS name, o_custkey AS path, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS line FROM orders)"
QUERIES = {
    "resolved_calls": (
        resolved_calls,
        f"WITH {EDGES}, {_NODES} SELECT a.id AS caller_id, b.id AS callee_id, a.path AS caller_path, a.name AS caller_name, b.name AS callee_name, a.line AS caller_line FROM e JOIN n a ON a.id = source JOIN n b ON b.id = target WHERE e.kind = 'calls' AND a.kind <> 'P' AND b.kind <> 'P'",
    ),
    "unresolved_calls": (
        unresolved_calls,
        f"""WITH {_NODES}, l AS (SELECT DISTINCT l_orderkey AS id, CASE WHEN l_linenumber = 1 THEN 'this' ELSE 'S' || (l_suppkey % 10) END AS receiver, l_returnflag AS name FROM lineitem),
r AS (SELECT l.id, l.name, CASE WHEN receiver = 'this' THEN n.name WHEN receiver = 'S' || (c_nationkey % 10) THEN 'pkg.' || c_mktsegment || '.' || receiver ELSE receiver END AS target, receiver = 'this' OR receiver = 'S' || (c_nationkey % 10) AS known
FROM l JOIN n USING (id) JOIN customer ON c_custkey = path)
SELECT id, name, max(target) AS target, count(*) FILTER (WHERE known) AS known, count(*) AS n FROM r GROUP BY id, name""",
    ),
    "method_lookup": (method_lookup, f"WITH {_NODES} SELECT id, path, line FROM n WHERE kind = 'F' AND lower(name) = '1-urgent'"),
    "node_of": (node_of, f"WITH {_NODES} SELECT path, name, arg_min(id, (line, id)) AS id FROM n GROUP BY path, name"),
    "container": (container, f"WITH {EDGES}, {_NODES} SELECT target AS id, min(source) AS container FROM e JOIN n ON n.id = source WHERE e.kind = 'references' AND n.kind = 'F' GROUP BY target"),
    "class_referencers": (class_referencers, f"WITH {EDGES} SELECT target AS id, count(DISTINCT source) AS n, min(source) AS first FROM e WHERE kind IN ('references', 'instantiates') GROUP BY target"),
    "object_history": (
        object_history,
        """WITH v AS (SELECT event_id, user_id, json_extract_string(props, '$.k') AS k, CASE WHEN event_type IN ('purchase', 'error') THEN event_type || ':' || event_id END AS rec FROM events)
SELECT event_id, count(rec) OVER b AS n_prior, count(rec) OVER a AS n_later, coalesce(last_value(rec IGNORE NULLS) OVER b, '') AS previous, coalesce(first_value(rec IGNORE NULLS) OVER a, '') AS next FROM v
WINDOW b AS (PARTITION BY user_id, k ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY user_id, k ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)""",
    ),
    "object_histories": (
        object_histories,
        "SELECT user_id, json_extract_string(props, '$.k') AS k, string_agg(event_type || ':' || event_id, ',' ORDER BY event_id) AS records FROM events WHERE event_type IN ('purchase', 'error') GROUP BY ALL",
    ),
    "call_sites": (
        call_sites,
        f"""WITH {EDGES}, {_NODES}, l AS (SELECT DISTINCT l_orderkey AS id, 'S' || (l_suppkey % 10) AS receiver, l_returnflag AS name FROM lineitem),
u AS (SELECT source AS id, b.name AS target, true AS resolved FROM e JOIN n a ON a.id = source JOIN n b ON b.id = target WHERE e.kind = 'calls'
UNION ALL SELECT l.id, CASE WHEN receiver = 'S' || (c_nationkey % 10) THEN 'pkg.' || c_mktsegment ELSE receiver END, false FROM l JOIN n USING (id) JOIN customer ON c_custkey = path)
SELECT target, resolved, count(*) AS n, min(id) AS first FROM u GROUP BY target, resolved""",
    ),
    "class_lookup": (class_lookup, f"WITH {_NODES} SELECT id, 'name' AS by FROM n WHERE kind = 'O' AND name = '1-URGENT' UNION ALL SELECT id, 'file' FROM n WHERE kind = 'O' AND path = 7"),
    "edges_of": (
        edges_of,
        f"""WITH {EDGES}, {_NODES} SELECT source AS id, e.kind, target AS other, 'out' AS way FROM e JOIN n ON n.id = source WHERE n.kind = 'F'
UNION ALL SELECT target, e.kind, source, 'in' FROM e JOIN n ON n.id = target WHERE n.kind = 'F' AND e.kind = 'calls'""",
    ),
    "node_at": (
        node_at,
        f"""WITH {_NODES}, f AS (SELECT path, name, arg_min(id, (line, id)) AS id FROM n GROUP BY path, name), x AS (SELECT path, name, line, min(id) AS id FROM n GROUP BY ALL),
a AS (SELECT path, name, id AS asked, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 5 = 0 THEN 1 ELSE line END AS line FROM n)
SELECT asked, coalesce(x.id, f.id) AS id FROM a LEFT JOIN x ON x.path = a.path AND x.name = a.name AND x.line = a.line LEFT JOIN f ON f.path = a.path AND f.name = a.name""",
    ),
    "method_info": (
        method_info,
        f"""WITH {_NODES}, k AS (SELECT path, name, arg_min(id, (line, id)) AS id, arg_min(kind || ' ' || id, (line, id)) AS signature FROM n WHERE kind <> 'O' GROUP BY path, name)
SELECT n.id AS site, coalesce(k.id, -1) AS id, coalesce(k.signature, n.kind || '.' || n.name || '()') AS signature FROM n LEFT JOIN k USING (path, name)""",
    ),
    "parameter_types": (
        parameter_types,
        """WITH t AS (SELECT l_orderkey AS id, l_linenumber AS pos, o_custkey AS path, 'S' || (l_suppkey % 10) AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT id, string_agg(CASE WHEN s = 'S' || (c_nationkey % 10) THEN 'pkg.' || c_mktsegment ELSE s END, ',' ORDER BY pos, s) AS types FROM t JOIN customer ON c_custkey = path GROUP BY id""",
    ),
    "first_caller": (
        first_caller,
        f"""WITH {EDGES}, {_NODES}, c AS (SELECT target AS id, min(source) AS caller FROM e WHERE kind = 'calls' GROUP BY target)
SELECT c.id, caller, b.path AS caller_path, a.path <> b.path AS cross_file FROM c JOIN n a ON a.id = c.id JOIN n b ON b.id = caller""",
    ),
}
