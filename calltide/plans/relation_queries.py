"""Queries of the relational operators: merging, lookups, context windows, ranking, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calltide.operators import context, graph, lookup, merge
from calltide.session import read_table

_LINES = ["l_orderkey", "l_partkey"]


def _overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second source of (order, part) rows: suppliers' notes, of which some are unusable and some name new parts."""
    lines = read_table(spark, sf_dir, "lineitem")
    return lines.where("l_returnflag = 'R'").select("l_orderkey", (F.col("l_partkey") + F.when(F.col("l_quantity") > 45, 100000).otherwise(0)).alias("l_partkey"), (F.col("l_suppkey") * 1000 + F.col("l_linenumber")).alias("seq"), F.col("l_suppkey").alias("owner"), F.col("l_tax").alias("tax"))


def prefer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = read_table(spark, sf_dir, "lineitem").select(*_LINES, (F.col("l_suppkey") * 1000 + F.col("l_linenumber")).alias("seq"), F.lit(-1).cast("long").alias("owner"), "l_tax").withColumnRenamed("l_tax", "tax")
    out = merge.prefer_merge(base, _overrides(spark, sf_dir), _LINES, ["seq"], F.col("owner") % 3 != 0, ["owner"])
    return out.groupBy("source", "l_orderkey").agg(F.count("*").alias("n"), F.sum("owner").alias("owners"))


PREFER_SQL = """
WITH o AS (SELECT l_orderkey, l_partkey + CASE WHEN l_quantity > 45 THEN 100000 ELSE 0 END AS l_partkey, l_suppkey * 1000 + l_linenumber AS seq, l_suppkey AS owner FROM lineitem WHERE l_returnflag = 'R'),
last AS (SELECT l_orderkey, l_partkey, arg_max(owner, seq) AS owner FROM o GROUP BY ALL),
first AS (SELECT l_orderkey, l_partkey, arg_min(owner, seq) AS owner FROM o GROUP BY ALL),
m AS (
  SELECT CASE WHEN k.owner IS NOT NULL THEN 'override' ELSE 'base' END AS source, b.l_orderkey, coalesce(k.owner, -1) AS owner
  FROM lineitem b LEFT JOIN (SELECT * FROM last WHERE owner % 3 <> 0) k USING (l_orderkey, l_partkey)
  UNION ALL
  SELECT 'added', l_orderkey, owner FROM first WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = first.l_orderkey AND b.l_partkey = first.l_partkey))
SELECT source, l_orderkey, count(*) AS n, CAST(sum(owner) AS BIGINT) AS owners FROM m GROUP BY source, l_orderkey
"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events")


def upsert_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches: what the second adds to what the first holds."""
    events = _events(spark, sf_dir).select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"), (F.col("ts") < F.lit("2024-01-16").cast("timestamp")).alias("early"))
    key = ["user_id", "event_type", "k"]
    held = merge.first_wins(events.where("early"), key, ["event_id"])
    return merge.keep_first_upsert(held, events.where("not early"), key, ["event_id"]).select(*key, "event_id")


def last_wins_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).select("user_id", "event_type", "event_id", "props")
    return merge.last_wins(events, ["user_id", "event_type"], ["event_id"])


def scope_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's nation-wide supplier if its nation has one over 9000, else its region's, else none."""
    supplier, nation = read_table(spark, sf_dir, "supplier"), read_table(spark, sf_dir, "nation")
    rich = supplier.where("s_acctbal > 9000")
    local = rich.groupBy("s_nationkey").agg(F.min("s_name").alias("supplier"))
    wide = rich.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.max("s_name").alias("supplier"))
    customers = read_table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", F.col("n_regionkey").alias("regionkey"))
    levels = [(local, {"c_nationkey": "s_nationkey"}, "supplier", "local"), (wide, {"regionkey": "n_regionkey"}, "supplier", "field")]
    return lookup.cascade(customers, levels, F.lit("none"), "supplier", "provenance").select("c_custkey", "supplier", "provenance")


def resolve_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's owner by (brand, type), else by brand, else by type, else a fallback."""
    part = read_table(spark, sf_dir, "part")
    both = part.groupBy("p_brand", "p_type").agg(F.max("p_partkey").alias("owner"), F.count("*").alias("n")).where("n % 3 = 0")
    brand = part.groupBy("p_brand").agg(F.max("p_partkey").alias("owner"), F.count("*").alias("n")).where("n % 2 = 0")
    kind = part.groupBy("p_type").agg(F.min("p_partkey").alias("owner"), F.count("*").alias("n")).where("n % 2 = 1")
    levels = [(both, {"p_brand": "p_brand", "p_type": "p_type"}, "owner", "variable"), (brand, {"p_brand": "p_brand"}, "owner", "field"), (kind, {"p_type": "p_type"}, "owner", "import")]
    return lookup.cascade(part, levels, F.lit(-1).cast("long"), "owner", "provenance").select("p_partkey", "owner", "provenance")


def inherited_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market segments as members: each nation's own, else its region's, else those of the root, by the nearest that has it."""
    nation, region = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    supers = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("super"), F.lit(0).alias("ord"))
    supers = supers.unionByName(region.select(F.col("r_name").alias("name"), F.lit("WORLD").alias("super"), F.lit(0).alias("ord")))
    rich = read_table(spark, sf_dir, "customer").where("c_acctbal > 9900").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    wide = read_table(spark, sf_dir, "customer").where("c_acctbal > 9800").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    every = read_table(spark, sf_dir, "customer").select(F.lit("WORLD").alias("owner"), F.col("c_mktsegment").alias("member"))
    members = rich.select(F.col("n_name").alias("owner"), F.col("c_mktsegment").alias("member")).union(wide.select("r_name", "c_mktsegment")).union(every).distinct()
    customers = read_table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    asked = customers.select(F.col("n_name").alias("name"), F.col("c_mktsegment").alias("segment")).distinct()
    return lookup.inherited(asked, lookup.linearised(supers), members, "name", "segment")


def prior_later_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a user bought before and after each error."""
    events = context.usage_counts(_events(spark, sf_dir).select("event_id", "user_id", "event_type"), ["user_id"], ["event_id"], F.col("event_type") == "purchase")
    return events.where("event_type = 'error'").select("event_id", "user_id", F.col("prior").cast("long").alias("prior"), F.col("later").cast("long").alias("later"))


def first_creation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first signup of the user before each view."""
    events = context.first_before(_events(spark, sf_dir), ["user_id"], ["event_id"], F.col("event_type") == "signup", F.col("event_id"), "created")
    return events.where("event_type = 'view'").select("event_id", F.coalesce("created", F.lit(-1)).alias("created"))


def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best supplier line of each part: returned first, then the largest quantity, then the least keys."""
    lines = read_table(spark, sf_dir, "lineitem")
    order = [F.desc(F.col("l_returnflag") == "R"), F.desc("l_quantity"), F.desc("l_suppkey"), F.asc("l_orderkey"), F.asc("l_linenumber")]
    return merge.top_per_group(lines, ["l_partkey"], order).select("l_partkey", "l_suppkey", "l_orderkey", F.col("l_quantity").cast("int").alias("quantity"))


def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last purchase of the user at or before each event."""
    value = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return context.carry_forward(_events(spark, sf_dir), ["user_id"], ["event_id"], value, "purchase").select("event_id", "user_id", F.coalesce("purchase", F.lit(-1)).alias("purchase"))


def running_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the number of signups less the number of errors first rises over 0, and where it first comes back."""
    delta = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return context.first_return(_events(spark, sf_dir), ["user_id"], ["event_id"], delta).select("user_id", F.coalesce("opened", F.lit(-1)).alias("opened"), F.coalesce("closed", F.lit(-1)).alias("closed"))


def window_lookback3(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = context.look_back(_events(spark, sf_dir), ["user_id"], ["event_id"], F.col("event_type") == "error", 3, "flag")
    return events.select("event_id", F.col("flag").cast("int").alias("flag"))


def union_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled and other documents, one below the other."""
    docs, labels = read_table(spark, sf_dir, "documents").select("doc_id", "lang"), read_table(spark, sf_dir, "labels").select("doc_id").distinct()
    known = docs.join(labels, "doc_id", "left_semi").withColumn("resolved", F.lit(1))
    return known.unionByName(docs.join(labels, "doc_id", "left_anti").withColumn("resolved", F.lit(0)))


def anti_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return docs.join(read_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


def param_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any, every and different kinds of a conversation's turns."""
    turns = read_table(spark, sf_dir, "conversations")
    user, long_ = F.col("role") == "user", F.length("text") > 100
    return turns.groupBy("conv_id").agg(
        F.bool_or((F.col("role") == "system")).cast("int").alias("any_system"),
        F.bool_and(long_).cast("int").alias("all_long"),
        F.count_distinct("role").alias("kinds"),
        F.when(F.count_distinct("role") > 2, "concat").when(F.bool_and(user), "direct").otherwise("unknown").alias("composite"),
    )


def path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return turns.select("conv_id", graph.propagation(F.col("t.role")).alias("path"), F.size("t").alias("n"))


def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    return merge.first_wins(docs, ["digest"], ["doc_id"])


def severity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with counts, in the order in which they are first seen."""
    orders = read_table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("seen"))
    return orders.select("o_orderpriority", "n", "seen")


def override_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary merge: the right side's entries replace the left side's."""
    orders = read_table(spark, sf_dir, "orders")
    side = lambda flag, k: orders.where(F.col("o_orderstatus") == flag).groupBy("o_custkey").agg(F.max("o_orderkey").alias("v")).withColumn("side", F.lit(k))
    return merge.last_wins(side("O", 0).unionByName(side("F", 1)), ["o_custkey"], ["side"])


def version_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest version by text order, so that 1.9 comes after 1.10."""
    lines = read_table(spark, sf_dir, "lineitem").select("l_partkey", F.concat_ws(".", F.lit("1"), F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string")).alias("version"))
    return lines.groupBy("l_partkey").agg(F.max("version").alias("version"), F.count_distinct("version").alias("n"))


QUERIES = {
    "prefer_merge": (prefer_merge, PREFER_SQL),
    "upsert_keep_first": (
        upsert_keep_first,
        """WITH e AS (SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, ts < TIMESTAMP '2024-01-16' AS early FROM events)
SELECT user_id, event_type, k, min(event_id) AS event_id FROM e WHERE NOT early AND NOT EXISTS (SELECT 1 FROM e h WHERE h.early AND h.user_id = e.user_id AND h.event_type = e.event_type AND h.k = e.k) GROUP BY ALL""",
    ),
    "last_wins_map": (last_wins_map, "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(props, event_id) AS props FROM events GROUP BY user_id, event_type"),
    "scope_lookup": (
        scope_lookup,
        """WITH rich AS (SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 9000),
l AS (SELECT s_nationkey, min(s_name) AS v FROM rich GROUP BY ALL), w AS (SELECT n_regionkey AS r, max(s_name) AS v FROM rich GROUP BY ALL)
SELECT c_custkey, coalesce(l.v, w.v, 'none') AS supplier, CASE WHEN l.v IS NOT NULL THEN 'local' WHEN w.v IS NOT NULL THEN 'field' ELSE 'fallback' END AS provenance
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN l ON l.s_nationkey = c_nationkey LEFT JOIN w ON w.r = n_regionkey""",
    ),
    "resolve_cascade": (
        resolve_cascade,
        """WITH a AS (SELECT p_brand, p_type, max(p_partkey) AS v FROM part GROUP BY ALL HAVING count(*) % 3 = 0), b AS (SELECT p_brand, max(p_partkey) AS v FROM part GROUP BY ALL HAVING count(*) % 2 = 0),
c AS (SELECT p_type, min(p_partkey) AS v FROM part GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT p_partkey, coalesce(a.v, b.v, c.v, -1) AS owner, CASE WHEN a.v IS NOT NULL THEN 'variable' WHEN b.v IS NOT NULL THEN 'field' WHEN c.v IS NOT NULL THEN 'import' ELSE 'fallback' END AS provenance
FROM part LEFT JOIN a USING (p_brand, p_type) LEFT JOIN b USING (p_brand) LEFT JOIN c USING (p_type)""",
    ),
    "inherited_lookup": (
        inherited_lookup,
        """WITH n AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey), s AS (SELECT DISTINCT c_nationkey, c_mktsegment AS segment FROM customer),
m AS (SELECT DISTINCT n_name AS owner, c_mktsegment AS member FROM customer JOIN n ON c_nationkey = n_nationkey WHERE c_acctbal > 9900
  UNION SELECT DISTINCT r_name, c_mktsegment FROM customer JOIN n ON c_nationkey = n_nationkey WHERE c_acctbal > 9800)
SELECT n_name AS name, segment, CASE WHEN (n_name, segment) IN (SELECT (owner, member) FROM m) THEN n_name WHEN (r_name, segment) IN (SELECT (owner, member) FROM m) THEN r_name ELSE 'WORLD' END AS owner FROM n JOIN s ON c_nationkey = n_nationkey""",
    ),
    "prior_later_usage": (
        prior_later_usage,
        """SELECT a.event_id, a.user_id, count(*) FILTER (WHERE b.event_id < a.event_id) AS prior, count(*) FILTER (WHERE b.event_id > a.event_id) AS later
FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type = 'purchase' WHERE a.event_type = 'error' GROUP BY a.event_id, a.user_id""",
    ),
    "first_creation": (
        first_creation,
        "SELECT a.event_id, coalesce(min(b.event_id), -1) AS created FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type = 'signup' AND b.event_id < a.event_id WHERE a.event_type = 'view' GROUP BY a.event_id",
    ),
    "best_candidate": (
        best_candidate,
        """SELECT l_partkey, l_suppkey, l_orderkey, CAST(l_quantity AS INTEGER) AS quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY (l_returnflag = 'R') DESC, l_quantity DESC, l_suppkey DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1""",
    ),
    "carry_forward": (
        carry_forward,
        "SELECT event_id, user_id, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), -1) AS purchase FROM events",
    ),
    "running_extent": (
        running_extent,
        """WITH d AS (SELECT user_id, event_id, sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS depth FROM events),
o AS (SELECT user_id, min(event_id) FILTER (WHERE depth > 0) AS opened FROM d GROUP BY user_id)
SELECT d.user_id, coalesce(any_value(opened), -1) AS opened, coalesce(min(event_id) FILTER (WHERE depth <= 0 AND event_id > opened), -1) AS closed FROM d JOIN o USING (user_id) GROUP BY d.user_id""",
    ),
    "window_lookback3": (
        window_lookback3,
        "SELECT event_id, CAST(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS 3 PRECEDING) AS INTEGER) AS flag FROM events",
    ),
    "union_sites": (
        union_sites,
        "SELECT doc_id, lang, 1 AS resolved FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, lang, 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    ),
    "anti_sites": (anti_sites, "SELECT doc_id, source, n_chars FROM documents ANTI JOIN labels USING (doc_id)"),
    "param_flags": (
        param_flags,
        """SELECT conv_id, CAST(bool_or(role = 'system') AS INTEGER) AS any_system, CAST(bool_and(length(text) > 100) AS INTEGER) AS all_long, count(DISTINCT role) AS kinds,
CASE WHEN count(DISTINCT role) > 2 THEN 'concat' WHEN bool_and(role = 'user') THEN 'direct' ELSE 'unknown' END AS composite FROM conversations GROUP BY conv_id""",
    ),
    "path_join": (path_join, "SELECT conv_id, string_agg(role, ' → ' ORDER BY turn, role) AS path, CAST(count(*) AS INTEGER) AS n FROM conversations GROUP BY conv_id"),
    "dedupe_first": (dedupe_first, "SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, sha256(text) AS digest FROM documents GROUP BY text"),
    "severity_groups": (severity_groups, "SELECT o_orderpriority, count(*) AS n, min(o_orderkey) AS seen FROM orders GROUP BY o_orderpriority"),
    "override_union": (
        override_union,
        """WITH o AS (SELECT o_custkey, max(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL), f AS (SELECT o_custkey, max(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
SELECT o_custkey, coalesce(f.v, o.v) AS v, CASE WHEN f.v IS NOT NULL THEN 1 ELSE 0 END AS side FROM o FULL JOIN f USING (o_custkey)""",
    ),
    "version_latest": (
        version_latest,
        "SELECT l_partkey, max('1.' || l_linenumber || '.' || l_suppkey) AS version, count(DISTINCT '1.' || l_linenumber || '.' || l_suppkey) AS n FROM lineitem GROUP BY l_partkey",
    ),
}
