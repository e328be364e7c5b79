"""Joins over code-graph tables: nodes (id, kind, name, path, line, signature) and edges (source, target, kind, line)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calltide.operators.merge import first_wins


def method_nodes(nodes: DataFrame, name: str, kind: str = "method") -> DataFrame:
    """Nodes of a kind by name, without regard to case."""
    return nodes.where((F.col("kind") == kind) & (F.lower("name") == name.lower()))


def node_of(nodes: DataFrame, key: Sequence[str] = ("path", "name")) -> DataFrame:
    """One node for each key: of overloads, the one declared first."""
    return first_wins(nodes.select(*key, "line", "id"), list(key), ["line", "id"])


def resolved_calls(edges: DataFrame, nodes: DataFrame, kind: str = "calls") -> DataFrame:
    """Edges of a kind with the caller's and the callee's columns."""
    side = lambda role: nodes.select(*(F.col(c).alias(f"{role}_{c}") for c in nodes.columns))
    calls = edges.where(F.col("kind") == kind).select(F.col("source").alias("caller_id"), F.col("target").alias("callee_id"))
    return calls.join(side("caller"), "caller_id").join(side("callee"), "callee_id")


def unresolved_calls(references: DataFrame, nodes: DataFrame, imports: DataFrame) -> DataFrame:
    """References (id, receiver, name) whose receiver is looked up in the caller's file's imports; no receiver, ``this`` and
    ``super`` are the caller's own name, and unknown receivers stay as they are."""
    placed = references.join(nodes.select("id", "path", F.col("name").alias("caller")), "id")
    known = imports.select("path", F.col("short_name").alias("receiver"), "fqn")
    own = F.col("receiver").isNull() | F.col("receiver").isin("", "this", "super")
    target = F.when(own, F.col("caller")).otherwise(F.coalesce("fqn", "receiver"))
    return placed.join(known, ["path", "receiver"], "left").select("id", "path", "name", target.alias("target"), (own | F.col("fqn").isNotNull()).alias("known"))


def container(edges: DataFrame, nodes: DataFrame, kind: str, edge: str) -> DataFrame:
    """(id, container): the least source of the given kind with an edge into the node."""
    inside = edges.where(F.col("kind") == edge).join(nodes.where(F.col("kind") == kind).select(F.col("id").alias("source")), "source")
    return inside.groupBy(F.col("target").alias("id")).agg(F.min("source").alias("container"))


def referencers(edges: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """(id, source): what refers to each node by the given kinds of edges."""
    return edges.where(F.col("kind").isin(*kinds)).select(F.col("target").alias("id"), "source").distinct()


def focus(nodes: DataFrame, name: str, qualified: str = "signature") -> DataFrame:
    """Nodes whose name is this one, or whose qualified name contains it."""
    return nodes.where((F.col("name") == name) | F.col(qualified).contains(name))


def all_calls(edges: DataFrame, nodes: DataFrame, references: DataFrame, imports: DataFrame) -> DataFrame:
    """(id, target, resolved): calls that the graph knows, and below them those that only a name tells."""
    known = resolved_calls(edges, nodes).select(F.col("caller_id").alias("id"), F.col("callee_name").alias("target"), F.lit(True).alias("resolved"))
    return known.unionByName(unresolved_calls(references, nodes, imports).select("id", "target", F.lit(False).alias("resolved")))


def edge_metadata(edges: DataFrame, kinds: Sequence[str], schema: str, column: str = "metadata") -> DataFrame:
    """Edges of the kinds with their JSON metadata as one struct; text that is no JSON gives nulls."""
    return edges.where(F.col("kind").isin(*kinds)).withColumn(column, F.from_json(column, schema))


def class_nodes(nodes: DataFrame, name: str, kind: str = "class") -> DataFrame:
    """Nodes of a kind whose name is exactly this one."""
    return nodes.where((F.col("kind") == kind) & (F.col("name") == name))


def in_file(nodes: DataFrame, path: str | int, kind: str = "method") -> DataFrame:
    """Nodes of a kind in one file."""
    return nodes.where((F.col("kind") == kind) & (F.col("path") == path))


def edges_of(edges: DataFrame, nodes: DataFrame, kinds: Sequence[str] = (), incoming: bool = False) -> DataFrame:
    """(id, kind, other): edges that leave the nodes, or with ``incoming`` enter them; no kinds means all of them."""
    own, other = ("target", "source") if incoming else ("source", "target")
    some = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    return some.select(F.col(own).alias("id"), "kind", F.col(other).alias("other")).join(nodes.select("id").distinct(), "id", "left_semi")


def adjacency(edges: DataFrame, order: Sequence[str]) -> DataFrame:
    """(source, targets): the ends of each node's edges in order. A list holds one node's edges."""
    listed = F.array_sort(F.collect_list(F.struct(*order, "target")))
    return edges.groupBy("source").agg(F.transform(listed, lambda e: e["target"]).alias("targets"))


def node_at(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (path, name, line) with ``id``: the node declared at that line, or the first of the name where line is null or no
    node begins there."""
    first = node_of(nodes).withColumnRenamed("id", "_first")
    exact = first_wins(nodes.select("path", "name", "line", "id"), ["path", "name", "line"], ["id"]).withColumnRenamed("id", "_exact")
    return asked.join(exact, ["path", "name", "line"], "left").join(first.select("path", "name", "_first"), ["path", "name"], "left").select(*asked.columns, F.coalesce("_exact", "_first").alias("id"))


def method_info(sites: DataFrame, nodes: DataFrame) -> DataFrame:
    """sites (path, class_name, name) with ``id`` and ``signature`` of their method's node; without one ``Class.method()``."""
    known = first_wins(nodes.select("path", "name", "line", "id", "signature"), ["path", "name"], ["line", "id"]).select("path", "name", "id", F.col("signature").alias("_s"))
    out = sites.join(known, ["path", "name"], "left")
    return out.select(*sites.columns, "id", F.coalesce("_s", F.concat("class_name", F.lit("."), "name", F.lit("()"))).alias("signature"))


def parameter_types(signatures: DataFrame, imports: DataFrame) -> DataFrame:
    """(id, types) of rows (id, path, types): each short type by the file's imports, others as they are, in order."""
    each = signatures.select("id", "path", F.posexplode("types").alias("pos", "short_name"))
    told = each.join(imports.select("path", "short_name", "fqn"), ["path", "short_name"], "left")
    listed = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("fqn", "short_name").alias("type"))))
    return told.groupBy("id").agg(F.transform(listed, lambda t: t["type"]).alias("types"))


def first_caller(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, caller, caller_path, cross_file): of each node, the caller whose edge comes first (``seq``), and whether it is in
    another file."""
    first = first_wins(edges.where(F.col("kind") == "calls").select(F.col("target").alias("id"), "seq", F.col("source").alias("caller")), ["id"], ["seq", "caller"])
    place = nodes.select("id", "path")
    out = first.join(place, "id").join(place.select(F.col("id").alias("caller"), F.col("path").alias("caller_path")), "caller")
    return out.select("id", "caller", "caller_path", (F.col("path") != F.col("caller_path")).alias("cross_file"))


def object_uses(calls: DataFrame) -> DataFrame:
    """(path, class_name, scope, object, seq, how, method): every object that a call is made on (``receiver``) or that stands
    among its arguments (``argument``). What comes before or after a use is then a window over one object's rows."""
    scope = F.coalesce("method_name", F.lit("<fields>")).alias("scope")
    words = F.array_distinct(F.regexp_extract_all(F.regexp_replace("args", r'"(\\\\.|[^"\\\\])*"', ""), F.lit(r"[A-Za-z_$][\w$]*"), F.lit(0)))
    own = F.regexp_extract("receiver", r"^([A-Za-z_$][\w$]*)", 1)
    named = F.concat(F.array(F.struct(own.alias("object"), F.lit("receiver").alias("how"))), F.transform(F.filter(words, lambda w: w != own), lambda w: F.struct(w.alias("object"), F.lit("argument").alias("how"))))
    return calls.select("path", "class_name", scope, "seq", "method", F.explode(named).alias("u")).select("path", "class_name", "scope", "u.object", "seq", "u.how", "method").where("object <> ''")


def return_uses(calls: DataFrame, assigned: DataFrame) -> DataFrame:
    """(path, class_name, scope, seq, into): the variable that a call's result is given to, by a value that begins with the call on
    its line, or ``return``; null where the result is not kept."""
    scope = F.coalesce("method_name", F.lit("<fields>"))
    told = F.concat(F.when(F.col("receiver") == "", "").otherwise(F.concat("receiver", F.lit("."))), "method", F.lit("("))
    rows = calls.where("method <> '<init>'").select("path", "class_name", scope.alias("scope"), "line", "seq", "text", told.alias("told"))
    values = assigned.select("path", "class_name", "scope", "line", "name", F.regexp_replace("value", r"\s*([.(])\s*", "$1").alias("value"))
    met = rows.join(values, ["path", "class_name", "scope", "line"], "left").withColumn("hit", F.when(F.col("value").startswith(F.col("told")), F.col("name")))
    kept = met.groupBy("path", "class_name", "scope", "seq").agg(F.min("hit").alias("hit"), F.first("text").alias("text"))
    return kept.select("path", "class_name", "scope", "seq", F.coalesce("hit", F.when(F.col("text").rlike(r"(^|[^A-Za-z0-9_])return "), F.lit("return"))).alias("into"))


def history(rows: DataFrame, group: Sequence[str], order: Sequence[str], record: Column, what: Column) -> DataFrame:
    """rows with ``n_prior`` and ``n_later``, how many rows of the group where ``what`` holds stand before and after, and the record
    of the nearest ones, ``previous`` and ``next``. A row carries its place, not the list: ``histories`` has each list once."""
    w = Window.partitionBy(*group).orderBy(*order)
    kept, hit = F.when(what, record), F.when(what, 1).otherwise(0)
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    whole, upto = F.sum(hit).over(Window.partitionBy(*group)), F.coalesce(F.sum(hit).over(before), F.lit(0))
    out = rows.withColumn("n_prior", upto).withColumn("n_later", whole - upto - hit)
    return out.withColumn("previous", F.last(kept, ignorenulls=True).over(before)).withColumn("next", F.first(kept, ignorenulls=True).over(after))


def histories(rows: DataFrame, group: Sequence[str], order: Sequence[str], record: Column, what: Column) -> DataFrame:
    """(group, records): the records where ``what`` holds, in order, once for each group: one object in one method."""
    listed = F.array_sort(F.collect_list(F.struct(*order, record.alias("_record"))))
    return rows.where(what).groupBy(*group).agg(F.transform(listed, lambda r: r["_record"]).alias("records"))
