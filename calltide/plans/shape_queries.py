"""Queries of the Java scan over files of less simple shape: annotations with named arguments, resources, catch clauses,
re-assignment, overloads, nested types, compact constructors; and of the choice among overloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calltide.operators import overloads, provenance
from calltide.operators.rules import Rule
from calltide.plans import analyze
from calltide.plans.source_queries import _P, _filled, _parts
from calltide.session import Scratch
from calltide.sources import java

#: A Java file of a part.
_SHAPES = """package shop.{pkg};
import lib.{w1}.Tool;
@RequestMapping(value = "/{k}", produces = {"a", "b"})
public class Q{k} {
  private Tool tool = new Tool("{brand}");
  @GetMapping(path = "/{w2}") @Secured({"a"})
  public String find(@RequestParam(name = "id", required = false) String id, int size) {
    Tool mine = null;
    mine = new Special(id);
    try (Reader in = tool.open(id); Writer out = tool.write(size)) {
      mine.{w1}(in);
    } catch (IOException | SQLException bad) {
      tool.log(bad);
    }
    return find(id);
  }
  @Deprecated(since = "{size}")
  String find(String id) { return tool.{w2}(id); }
  static class Inner {
    int n = {size};
    Inner(int n) { this.n = n; use(n); }
  }
  record Pair(String a, int b) {
    Pair { check(a); }
  }
}
"""


def shape_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("src/shop/Q"), "k", F.lit(".java"))
    return _parts(spark, sf_dir).select(path.alias("path"), _filled(_SHAPES).alias("text"))


def shape_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = F.array_join(F.transform("params", lambda p: F.concat(p["type"], F.lit(" "), p["name"])), ",")
    found = java.methods(java.facts(shape_files(spark, sf_dir), ["method"]))
    return found.select("path", "class_name", "method_name", "line", "end", "returns", types.alias("params"), "is_handler")


def shape_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = java.calls(java.facts(shape_files(spark, sf_dir), ["call"]))
    scope = F.coalesce("method_name", F.lit("")).alias("scope")
    return found.select("path", "line", "class_name", scope, "receiver", "method", "args", "is_handler")


def shape_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = java.variables(java.facts(shape_files(spark, sf_dir), ["variable", "assignment", "method"]))
    return found.select("path", "class_name", "scope", "name", "type", "value")


_RULES = [
    Rule("T1", "opened", "high", ["lib.*.Tool.open(*)", "lib.*.Tool.write(*)"], "Tool opened", "path"),
    Rule("T2", "made", "medium", ["Special.Special(*)"], "Special made", "path"),
    Rule("T3", "made of a text", "critical", ["lib.*.Tool.Tool(*)"], "Tool made", "secret"),
    Rule("T4", "in a loop of calls", "low", ["shop.*.find(*)"], "Calls itself"),
]


def shape_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts in handlers that only their annotations tell."""
    found = analyze.alerts(shape_files(spark, sf_dir), _RULES)
    chain = F.coalesce("chain", F.lit("")).alias("chain")
    return found.select("rule_id", "severity", "path", "line", "signature", "method_name", "confidence", "message", chain)


#: Objects under other names, made of each other, and handed to other methods; every second part's ``lock`` does nothing.
_OBJECTS = """package flow.{pkg};
class O{k} {
  void alias(In in) { F f = F.newInstance(); F g = f; g.setFeature("{w1}", true); B b = f.newB(); b.parse(in); }
  void late(In in) { F f = F.newInstance(); B b = f.newB(); b.parse(in); f.setFeature("{w1}", true); }
  void child(In in) { F f = F.newInstance(); B b = f.newB(); b.setFeature("x", true); f.newB().parse(in); }
  void helped(In in) { F f = F.newInstance(); lock(f); B b = f.newB(); B c = b; c.parse(in); }
  void deep(In in) { F f = F.newInstance(); outer(f, 1); f.newB().parse(in); }
  void outer(F q, int n) { F r = q; lock(r); }
  void lock(F a) { F z = a; z.{lock}("{w2}", true); }
}
"""


def object_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether what is parsed was locked down before, under another name or in another method."""
    lock = F.when(F.col("size") % 2 == 0, "setFeature").otherwise("setName")
    text = F.replace(_filled(_OBJECTS), F.lit("{lock}"), lock)
    scratch = Scratch(spark)
    s = analyze.scan(_parts(spark, sf_dir).select(F.concat(F.lit("flow/O"), "k", F.lit(".java")).alias("path"), text.alias("text")), scratch)
    sites = scratch.keep(analyze.resolve(s, scratch=scratch, text=False).drop("text", "line", "signature", "provenance", "method_line"))
    scratch.drop(sites, s.facts)
    scratch.release()
    callers = provenance.passed_arguments(sites, analyze.typed_methods(s))
    safe = analyze.hardened(sites, s.assignments, callers).withColumn("hardened", F.lit(True))
    scratch.drop(sites)
    scratch.release()
    asked = sites.where("method = 'parse'").join(safe, "site_id", "left")
    return asked.select("path", F.col("method_name").alias("scope"), F.coalesce("hardened", F.lit(False)).alias("hardened"))


def overload_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class Ck is below C(k / 2); the class of a part's brand is below H, which has put(C1, long), ..., put(C7, long), put(C2,
    double) and put(C3, Integer); each part calls put(Ck, int). Every fourth call's first type is not known."""
    parts = _parts(spark, sf_dir)
    name = lambda k: F.concat(F.lit("C"), k.cast("string"))
    up = parts.where("k > 1").select(name(F.col("k")).alias("name"), name(F.floor(F.col("k") / 2)).alias("super"), F.lit(0).alias("ord"))
    up = up.unionByName(parts.select(F.col("brand").alias("name"), F.lit("H").alias("super"), F.lit(0).alias("ord")).distinct())
    first = F.when(F.col("size") % 4 != 0, name(F.col("k")))
    asked = parts.select(F.col("k").alias("site_id"), F.col("brand").alias("class_name"), F.lit("put").alias("method"), F.array(first, F.lit("int")).alias("given"))
    seven = parts.where("k between 1 and 7").select(F.col("k").alias("ordinal"), F.array(name(F.col("k")), F.lit("long")).alias("param_types"))
    two = parts.where("k in (2, 3)").select(
        (F.col("k") + 6).alias("ordinal"), F.array(name(F.col("k")), F.when(F.col("k") == 2, "double").otherwise("java.lang.Integer")).alias("param_types")
    )
    methods = seven.unionByName(two).select(F.lit("H").alias("class_name"), F.lit("put").alias("method_name"), F.col("ordinal").cast("int").alias("ordinal"), "param_types")
    found = overloads.choose(asked, methods, up)
    return found.select(F.col("site_id").alias("k"), "owner", "ordinal", F.col("far").cast("long").alias("far"), "sure")


_S = f"{_P}, s AS (SELECT *, 'src/shop/Q' || k || '.java' AS path FROM (SELECT * EXCLUDE (path) FROM p))"

QUERIES = {
    "shape_methods": (
        shape_methods,
        f"""{_S} SELECT path, c AS class_name, m AS method_name, l AS line, e AS end, r AS returns, a AS params, h AS is_handler FROM s, LATERAL (VALUES
  ('Q' || k, 'find', 7, 16, 'String', 'String id,int size', true), ('Q' || k, 'find', 18, 18, 'String', 'String id', false),
  ('Inner', 'Inner', 21, 21, '', 'int n', false), ('Pair', 'Pair', 24, 24, '', 'String a,int b', false)) AS v(c, m, l, e, r, a, h)""",
    ),
    "shape_calls": (
        shape_calls,
        f"""{_S} SELECT path, l AS line, c AS class_name, o AS scope, r AS receiver, m AS method, a AS args, h AS is_handler FROM s, LATERAL (VALUES
  (5, 'Q' || k, '', 'Tool', '<init>', '"' || brand || '"', false), (9, 'Q' || k, 'find', 'Special', '<init>', 'id', true),
  (10, 'Q' || k, 'find', 'tool', 'open', 'id', true), (10, 'Q' || k, 'find', 'tool', 'write', 'size', true), (11, 'Q' || k, 'find', 'mine', w1, 'in', true),
  (13, 'Q' || k, 'find', 'tool', 'log', 'bad', true), (15, 'Q' || k, 'find', '', 'find', 'id', true), (18, 'Q' || k, 'find', 'tool', w2, 'id', false),
  (21, 'Inner', 'Inner', '', 'use', 'n', false), (24, 'Pair', 'Pair', '', 'check', 'a', false)) AS v(l, c, o, r, m, a, h)""",
    ),
    "shape_variables": (
        shape_variables,
        f"""{_S} SELECT path, c AS class_name, o AS scope, n AS name, t AS type, x AS value FROM s, LATERAL (VALUES
  ('Q' || k, '<fields>', 'tool', 'Tool', 'new Tool("' || brand || '")'), ('Q' || k, 'find', 'id', 'String', ''), ('Q' || k, 'find', 'size', 'int', ''),
  ('Q' || k, 'find', 'mine', 'Tool', 'null'), ('Q' || k, 'find', 'in', 'Reader', 'tool.open(id)'), ('Q' || k, 'find', 'out', 'Writer', 'tool.write(size)'),
  ('Q' || k, 'find', 'bad', 'IOException', ''), ('Inner', '<fields>', 'n', 'int', '' || size), ('Inner', 'Inner', 'n', 'int', ''),
  ('Pair', '<fields>', 'a', 'String', ''), ('Pair', '<fields>', 'b', 'int', ''), ('Pair', 'Pair', 'a', 'String', ''), ('Pair', 'Pair', 'b', 'int', '')) AS v(c, o, n, t, x)""",
    ),
    "shape_alerts": (
        shape_alerts,
        f"""{_S} SELECT rule_id, severity, path, line, signature, CASE WHEN line > 5 THEN 'find' END AS method_name, confidence,
  message || CASE WHEN line > 5 THEN ' [Taint source: ' || path || '::Q' || k || '::find]' ELSE '' END AS message, CASE WHEN line > 5 THEN 'medium' ELSE '' END AS chain
FROM s, LATERAL (VALUES
  ('T1', 'high', 10, 'lib.' || w1 || '.Tool.open()', 'high', 'Tool opened: outside input id'), ('T1', 'high', 10, 'lib.' || w1 || '.Tool.write()', 'high', 'Tool opened: outside input size'),
  ('T2', 'medium', 9, 'Special.Special()', 'high', 'Special made: outside input id'), ('T3', 'critical', 5, 'lib.' || w1 || '.Tool.Tool()', 'high', 'Tool made'),
  ('T4', 'low', 15, 'shop.' || pkg || '.Q' || k || '.find()', 'medium', 'Calls itself: outside input id')) AS v(rule_id, severity, line, signature, confidence, message)""",
    ),
    "object_flow": (
        object_flow,
        f"""{_P} SELECT 'flow/O' || k || '.java' AS path, o AS scope, CASE o WHEN 'alias' THEN true WHEN 'helped' THEN size % 2 = 0 WHEN 'deep' THEN size % 2 = 0 ELSE false END AS hardened
FROM p, LATERAL (VALUES ('alias'), ('late'), ('child'), ('helped'), ('deep')) AS v(o)""",
    ),
    "overload_choice": (
        overload_choice,
        """WITH RECURSIVE up AS (SELECT p_partkey AS k, p_partkey AS top, 0 AS steps FROM part WHERE p_size % 4 <> 0 AND p_partkey > 0
  UNION ALL SELECT k, top // 2, steps + 1 FROM up WHERE top > 7)
SELECT k, 'H' AS owner, CAST(top AS INTEGER) AS ordinal, steps + 1 AS far, true AS sure FROM up WHERE top <= 7
UNION ALL SELECT p_partkey, 'H', 1, 1, false FROM part WHERE p_size % 4 = 0""",
    ),
}
