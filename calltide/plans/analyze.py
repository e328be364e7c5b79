"""From Java sources to alerts: scan, resolve, match, score, trace, rank, and append what is new.

Where published descriptions of such a pipeline and its evident intent differ, the intent is taken: taint chains are
known before rules are checked and are stored with the alert in one write, tainted operands count in the SQL rule, and
rules that need a chain are gated by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calltide.operators import graph, match, merge, objects, provenance
from calltide.operators.checks import Check
from calltide.operators.lookup import cascade, in_files
from calltide.operators.rules import RULES, Rule, decide
from calltide.session import Scratch
from calltide.sources import java
from calltide.sources.store import Store

# Names that need no import, by package.
BUILT_IN = {
    "java.lang": ["Object", "String", "Integer", "Long", "Boolean", "Double", "Float", "Short", "Byte", "Character", "Math", "System", "Thread", "Runtime", "Process", "ProcessBuilder", "Class", "StringBuilder", "StringBuffer", "Exception", "RuntimeException", "Iterable", "Runnable", "Throwable"],
    "java.util": ["List", "ArrayList", "Map", "HashMap", "Set", "HashSet", "Collection", "Random", "Date", "Properties", "Optional", "Arrays", "Collections", "UUID", "Scanner"],
    "java.io": ["File", "FileInputStream", "FileOutputStream", "FileReader", "FileWriter", "InputStream", "OutputStream", "Reader", "Writer", "BufferedReader", "ObjectInputStream", "IOException"],
    "java.sql": ["Connection", "Statement", "PreparedStatement", "ResultSet", "DriverManager", "SQLException"],
}
# Names of tainted parameters, and methods that read outside input.
TAINTED_NAME = r"(?i)request|param|(^|[^a-z0-9_])input([^a-z0-9_]|$)|(^|[^a-z0-9_])user|header|body|query|cookie|token|password|secret|key|id$|name$|path$|url$|file$"
SOURCE_METHODS = ["getParameter", "getHeader", "getInputStream", "getReader", "getQueryString", "getRequestURI", "getRemoteAddr", "getCookies", "getAttribute", "getParameterValues", "getPart", "getParts"]
# Calls that make their argument harmless; used only if asked for.
SANITIZERS = [
    "sanitize", "escape", "encode", "encodeForSQL", "encodeForHTML", "encodeForJavaScript", "encodeForURL", "encodeForCSS", "parameterize", "prepareStatement", "bind", "setString", "setInt", "setLong", "setDouble",
    "setFloat", "setBoolean", "setBytes", "setDate", "setTimestamp", "setObject", "validate", "whitelist", "allowlist",
]
HARDENING = "setFeature"
_DOTTED = r"^[a-z_]\w*(\.\w+)+$"
ALERT_KEY = ["rule_id", "path", "line", "signature"]
ALERT_SCHEMA = (
    "rule_id string, severity string, confidence string, message string, path string, line int, seq int, signature string, class_name string, method_name string, source_line string, "
    "chain string, chain_source string, chain_depth int, chain_path string, chain_reason string, detected_at bigint"
)
ALERT_COLUMNS = [c.split()[0] for c in ALERT_SCHEMA.split(", ")]


@dataclass
class Scan:
    """Tables of one scan, all of them selections of ``facts``."""

    facts: DataFrame
    classes: DataFrame
    methods: DataFrame
    variables: DataFrame
    assignments: DataFrame
    constants: DataFrame
    imports: DataFrame
    packages: DataFrame
    calls: DataFrame


def scan(files: DataFrame, scratch: Scratch | None = None) -> Scan:
    """Files are read once; the facts are written, so later joins plan on what is there, and a lost executor costs one table."""
    facts = (scratch or Scratch(files.sparkSession)).keep(java.facts(files))
    tables = (java.classes, java.methods, java.variables, java.assignments, java.constants, java.imports, java.packages, java.calls)
    return Scan(facts, *(table(facts) for table in tables))


def _built_in(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{name}', '{package}.{name}')" for package, names in BUILT_IN.items() for name in names)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(short_name, fqn)")


def resolve(s: Scan, returns: DataFrame | None = None, scratch: Scratch | None = None, text: bool = True) -> DataFrame:
    """Call sites with ``type`` (qualified class of the receiver), ``provenance`` and ``signature``. ``returns`` has
    (class_name, method, return_type) of a library, for receivers that are calls. Look-up tables are written to ``scratch``, which may
    drop them when the sites are written; without ``text``, source lines are not moved, and null."""
    spark = s.facts.sparkSession
    own = F.col("receiver").isin("", "this", "super")
    bare = F.regexp_replace("receiver", r"^(this|super)\.", "")
    calls = s.calls if text else s.calls.withColumn("text", F.lit(None).cast("string"))
    sites = calls.withColumn("scope", F.coalesce("method_name", F.lit("<fields>"))).withColumn("bare", bare).withColumn("fields", F.lit("<fields>"))
    # What the receiver alone tells; the rest is looked up.
    made = F.nullif(F.regexp_extract("bare", r"^new\s*([\w.]+)\s*(?:<[^>]*>)?\([^()]*\)$", 1), F.lit(""))
    alone = F.when(own, F.col("class_name")).when(F.col("method") == "<init>", F.col("receiver")).otherwise(made)
    # Made once, and written: a look-up table that an aggregate has just made would keep Spark from parting a name that many sites have.
    scratch = scratch or Scratch(spark)
    packages, imports = scratch.keep(s.packages), scratch.keep(s.imports)
    declared = s.classes.join(packages, "path", "left").select("path", F.coalesce("package", F.lit("")).alias("package"), F.col("class_name").alias("short_name"), F.concat_ws(".", "package", "class_name").alias("fqn"))
    declared = scratch.keep(declared)
    near = scratch.keep(merge.first_wins(declared, ["package", "short_name"], ["path"]).select("package", "short_name", "fqn"))
    far = scratch.keep(declared.groupBy("short_name").agg(F.min("fqn").alias("fqn"), F.max("fqn").alias("last")).where("fqn = last").select("short_name", "fqn"))
    held = scratch.keep(declared.select("path", "short_name", "fqn").dropDuplicates(["path", "short_name"]))
    beyond = [
        (near, {"package": "package", "short": "short_name"}, "fqn", "package"),
        (_built_in(spark), {"short": "short_name"}, "fqn", "built-in"),
        (far, {"short": "short_name"}, "fqn", "project"),
    ]
    told = F.when(own, "own").when(alone.isNotNull(), "constructor")
    if returns is None:  # nothing is asked of what receivers return
        asked = sites.select("*", F.col("bare").alias("name"), alone.alias("value"), told.alias("told")).drop("fields", "bare")
        found = scratch.keep(in_files(asked, java.declared(s.facts), imports, held, packages))
        dotted = F.col("short").rlike(_DOTTED)
        # What no file tells is asked for once by each name in a package.
        open_ = scratch.keep(found.where(F.col("fqn").isNull() & ~dotted).select("package", "short").distinct())
        met = scratch.keep(cascade(open_, beyond, F.col("short"), "met", "how"))
        found = found.join(met, ["package", "short"], "left")
        type_ = F.when(dotted, F.col("short")).otherwise(F.coalesce("fqn", "met"))
        looked = F.when(dotted, "qualified").otherwise(F.coalesce("looked", "how"))
        return _signed(found.withColumn("type", type_).withColumn("provenance", F.coalesce("told", looked)))

    variables = scratch.keep(s.variables.select("path", "class_name", "scope", "name", "type"))
    levels = [
        (variables, {"path": "path", "class_name": "class_name", "scope": "scope", "bare": "name"}, "type", "variable"),
        (variables, {"path": "path", "class_name": "class_name", "fields": "scope", "bare": "name"}, "type", "field"),
    ]
    typed = cascade(sites, levels, F.lit(None).cast("string"), "named", "how")
    chained = F.regexp_extract("bare", r"^([^(]*)\.(\w+)\s*\(.*\)$", 1)
    short = F.when(alone.isNotNull(), alone).when(F.col("named").isNotNull(), F.col("named")).when(F.col("bare").contains("("), F.lit(None)).otherwise(F.col("bare"))
    how = F.when(told.isNotNull(), told).when(F.col("named").isNotNull(), F.col("how")).when(F.col("bare").contains("("), "return-type")
    typed = typed.withColumn("short", short).withColumn("told", how).withColumn("inner", F.nullif(chained, F.lit(""))).withColumn("inner_method", F.nullif(F.regexp_extract("bare", r"^[^(]*\.(\w+)\s*\(.*\)$", 1), F.lit("")))
    inner = [(variables, {"path": "path", "class_name": "class_name", "scope": "scope", "inner": "name"}, "type", "v"), (variables, {"path": "path", "class_name": "class_name", "fields": "scope", "inner": "name"}, "type", "f")]
    typed = cascade(typed, inner, F.col("inner"), "inner_type", "_ignored").drop("_ignored")

    def qualified(rows: DataFrame, name: str, into: str, told: str) -> DataFrame:
        """By an import, a class of the file, one of its package, a name that needs no import, or the one class of that name."""
        levels = [
            (imports, {"path": "path", name: "short_name"}, "fqn", "import"),
            (held, {"path": "path", name: "short_name"}, "fqn", "file"),
            *((table, {name if k == "short" else k: v for k, v in keys.items()}, value, how) for table, keys, value, how in beyond),
        ]
        rows = cascade(rows, levels, F.col(name), into, told)
        dotted = F.col(name).rlike(_DOTTED)
        return rows.withColumn(into, F.when(dotted, F.col(name)).otherwise(F.col(into))).withColumn(told, F.when(dotted, "qualified").otherwise(F.col(told)))

    typed = typed.join(packages, "path", "left").withColumn("package", F.coalesce("package", F.lit("")))
    typed = qualified(typed, "inner_type", "inner_fqn", "_ignored").drop("_ignored")
    side = returns.select(F.col("class_name").alias("inner_fqn"), F.col("method").alias("inner_method"), "return_type").dropDuplicates(["inner_fqn", "inner_method"])
    typed = typed.join(side, ["inner_fqn", "inner_method"], "left").withColumn("short", F.coalesce("short", "return_type"))
    typed = typed.withColumn("short", F.coalesce("short", "bare"))
    return _signed(qualified(typed, "short", "type", "looked").withColumn("provenance", F.coalesce("told", "looked")))


def _signed(out: DataFrame) -> DataFrame:
    name = F.when(F.col("method") == "<init>", F.element_at(F.split("type", r"\."), -1)).otherwise(F.col("method"))
    out = out.withColumn("called", name).withColumn("signature", F.concat("type", F.lit("."), name, F.lit("()")))
    return out.select("path", "line", "seq", "text", "args", "receiver", "method", "called", "class_name", "method_name", "method_line", "scope", "is_handler", "type", "provenance", "signature", F.concat_ws(":", "path", "line", "seq").alias("site_id"))


def node_id(path: Column, class_name: Column, method: Column) -> Column:
    return F.concat_ws("::", path, class_name, method)


def typed_methods(s: Scan) -> DataFrame:
    """Declared methods with ``type``, the qualified name of their class."""
    return s.methods.join(s.packages, "path", "left").withColumn("type", F.concat_ws(".", "package", "class_name"))


def call_graph(sites: DataFrame, s: Scan) -> DataFrame:
    """(source, target, line): calls between declared methods; a call meets the methods of its name in its receiver's qualified
    type, so classes of one name in different packages stay apart."""
    callee = typed_methods(s).select("type", F.col("method_name").alias("called"), node_id(F.col("path"), F.col("class_name"), F.col("method_name")).alias("target")).distinct()
    caller = sites.where("method_name is not null").select(node_id(F.col("path"), F.col("class_name"), F.col("method_name")).alias("source"), "line", "type", "called")
    return caller.join(callee, ["type", "called"]).select("source", "target", "line")


def taint_sources(methods: DataFrame, sites: DataFrame) -> DataFrame:
    """(node, confidence, reason): tainted parameter names, then calls that read outside input, then handlers with texts; the
    first that holds wins."""
    node = node_id(F.col("path"), F.col("class_name"), F.col("method_name")).alias("node")
    row = lambda d, seq, confidence, reason: d.select(node, F.lit(seq).alias("seq"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"))
    named = methods.where(F.exists("params", lambda p: p["name"].rlike(TAINTED_NAME)))
    read = sites.where(F.col("method").isin(*SOURCE_METHODS) & F.col("method_name").isNotNull())
    texts = methods.where("is_handler").where(F.exists("params", lambda p: p["type"] == "String"))
    every = row(named, 1, "medium", "parameter name").unionByName(row(read, 2, "high", "source method")).unionByName(row(texts, 3, "medium", "handler class"))
    return merge.first_wins(every, ["node"], ["seq"]).select("node", "confidence", "reason")


def receiver_sources(sites: DataFrame, assigned: DataFrame) -> DataFrame:
    """sites with ``arguments``: what stands in the last brackets of the receiver itself, or of the first value that the receiver is
    given in its method; it is taken as one argument."""
    first = merge.first_wins(assigned, ["path", "class_name", "scope", "name"], ["seq"]).select("path", "class_name", "scope", F.col("name").alias("receiver"), "value")
    made = F.when(F.col("receiver").contains("("), F.col("receiver")).otherwise(F.col("value"))
    inside = F.regexp_extract(made, r"\(([^()]*)\)[^()]*$", 1)
    return sites.drop("arguments").join(first, ["path", "class_name", "scope", "receiver"], "left").withColumn("arguments", F.coalesce(inside, F.lit(""))).drop("value")


def hardened(sites: DataFrame, assigned: DataFrame, callers: DataFrame | None = None) -> DataFrame:
    """(site_id): sites whose object, under whatever name, or what made it, was locked down before in the same method, there or in a
    method that it was handed to."""
    done, linked = objects.done_to(sites, assigned, [HARDENING], callers)
    return objects.done_before(sites, done, linked)


def alerts(files: DataFrame, rules: list[Rule] | None = None, returns: DataFrame | None = None, detected_at: int = 0, taint: bool = True, sanitizers: bool = False, across: bool = True, checks: dict[str, Check] | None = None) -> DataFrame:
    """One row per rule and call site: rule_id, severity, confidence, message, path, line, signature, class_name, method_name,
    source_line, chain columns (null without), detected_at. ``sanitizers``: methods that call one stop taint.
    ``across``: parameters are followed into the arguments of known callers. ``checks``: those that a user adds, by name."""
    rules = RULES if rules is None else rules
    spark, scratch = files.sparkSession, Scratch(files.sparkSession)
    s = scan(files, scratch)
    sites = scratch.keep(resolve(s, returns))
    rows = ", ".join(f"('{r.id}', '{r.severity}', '{g}')" for r in rules for g in r.globs)
    patterns = spark.sql(f"SELECT * FROM VALUES {rows} AS t(rule_id, severity, glob)")
    matched = scratch.keep(match.match_rules(sites, patterns, method="called"))

    asked = matched.dropDuplicates(["site_id"]).withColumn("arguments", F.col("args"))
    made = receiver_sources(asked, s.assignments).withColumn("site_id", F.concat("site_id", F.lit("#receiver")))
    given = s.methods.select("path", "class_name", F.col("method_name").alias("scope"), F.explode("params").alias("p")).select("path", "class_name", "scope", "p.name")
    key = ["path", "class_name", "scope", "name"]
    first = merge.first_wins(s.assignments, key, ["seq"]).select(*key, "value")  # of several values of a name, the first counts
    values = s.variables.drop("value").join(first, key, "left").withColumn("value", F.coalesce("value", F.lit("")))
    callers = scratch.keep(provenance.passed_arguments(sites, typed_methods(s))) if across else None
    parts = provenance.argument_parts(asked.unionByName(made), given, values, s.constants, callers)
    told = scratch.keep(provenance.flags(parts))
    receiver = told.where(F.col("site_id").endswith("#receiver")).select(F.regexp_replace("site_id", "#receiver$", "").alias("site_id"), F.col("ext").alias("receiver_ext"), F.col("tainted").alias("receiver_tainted"))
    told = told.where(~F.col("site_id").endswith("#receiver")).join(receiver, "site_id", "full")

    chain = None
    if taint:
        edges = call_graph(sites, s)
        if sanitizers:
            clean = sites.where(F.col("method").isin(*SANITIZERS) & F.col("method_name").isNotNull()).select(node_id(F.col("path"), F.col("class_name"), F.col("method_name")).alias("target")).distinct()
            edges = edges.join(clean, "target", "left_anti")
        sinks = matched.where("method_name is not null").select(node_id(F.col("path"), F.col("class_name"), F.col("method_name")).alias("root")).distinct()
        best = graph.best_chain(graph.chains(edges, sinks, taint_sources(s.methods, sites)))
        chain = best.select("root", F.col("confidence").alias("chain"), F.col("source").alias("chain_source"), F.col("depth").alias("chain_depth"), graph.propagation(F.col("path")).alias("chain_path"), F.col("reason").alias("chain_reason"))
    full = matched.join(told, "site_id", "left").withColumn("root", node_id(F.col("path"), F.col("class_name"), F.col("method_name")))
    nothing = (("chain", "string"), ("chain_source", "string"), ("chain_depth", "int"), ("chain_path", "string"), ("chain_reason", "string"))
    full = full.join(chain, "root", "left") if chain is not None else full.select("*", *(F.lit(None).cast(t).alias(c) for c, t in nothing))
    if checks or any(r.check == "xml" for r in rules):  # no other check looks at it
        full = full.join(hardened(sites, s.assignments, callers).withColumn("hardened", F.lit(True)), "site_id", "left")
    else:
        full = full.withColumn("hardened", F.lit(False))
    full = full.withColumn("receiver_type", F.col("type")).fillna(False, ["ext", "tainted", "hard_any", "hard_all", "hardened", "receiver_ext", "receiver_tainted"])
    severity = patterns.select("rule_id", "severity").distinct()
    return _ranked(decide(full, rules, checks).join(severity, "rule_id"), detected_at)


def _ranked(out: DataFrame, detected_at: int) -> DataFrame:
    """Alerts with what their chain adds; of several at one key, the first."""
    sure = (F.col("chain") == "high") & (F.col("confidence") == "medium")
    chained = F.when(sure, F.concat("message", F.lit(" [Taint confirmed: "), "chain_path", F.lit("]"))).when(F.col("chain").isin("high", "medium"), F.concat("message", F.lit(" [Taint source: "), "chain_source", F.lit("]")))
    out = out.withColumn("message", F.coalesce(chained, "message")).withColumn("confidence", F.when(sure, "high").otherwise(F.col("confidence")))
    out = out.withColumn("source_line", F.trim("text")).withColumn("detected_at", F.lit(detected_at).cast("long"))
    return merge.first_wins(out.select(*ALERT_COLUMNS), ALERT_KEY, ["seq"])


def _store(spark: SparkSession, table: str) -> Store:
    return Store(spark, table, ALERT_SCHEMA, ALERT_KEY, ["detected_at", "seq"])


def stored(spark: SparkSession, table: str) -> DataFrame:
    """The alerts table; an empty one if none has been written."""
    return _store(spark, table).rows()


def append_alerts(spark: SparkSession, new: DataFrame, table: str, clear: bool = False) -> DataFrame:
    """Append the alerts that the table does not hold yet; the first writer of a key wins, also across runs and among runs at one
    time. With ``clear``, the new alerts take the place of all others."""
    _store(spark, table).append(new.select(*ALERT_COLUMNS), clear)
    return stored(spark, table)


def newest(found: DataFrame) -> DataFrame:
    """Alerts newest first, then by place, the chain as one struct that is null without a source."""
    chain = [c for c in ALERT_COLUMNS if c.startswith("chain")]
    one = F.when(F.col("chain_source").isNotNull(), F.struct(*(F.col(c).alias(c.removeprefix("chain_") if c != "chain" else "confidence") for c in chain))).alias("taint")
    return found.select(*(c for c in ALERT_COLUMNS if c not in chain), one).orderBy(F.desc("detected_at"), "path", "line", "seq", "rule_id")


def with_taint(found: DataFrame) -> DataFrame:
    """Alerts that have a chain."""
    return found.where(F.col("chain_source").isNotNull())


def severe() -> Column:
    """Whether an alert makes a build fail."""
    return F.col("severity").isin("critical", "high")


def summary(found: DataFrame) -> DataFrame:
    """(severity, n, first): counts by severity, and the place in which the severity is met first."""
    return found.groupBy("severity").agg(F.count("*").alias("n"), F.min(F.struct("path", "line", "seq")).alias("first"))


def report(found: DataFrame, most: int = 1000) -> str:
    """At most ``most`` alerts as text, by severity and place, and how many there are: what a terminal prints, the driver holds."""
    order = {k: i for i, k in enumerate(("critical", "high", "medium", "low", "info"))}
    rank = F.coalesce(*(F.when(F.col("severity") == k, i) for k, i in order.items()), F.lit(9))
    rows = found.select("severity", "rule_id", "confidence", "path", "line", "message").orderBy(rank, "path", "line", "rule_id").limit(most).collect()
    lines = [f"{r.severity:9}{r.rule_id} ({r.confidence}) {r.path}:{r.line} {r.message}" for r in rows]
    more = found.count() - len(rows) if len(rows) == most else 0
    return "\n".join([*lines, *([f"... and {more} more"] if more else [])])
