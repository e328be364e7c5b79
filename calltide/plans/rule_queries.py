"""Queries of the rule engine over ``part``: a part stands for a call with the signature brand.type.name()."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calltide.functions import signatures as sg
from calltide.operators import checks, codegraph, match, merge, rules
from calltide.plans import analyze
from calltide.session import Scratch, read_table

#: rule, severity, patterns.
RULES = [
    ("R01", "critical", ["Brand#1*.PROMO.*_ring()", "Brand#2.PROMO.*(*)"]),
    ("R02", "high", ["*.red_widget()", "Brand#7.*.red_bolt(*)"]),
    ("R03", "high", ["Brand#3.SMALL.hot_gear()", "*.LARGE.hot_gear()"]),
    ("R04", "medium", ["*.STANDARD.small_ring()", "*.ECONOMY.small_ring()"]),
    ("R05", "low", ["Brand#?.MEDIUM.blue_bolt()", "Brand#5.MEDIUM.*(*)"]),
    ("R06", "medium", ["*.blue_bolt()"]),
]


def _patterns(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{r}', '{s}', {k}, '{g}')" for r, s, globs in RULES for k, g in enumerate(globs))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(rule_id, severity, ord, glob)")


_VALUES = ", ".join(f"('{r}', '{s}', {k}, '{g}')" for r, s, globs in RULES for k, g in enumerate(globs))
_SITES = "SELECT p_partkey, p_size, p_brand, p_type, replace(p_name, ' ', '_') AS method, p_brand || '.' || p_type || '.' || replace(p_name, ' ', '_') || '()' AS signature FROM part"
_MATCHED = rf"""
  rules AS (SELECT rule_id, severity, ord, '^' || replace(regexp_replace(pat, '([.+^${{}}()|?\[\]\\])', '\\\1', 'g'), '*', '[^()]*') || '$' AS rx FROM (VALUES {_VALUES}) AS t(rule_id, severity, ord, pat)),
  sites AS ({_SITES}),
  matched AS (SELECT DISTINCT p_partkey, p_size, p_brand, p_type, method, signature, rule_id, severity FROM sites JOIN rules ON regexp_matches(signature, rx))"""
_DECIDED = f"""{_MATCHED},
  decided AS (SELECT *, CASE WHEN p_size >= 45 THEN 'high' WHEN p_type = 'PROMO' AND severity = 'critical' THEN 'high' WHEN p_size >= 15 THEN 'medium' WHEN p_size >= 5 THEN 'low' END AS confidence FROM matched)"""


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = F.replace("p_name", F.lit(" "), F.lit("_"))
    name = sg.qualified_name(F.col("p_brand"), F.col("p_type"), method, F.array().cast("array<string>"))
    return read_table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_type", method.alias("method"), name.alias("signature"))


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = _patterns(spark)
    found = match.match_rules(_sites(spark, sf_dir), patterns)
    return found.join(patterns.select("rule_id", "severity").distinct(), "rule_id")


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision list: the first branch that holds; none means no alert."""
    size = F.col("p_size")
    confidence = F.when(size >= 45, "high").when((F.col("p_type") == "PROMO") & (F.col("severity") == "critical"), "high").when(size >= 15, "medium").when(size >= 5, "low")
    return _matched(spark, sf_dir).withColumn("confidence", confidence)


def glob_rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select("p_partkey", "signature", "rule_id", "severity")


def rule_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).where("confidence is not null").select("p_partkey", "rule_id", "confidence")


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = Scratch(spark).keep(_decided(spark, sf_dir).where("confidence is not null"))  # read three times below
    held = fresh.where("rule_id = 'R06'")  # what an earlier run has written
    return held.unionByName(merge.keep_first_upsert(held, fresh, ["rule_id", "signature"], ["p_partkey"]))


def severity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alerts(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_seen"), F.count_if(F.col("confidence") == "high").alias("n_high"))


def exit_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 if any alert is critical or high, as a build would see it."""
    return _alerts(spark, sf_dir).groupBy("p_type").agg(F.max(F.when(analyze.severe(), 1).otherwise(0)).alias("exit_code"), F.count("*").alias("n"))


def alert_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts as JSON text with fields in a fixed order."""
    row = F.to_json(F.struct(F.col("rule_id").alias("rule"), F.col("signature"), F.col("confidence"), F.array("p_brand", "p_type").alias("types")))
    return _decided(spark, sf_dir).where("confidence is not null").select("p_partkey", "rule_id", row.alias("alert"))


def qualified_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with an empty package left out, and a type list."""
    part = read_table(spark, sf_dir, "part")
    package = F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("")
    return part.select("p_partkey", sg.qualified_name(package, F.col("p_type"), F.col("p_name"), F.split("p_name", " ")).alias("name"))


def focus_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods whose name equals, or whose qualified name contains, the focus."""
    return codegraph.focus(_sites(spark, sf_dir).withColumnRenamed("method", "name"), "red_widget").select("p_partkey", "signature")


def builtin_type_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types resolved by a built-in table before the imports table, else kept."""
    imports = read_table(spark, sf_dir, "part").groupBy("p_type").agg(F.max("p_brand").alias("imported")).where("p_type in ('SMALL', 'LARGE', 'MEDIUM')")
    part = read_table(spark, sf_dir, "part").join(imports, "p_type", "left")
    text = F.concat("p_type", F.when(F.col("p_size") % 2 == 0, "<T, List<X>>[]").otherwise(""))
    return part.select("p_partkey", sg.type_name(text, F.col("imported"), {"PROMO": "java.lang.Promo", "SMALL": "java.lang.Small"}).alias("type"))


#: By rule: the methods and receiver types that a site can have.
_METHODS = {
    "S001": (["createStatement", "executeQuery", "execute"], ["java.sql.Statement", "java.sql.PreparedStatement", "java.sql.Connection"]),
    "S003": (["exec", "start", "command"], ["java.lang.ProcessBuilder", "java.lang.Runtime"]),
    "S006": (["<init>", "openConnection"], ["java.net.URL", "java.net.HttpURLConnection"]),
    "S007": (["parse", "newInstance"], ["javax.xml.parsers.DocumentBuilder", "javax.xml.parsers.DocumentBuilderFactory", "org.xml.sax.XMLReader"]),
    "S008": (["compile", "evaluate", "search", "lookup"], ["javax.naming.Context"]),
    "S010": (["getInstance"], ["javax.crypto.Cipher"]),
    "S011": (["forName", "newInstance"], ["java.lang.Class"]),
}
_ARGUMENTS = ['"DES/CBC"', '"DESede"', '"AES/ECB"', '"RC4"', '"ARCFOUR"', '"RSA"', '"RSA/OAEP"', '"MD5"', '"sha-1"', '"SHA-256"', '"AES/GCM"', ""]


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of an order as the context of a call, for one of the rules; flags are digits of its keys."""
    ids = F.array(*(F.lit(r.id) for r in rules.RULES))
    lines = read_table(spark, sf_dir, "lineitem").withColumn("rule_id", F.get(ids, (F.col("l_partkey") % 13).cast("int")))
    n = F.col("l_orderkey") + F.col("l_linenumber")
    choice = lambda k: F.coalesce(*(F.when(F.col("rule_id") == r, F.get(F.array(*map(F.lit, v[k])), ((F.col("l_suppkey") + k * n) % len(v[k])).cast("int"))) for r, v in _METHODS.items()), F.lit("call"))
    hard = F.col("l_suppkey") % 2 == 0
    chain = F.get(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (F.col("l_orderkey") % 7).cast("int"))
    out = lines.withColumns(
        {
            "method": choice(0), "receiver_type": choice(1), "args": F.get(F.array(*map(F.lit, _ARGUMENTS)), (n % len(_ARGUMENTS)).cast("int")),
            "ext": n % 3 == 0, "tainted": n % 2 == 0, "hard_any": hard, "hard_all": hard & (F.col("l_suppkey") % 4 == 0), "chain": chain, "hardened": F.col("l_linenumber") % 3 == 0,
            "receiver_ext": n % 5 == 0, "receiver_tainted": n % 5 == 1, "names": F.when(n % 4 == 0, "").otherwise(F.concat(F.lit("v"), F.col("l_linenumber"))),
        }
    )
    out = out.withColumn("settled", F.when(F.col("l_quantity") % 10 == 0, "MD5"))
    return out.select("l_orderkey", "l_linenumber", "rule_id", "method", "receiver_type", "args", "settled", "ext", "tainted", "hard_any", "hard_all", "chain", "hardened", "receiver_ext", "receiver_tainted", "names")


def rule_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts of the thirteen rules on contexts of their calls."""
    return rules.decide(Scratch(spark).keep(_contexts(spark, sf_dir)), rules.RULES).select("l_orderkey", "l_linenumber", "rule_id", "confidence", "message")


_CHECK_TEXT = """
def check(context):
    sink = context["sink"]
    if sink["args"] == '"MD5"':
        raise ValueError("no MD5 here")
    return {"alert": context["params"]["ext"] or sink["args"] == "", "message": "text check of " + sink["method"], "confidence": "high"}
"""


def _by_rows(context: dict) -> object:
    """Throws where there are no arguments, answers in a wrong way where they name RC4."""
    args = context["sink"]["args"]
    if args == '"RC4"':
        return "perhaps"
    return {"alert": args[1] == "A", "confidence": "critical" if context["chain"] else None}


def _by_batches(columns: dict) -> list:
    """Throws for the whole batch if any name is v3."""
    if any(p["names"] == "v3" for p in columns["params"]):
        raise KeyError("v3")
    return [p["names"] != "" for p in columns["params"]]


#: By rule, the user's check that decides it; one has a mistake, one is not there.
_CHECKED = {"S001": "rows", "S002": "batches", "S003": "text.py", "S004": "broken.py", "S005": "none"}


def user_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of checks that a user adds, one of which throws, one that fails by batches, one that is no Python, one that is
    missing, on the contexts of their rules' calls."""
    added = checks.Registry()
    added.add("rows", _by_rows)
    added.add("batches", _by_batches, batched=True)
    added.add_text("text.py", _CHECK_TEXT)
    added.add_text("broken.py", "def check(context: return True")
    asked = _contexts(spark, sf_dir).where(F.col("rule_id").isin(*_CHECKED))
    found = checks.checked(asked, _CHECKED, added).where("verdict_alert")
    told = F.col("verdict_message")
    message = F.when(told.startswith("check failed: SyntaxError"), "check failed: SyntaxError").otherwise(F.coalesce(told, F.lit("")))
    return found.select("l_orderkey", "l_linenumber", "rule_id", F.col("verdict").alias("confidence"), message.alias("message"))



def _pick(values: list[str], index: str) -> str:
    return "CASE " + index + " " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _choice(k: int) -> str:
    return "CASE rule_id " + " ".join(f"WHEN '{r}' THEN {_pick(v[k], f'(l_suppkey + {k} * n) % {len(v[k])}')}" for r, v in _METHODS.items()) + " ELSE 'call' END"


_W = "(^|[^A-Za-z0-9_])"
_E = "([^A-Za-z0-9_]|$)"
_RULES_SQL = f"""
WITH l AS (SELECT *, l_orderkey + l_linenumber AS n, {_pick([r.id for r in rules.RULES], 'l_partkey % 13')} AS rule_id FROM lineitem),
s AS (SELECT l_orderkey, l_linenumber, rule_id, {_choice(0)} AS m, {_choice(1)} AS t, CASE WHEN l_quantity % 10 = 0 THEN 'MD5' ELSE {_pick(_ARGUMENTS, f'n % {len(_ARGUMENTS)}')} END AS a, n % 3 = 0 AS ext, n % 2 = 0 AS tainted, l_suppkey % 2 = 0 AS hard_any,
  l_suppkey % 4 = 0 AS hard_all, CASE l_orderkey % 7 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS chain, l_linenumber % 3 = 0 AS hardened, n % 5 = 0 AS rext, n % 5 = 1 AS rtainted,
  CASE WHEN n % 4 = 0 THEN '' ELSE 'v' || l_linenumber END AS names FROM l),
v AS (SELECT *, CASE rule_id
  WHEN 'S001' THEN CASE WHEN contains(t, 'PreparedStatement') THEN NULL WHEN m = 'createStatement' THEN CASE WHEN ext OR chain IS NOT NULL THEN 'high' ELSE 'medium' END
    WHEN t LIKE '%Statement' THEN CASE WHEN ext OR chain IS NOT NULL THEN 'high' WHEN tainted THEN 'medium' WHEN hard_any THEN 'low' ELSE 'medium' END WHEN contains(m, 'execute') THEN 'low' END
  WHEN 'S002' THEN 'high'
  WHEN 'S003' THEN CASE WHEN m = 'start' THEN CASE WHEN chain IS NOT NULL OR rext THEN 'high' WHEN rtainted THEN 'medium' END
    WHEN ext OR chain IS NOT NULL THEN 'high' WHEN tainted THEN 'medium' WHEN hard_all THEN NULL WHEN hard_any THEN 'low' ELSE 'medium' END
  WHEN 'S004' THEN chain
  WHEN 'S005' THEN CASE WHEN ext THEN 'high' WHEN chain IS NOT NULL THEN 'medium' ELSE 'low' END
  WHEN 'S006' THEN CASE WHEN t LIKE '%URL' AND ext THEN 'high' WHEN m = 'openConnection' THEN 'medium' WHEN chain IS NOT NULL THEN 'medium' ELSE 'low' END
  WHEN 'S007' THEN CASE WHEN m = 'parse' AND t LIKE '%DocumentBuilder' AND NOT hardened THEN 'high' WHEN m = 'parse' AND t LIKE '%DocumentBuilder' AND ext THEN 'medium' WHEN m = 'newInstance' AND t LIKE '%DocumentBuilderFactory' THEN 'medium' END
  WHEN 'S008' THEN CASE WHEN m IN ('compile', 'evaluate') THEN CASE WHEN ext THEN 'high' WHEN chain IS NOT NULL THEN 'medium' ELSE 'low' END WHEN m = 'search' THEN CASE WHEN ext THEN 'high' ELSE 'medium' END
    WHEN m = 'lookup' THEN CASE WHEN ext THEN 'critical' WHEN chain IS NOT NULL THEN 'high' ELSE 'medium' END END
  WHEN 'S009' THEN CASE WHEN hard_any THEN 'high' END
  WHEN 'S010' THEN CASE WHEN a = '' THEN NULL
    WHEN regexp_matches(a, '{_W}(DES|ECB|RC4|ARCFOUR){_E}') OR (regexp_matches(a, '{_W}RSA{_E}') AND NOT regexp_matches(a, '{_W}OAEP{_E}')) OR regexp_matches(a, '(?i){_W}(MD5|SHA-?1){_E}') THEN 'high'
    WHEN regexp_matches(a, '(?i){_W}SHA-?(224|256|384|512|3){_E}') THEN NULL WHEN ext THEN 'high' ELSE 'low' END
  WHEN 'S011' THEN CASE WHEN m = 'forName' THEN CASE WHEN ext THEN 'high' WHEN hard_all THEN 'low' ELSE 'medium' END WHEN chain IS NOT NULL OR tainted THEN 'medium' ELSE 'low' END
  WHEN 'S012' THEN 'high'
  WHEN 'S013' THEN CASE WHEN ext THEN 'high' WHEN chain IS NOT NULL THEN 'medium' END END AS confidence,
  CASE rule_id
  WHEN 'S001' THEN CASE WHEN m = 'createStatement' THEN 'a statement without parameters' WHEN ext OR tainted OR chain IS NOT NULL THEN 'put together in place of parameters' WHEN hard_any THEN 'a fixed text' END
  WHEN 'S003' THEN CASE WHEN m = 'start' THEN 'a process is started' WHEN hard_any AND NOT hard_all THEN 'a fixed text with other parts' END
  WHEN 'S006' THEN CASE WHEN m = 'openConnection' THEN 'a connection is opened' END
  WHEN 'S007' THEN CASE WHEN m <> 'parse' THEN 'lock entities before use' WHEN hardened THEN 'locked, but it reads outside input' ELSE 'entities are not locked' END
  WHEN 'S008' THEN CASE m WHEN 'search' THEN 'an LDAP filter' WHEN 'lookup' THEN 'a JNDI name' ELSE 'an XPath expression' END
  WHEN 'S010' THEN CASE WHEN regexp_matches(a, '{_W}DES{_E}') THEN 'DES keys are too short' WHEN regexp_matches(a, '{_W}ECB{_E}') THEN 'ECB shows equal blocks'
    WHEN regexp_matches(a, '{_W}(RC4|ARCFOUR){_E}') THEN 'RC4 is broken' WHEN regexp_matches(a, '{_W}RSA{_E}') AND NOT regexp_matches(a, '{_W}OAEP{_E}') THEN 'RSA without OAEP padding'
    WHEN regexp_matches(a, '(?i){_W}MD5{_E}') THEN 'MD5 has collisions' WHEN regexp_matches(a, '(?i){_W}SHA-?1{_E}') THEN 'SHA-1 has collisions'
    WHEN ext THEN 'the algorithm is chosen outside' ELSE 'the algorithm is not known' END
  WHEN 'S011' THEN CASE WHEN m = 'forName' THEN 'a class by name' ELSE 'an object of such a class' END END AS why FROM s)
SELECT l_orderkey, l_linenumber, rule_id, confidence, {_pick([r.description for r in rules.RULES], "CAST(substr(rule_id, 2) AS INTEGER) - 1")} || coalesce(' - ' || why, '')
  || CASE WHEN names <> '' AND ext THEN ': outside input ' || names WHEN names <> '' AND tainted THEN ': parameter ' || names ELSE '' END
  || CASE WHEN rext THEN ' (receiver made of outside input)' WHEN rtainted THEN ' (receiver made of a parameter)' ELSE '' END AS message
FROM v WHERE confidence IS NOT NULL
"""


_CHECKS_SQL = f"""
WITH l AS (SELECT *, l_orderkey + l_linenumber AS n, {_pick([r.id for r in rules.RULES], 'l_partkey % 13')} AS rule_id FROM lineitem),
s AS (SELECT l_orderkey, l_linenumber, rule_id, {_choice(0)} AS m, {_pick(_ARGUMENTS, f'n % {len(_ARGUMENTS)}')} AS a, n % 3 = 0 AS ext,
  l_orderkey % 7 < 3 AS chained, CASE WHEN n % 4 = 0 THEN '' ELSE 'v' || l_linenumber END AS names FROM l),
v AS (SELECT *, CASE rule_id
  WHEN 'S001' THEN CASE WHEN a = '' THEN 'low:check failed: IndexError: string index out of range' WHEN a = '"RC4"' THEN 'low:check gave no verdict'
    WHEN a[2] = 'A' THEN CASE WHEN chained THEN 'critical:' ELSE 'medium:' END END
  WHEN 'S002' THEN CASE WHEN names = 'v3' THEN 'low:check failed: KeyError: ''v3''' WHEN names <> '' THEN 'medium:' END
  WHEN 'S003' THEN CASE WHEN a = '"MD5"' THEN 'low:check failed: ValueError: no MD5 here' WHEN ext OR a = '' THEN 'high:text check of ' || m END
  WHEN 'S004' THEN 'low:check failed: SyntaxError'
  WHEN 'S005' THEN 'low:check failed: LookupError: no check none' END AS told FROM s)
SELECT l_orderkey, l_linenumber, rule_id, string_split(told, ':')[1] AS confidence, substr(told, strpos(told, ':') + 1) AS message
FROM v WHERE told IS NOT NULL
"""

QUERIES = {
    "user_checks": (user_checks, _CHECKS_SQL),
    "rule_lists": (rule_lists, _RULES_SQL),
    "glob_rule_match": (glob_rule_match, f"WITH {_MATCHED} SELECT p_partkey, signature, rule_id, severity FROM matched"),
    "rule_decision": (rule_decision, f"WITH {_DECIDED} SELECT p_partkey, rule_id, confidence FROM decided WHERE confidence IS NOT NULL"),
    "severity_summary": (
        severity_summary,
        f"""WITH {_DECIDED}, fresh AS (SELECT * FROM decided WHERE confidence IS NOT NULL),
  held AS (SELECT * FROM fresh WHERE rule_id = 'R06'),
  added AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY rule_id, signature ORDER BY p_partkey) AS rn FROM fresh WHERE (rule_id, signature) NOT IN (SELECT (rule_id, signature) FROM held)) WHERE rn = 1),
  alerts AS (SELECT * FROM held UNION ALL SELECT * FROM added)
SELECT severity, count(*) AS n, min(p_partkey) AS first_seen, count(*) FILTER (WHERE confidence = 'high') AS n_high FROM alerts GROUP BY severity""",
    ),
    "exit_code": (
        exit_code,
        f"""WITH {_DECIDED}, fresh AS (SELECT * FROM decided WHERE confidence IS NOT NULL),
  held AS (SELECT * FROM fresh WHERE rule_id = 'R06'),
  added AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY rule_id, signature ORDER BY p_partkey) AS rn FROM fresh WHERE (rule_id, signature) NOT IN (SELECT (rule_id, signature) FROM held)) WHERE rn = 1),
  alerts AS (SELECT * FROM held UNION ALL SELECT * FROM added)
SELECT p_type, CAST(max(CASE WHEN severity IN ('critical', 'high') THEN 1 ELSE 0 END) AS INTEGER) AS exit_code, count(*) AS n FROM alerts GROUP BY p_type""",
    ),
    "alert_json": (
        alert_json,
        f"""WITH {_DECIDED} SELECT p_partkey, rule_id, '{{"rule":"' || rule_id || '","signature":"' || signature || '","confidence":"' || confidence || '","types":["' || p_brand || '","' || p_type || '"]}}' AS alert FROM decided WHERE confidence IS NOT NULL""",
    ),
    "qualified_name": (
        qualified_name,
        "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand || '.' ELSE '' END || p_type || '.' || p_name || '(' || replace(p_name, ' ', ',') || ')' AS name FROM part",
    ),
    "focus_filter": (focus_filter, f"SELECT p_partkey, signature FROM ({_SITES}) WHERE method = 'red_widget' OR contains(signature, 'red_widget')"),
    "builtin_type_names": (
        builtin_type_names,
        "SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'java.lang.Promo' WHEN 'SMALL' THEN 'java.lang.Small' ELSE coalesce(imported, p_type) END AS type FROM part LEFT JOIN (SELECT p_type, max(p_brand) AS imported FROM part WHERE p_type IN ('SMALL', 'LARGE', 'MEDIUM') GROUP BY p_type) USING (p_type)",
    ),
}
