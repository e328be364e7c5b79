"""Queries of the scalar functions over urls, pages, props and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calltide.functions import literals
from calltide.functions import signatures as sg
from calltide.operators import codegraph
from calltide.session import dealt, read_table


def url_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A url's host as dotted package, its last segment as class, its first as module."""
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    host = F.regexp_extract("url", r"^[a-z]+://([^/]+)/", 1)
    return read_table(spark, sf_dir, "pages").select(
        "page_id", sg.before_last(host, ".").alias("package"), sg.after_last(host, ".").alias("suffix"), F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")).alias("name"), F.size(parts).alias("depth")
    )


def href_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of every page in order."""
    found = F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))
    return read_table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("ord", "href"))


def last_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments of the last plain call in a page's script."""
    script = F.regexp_extract("html", r"(?s)<script>(.*?)</script>", 1)
    return read_table(spark, sf_dir, "pages").select("page_id", sg.last_arguments(script).alias("args"))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = codegraph.edge_metadata(read_table(spark, sf_dir, "events").withColumn("kind", F.lit("calls")), ["calls"], "k int", "props")
    k = F.col("props.k")
    return events.select("event_id", k.alias("k"), F.to_json(F.struct("event_type", k.alias("k"))).alias("again"))


def constant_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments of quoted values in texts, the last of each name in a document."""
    found = F.regexp_extract_all("text", F.lit(r'([a-z_]+) = "([^"\n]*)"'), F.lit(0))
    rows = read_table(spark, sf_dir, "documents").select("doc_id", F.posexplode(found).alias("seq", "hit"))
    rows = rows.select("doc_id", "seq", F.regexp_extract("hit", r"^([a-z_]+)", 1).alias("name"), literals.unquoted(F.regexp_extract("hit", r'("[^"]*")$', 1)).alias("value"))
    return rows.groupBy("doc_id", "name").agg(F.max_by("value", "seq").alias("value"), F.count("*").alias("n"))


def parameter_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signature with nested type arguments put together from a part, and parted again."""
    text = F.concat(F.lit("Map<"), F.col("p_type"), F.lit(", List<"), F.col("p_brand"), F.lit(">> "), F.split("p_name", " ")[0], F.lit(", "), F.split("p_name", " ")[1], F.lit(" size, int"))
    rows = read_table(spark, sf_dir, "part").select("p_partkey", F.posexplode(sg.parameters(text)).alias("pos", "p"))
    return rows.select("p_partkey", "pos", "p.type", "p.name")


def concat_operands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An expression with a quoted plus sign, its operands and merged literals."""
    text = F.concat(F.lit('"a+'), F.col("p_type"), F.lit('" + "'), F.col("p_brand"), F.lit('" + '), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(' + "z"'))
    rows = dealt(read_table(spark, sf_dir, "part")).select("p_partkey", literals.merged_literals(literals.operands(text)).alias("merged"))
    merged = F.col("merged")
    return rows.select("p_partkey", F.size(merged).alias("n"), F.array_join(F.transform(merged, lambda m: m["text"]), "|").alias("parts"), F.size(F.filter(merged, lambda m: m["literal"])).alias("literals"))


def descriptor_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JVM descriptor put together from a part, and its type names."""
    text = F.concat(F.lit("([Lcom/"), F.col("p_type"), F.lit("$Inner;I[[J)Lcom/"), F.split("p_name", " ")[0], F.lit(";"))
    return read_table(spark, sf_dir, "part").select("p_partkey", F.array_join(sg.descriptor_types(text), ",").alias("types"))


def path_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("app/src/main/java/com/"), F.lower("p_type"), F.lit("/"), F.split("p_name", " ")[0], F.lit("/"), F.split("p_name", " ")[1], F.lit(".java"))
    return read_table(spark, sf_dir, "part").select("p_partkey", sg.package_of_path(path).alias("package"))


def algorithm_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-insensitive tests on names, in the order of a decision list."""
    name = F.concat_ws("/", "p_type", "p_name")
    verdict = F.when(name.rlike("(?i)^promo/.*ring"), "high").when(name.rlike("(?i)small|medium"), "low").when(name.rlike(r"(?i)(^|[^a-z])red([^a-z]|$)"), "medium")
    return read_table(spark, sf_dir, "part").select("p_partkey", verdict.alias("verdict")).where("verdict is not null")


def describe_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages put together from whatever is known about a conversation's outside input."""
    turns = read_table(spark, sf_dir, "conversations")
    names = F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda t: t["role"] != "assistant"), lambda t: F.concat(t["role"], t["turn"].cast("string"))), ", ")
    grouped = turns.groupBy("conv_id").agg(names.alias("names"))
    return grouped.select("conv_id", F.when(F.col("names") == "", "no outside input").otherwise(F.concat(F.lit("outside input: "), "names")).alias("message"))


def name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph names, references, chained receivers, import lines and parameter lists put together from a part, and parted again."""
    word = lambda k: F.split("p_name", " ")[k]
    reference = F.when(F.col("p_size") % 2 == 0, F.concat(word(0), F.lit("."), word(1))).otherwise(word(1))
    parted, chain = sg.reference_parts(reference), sg.chained_receiver(F.concat(F.lit("a."), word(0), F.lit("(x).y()")))
    line = F.concat(F.lit("import static lib."), word(0), F.when(F.col("p_size") % 3 == 0, ".*").otherwise(""), F.lit(";"))
    named = sg.named_parameters(F.concat(F.lit("Map<A, B> "), word(0), F.lit(", int")))
    return read_table(spark, sf_dir, "part").select(
        "p_partkey", sg.graph_owner(F.concat(F.lit("src/F.java::"), F.col("p_brand"), F.lit("::"), word(0))).alias("owner"), parted["receiver"].alias("receiver"), parted["method"].alias("method"),
        chain["object"].alias("object"), chain["method"].alias("first"), F.coalesce(sg.import_name(line), F.lit("")).alias("import_name"), F.array_join(F.transform(named, lambda p: p["name"]), ",").alias("names"),
    )


QUERIES = {
    "name_parts": (
        name_parts,
        """WITH p AS (SELECT p_partkey, p_brand, p_size, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)
SELECT p_partkey, p_brand AS owner, CASE WHEN p_size % 2 = 0 THEN a ELSE '' END AS receiver, b AS method, 'a' AS object, a AS first, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'lib.' || a END AS import_name, a AS names FROM p""",
    ),
    "url_package": (
        url_package,
        r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)/', 1) AS host, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM pages)
SELECT page_id, regexp_extract(host, '^(.*)\.[^.]*$', 1) AS package, split_part(host, '.', -1) AS suffix, coalesce(parts[-1], '') AS name, CAST(len(parts) AS INTEGER) AS depth FROM p""",
    ),
    "href_extract": (
        href_extract,
        """SELECT page_id, CAST(ord - 1 AS INTEGER) AS ord, hrefs[ord] AS href FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hrefs FROM pages), unnest(range(1, len(hrefs) + 1)) AS t(ord)""",
    ),
    "last_args": (
        last_args,
        r"""SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<script>(.*?)</script>', 1), '[0-9A-Za-z_]+\s*\(([^()]*)\)', 1)[-1] AS args FROM pages""",
    ),
    "json_props": (
        json_props,
        """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, '{"event_type":"' || event_type || '","k":' || json_extract_string(props, '$.k') || '}' AS again FROM events""",
    ),
    "constant_scan": (
        constant_scan,
        r"""WITH h AS (SELECT doc_id, regexp_extract_all(text, '([a-z_]+) = "([^"\n]*)"', 1) AS names, regexp_extract_all(text, '([a-z_]+) = "([^"\n]*)"', 2) AS vals FROM documents),
r AS (SELECT doc_id, k, names[k] AS name, vals[k] AS value FROM h, unnest(range(1, len(names) + 1)) AS t(k))
SELECT doc_id, name, arg_max(value, k) AS value, count(*) AS n FROM r GROUP BY doc_id, name""",
    ),
    "parameter_lists": (
        parameter_lists,
        """SELECT p_partkey, 0 AS pos, 'Map<' || p_type || ', List<' || p_brand || '>>' AS type, split_part(p_name, ' ', 1) AS name FROM part
UNION ALL SELECT p_partkey, 1, split_part(p_name, ' ', 2), 'size' FROM part UNION ALL SELECT p_partkey, 2, 'int', '' FROM part""",
    ),
    "concat_operands": (concat_operands, "SELECT p_partkey, 3 AS n, 'a+' || p_type || p_brand || '|' || replace(p_name, ' ', '_') || '|z' AS parts, 2 AS literals FROM part"),
    "descriptor_names": (descriptor_names, "SELECT p_partkey, 'com.' || p_type || '.Inner[],int,long[][],com.' || split_part(p_name, ' ', 1) AS types FROM part"),
    "path_package": (path_package, "SELECT p_partkey, 'com.' || lower(p_type) || '.' || split_part(p_name, ' ', 1) AS package FROM part"),
    "algorithm_tests": (
        algorithm_tests,
        """SELECT * FROM (SELECT p_partkey, CASE WHEN lower(p_type) = 'promo' AND contains(lower(p_name), 'ring') THEN 'high' WHEN p_type IN ('SMALL', 'MEDIUM') OR contains(p_name, 'small') OR contains(p_name, 'medium') THEN 'low'
WHEN list_contains(string_split(p_name, ' '), 'red') THEN 'medium' END AS verdict FROM part) WHERE verdict IS NOT NULL""",
    ),
    "describe_flow": (
        describe_flow,
        "SELECT conv_id, coalesce('outside input: ' || string_agg(role || turn, ', ' ORDER BY turn) FILTER (WHERE role <> 'assistant'), 'no outside input') AS message FROM conversations GROUP BY conv_id",
    ),
}
