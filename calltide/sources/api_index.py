"""Class, method and field tables of a library: from compact JSON, from javap text, and back to JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calltide.functions.signatures import descriptor_types, trimmed
from calltide.operators.lookup import inherited, linearised


# The modifiers that an index names, in its order.
METHOD_MODIFIERS = ["static", "abstract", "final", "synchronized", "native", "default"]
FIELD_MODIFIERS = ["static", "final", "volatile", "transient"]
# A line that names a class; one that names a member; arguments of types, three deep.
_CLASS = r"(?m)^(?=[ \t]*(?:(?:public|protected|private|abstract|final|static|strictfp|sealed|non-sealed) +)*(?:class|interface|enum|@interface) +[\w.$]+)"
_MEMBER = r"\n(?=[^\n:]*;[ \t\r]*(?:\n|$))"
_GENERIC = r"<[^<>]*(?:<[^<>]*(?:<[^<>]*>[^<>]*)*>[^<>]*)*>"


def read_compact(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, methods, fields) of JSON ``{class: {s, i, m: {name: [[descriptor, returns, parameters, modifiers, throws,
    deprecated]]}, f: {name: [type, modifiers]}}}``; of rows with less, parameters come from the descriptor, the rest is empty."""
    shape = "map<string, struct<s: string, i: array<string>, m: map<string, array<array<string>>>, f: map<string, array<string>>>>"
    one = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", shape)).alias("name", "c"))
    none = F.array().cast("array<string>")
    listed = lambda i: F.coalesce(F.from_json(F.get("v", i), "array<string>"), none)
    classes = one.select("name", F.nullif("c.s", F.lit("")).alias("super_class"), F.coalesce("c.i", none).alias("interfaces"))
    rows = one.select(F.col("name").alias("class_name"), F.explode("c.m").alias("method_name", "o"))
    rows = rows.select("class_name", "method_name", F.posexplode("o").alias("ordinal", "v")).withColumn("descriptor", F.get("v", 0))
    types = descriptor_types(F.col("descriptor"))
    told = F.slice(types, 1, F.greatest(F.size(types) - 1, F.lit(0)))
    params = F.coalesce(F.from_json(F.get("v", 2), "array<string>"), told).alias("param_types")
    rest = (listed(3).alias("modifiers"), listed(4).alias("throws"), F.coalesce(F.get("v", 5) == "1", F.lit(False)).alias("deprecated"))
    methods = rows.select("class_name", "method_name", "ordinal", "descriptor", F.get("v", 1).alias("return_type"), params, *rest)
    fields = one.select(F.col("name").alias("class_name"), F.explode("c.f").alias("field_name", "v"))
    return classes, methods, fields.select("class_name", "field_name", F.get("v", 0).alias("type"), listed(1).alias("modifiers"))


def parse_javap(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same tables from what ``javap -public -s`` or ``-v`` prints: texts (file, text), each a file or a part of one that no
    class crosses. A class goes from the line that names it to its closing brace, and is a row of its own from there on; a member
    from its line to the next one's, and descriptor and deprecation are looked for in between. Lines outside of classes, members
    without a descriptor and initialisers count for nothing. A class that is printed twice has the members of its last printing (by
    file, place and text). Null and empty texts have no classes."""
    block = texts.select("file", F.posexplode(F.split("text", _CLASS)).alias("at", "block")).where(F.col("block").rlike(r"\A" + _CLASS[4:]))
    block = block.withColumn("block", F.get(F.split("block", r"\n[ \t]*\}[ \t\r]*(?:\n|$)", 2), 0))
    plain = lambda line: F.regexp_replace(F.regexp_replace(line, _GENERIC, ""), r"\$", ".")
    listed = lambda text, rx: F.filter(F.transform(F.split(F.regexp_extract(text, rx, 1), ","), trimmed), lambda x: x != "")
    named = block.withColumn("head", plain(F.regexp_extract("block", r"^[^\n]*", 0)))
    named = named.withColumn("name", F.regexp_extract("head", r"(?:class|interface|enum) +([\w.]+)", 1))
    last = named.groupBy("name").agg(F.max(F.struct("file", "at", "block", "head")).alias("c")).select("name", "c.block", "c.head")

    interface = F.col("head").rlike(r"(^|[\s@])interface ")
    extends = listed(F.col("head"), r"\sextends ([\w., ]+?)(?: implements |\s*\{)")
    above = F.when(interface, extends).otherwise(listed(F.col("head"), r"\simplements ([\w., ]+?)\s*\{"))
    classes = last.select("name", F.when(~interface, F.get(extends, 0)).alias("super_class"), above.alias("interfaces"))

    members = F.split("block", _MEMBER)
    rows = last.select(F.col("name").alias("class_name"), F.posexplode(F.slice(members, 2, F.greatest(F.size(members) - 1, F.lit(0)))).alias("place", "text"))
    rows = rows.withColumn("line", plain(F.regexp_extract("text", r"^[^\n]*", 0)))
    rows = rows.withColumn("descriptor", F.regexp_extract("text", r"\n\s*descriptor:\s+(\S+)", 1)).where("descriptor <> ''")
    words = F.split(F.trim(F.regexp_extract("line", r"^[^(=;]*", 0)), r"\s+")
    modifiers = lambda known: F.array_intersect(F.array(*map(F.lit, known)), words)
    types = descriptor_types(F.col("descriptor"))

    called = F.regexp_extract("line", r"([\w.]+)\s*\(", 1)
    method = F.when(called == F.col("class_name"), "<init>").otherwise(called)
    m = rows.where("descriptor like '(%'").select(
        "class_name", method.alias("method_name"), "place", "descriptor", F.element_at(types, -1).alias("return_type"), F.slice(types, 1, F.size(types) - 1).alias("param_types"),
        modifiers(METHOD_MODIFIERS).alias("modifiers"), listed(F.col("line"), r"\)\s*throws\s+([^;]+)").alias("throws"), F.col("text").rlike(r"\n\s*Deprecated: true[ \t\r]*(?:\n|$)").alias("deprecated"),
    ).where("method_name <> ''")
    order = Window.partitionBy("class_name", "method_name").orderBy("place")
    columns = ["class_name", "method_name", "ordinal", "descriptor", "return_type", "param_types", "modifiers", "throws", "deprecated"]
    methods = m.withColumn("ordinal", F.row_number().over(order) - 1).select(*columns)
    field = F.regexp_extract("line", r"(\w+)\s*(?:=[^;]*)?;\s*$", 1)
    fields = rows.where("descriptor not like '(%'").select("class_name", field.alias("field_name"), F.get(types, 0).alias("type"), modifiers(FIELD_MODIFIERS).alias("modifiers"))
    return classes, methods, fields


def _quoted(text: Column) -> Column:
    """A text as JSON; null is empty."""
    one = F.to_json(F.array(F.coalesce(text, F.lit(""))))
    return F.substring(one, F.lit(2), F.length(one) - 2)


def _object(entries: Column) -> Column:
    """The JSON object of entries (key, json), by key."""
    each = F.transform(F.array_sort(entries), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), e["json"]))
    return F.concat(F.lit("{"), F.coalesce(F.array_join(each, ","), F.lit("")), F.lit("}"))


def to_compact(classes: DataFrame, methods: DataFrame, fields: DataFrame) -> DataFrame:
    """(name, json): one compact JSON object per class, of the shape that ``read_compact`` reads. What a class lacks is empty."""
    listed = lambda c: F.coalesce(F.to_json(c), F.lit("[]"))
    row = lambda *parts: F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))
    flag = F.when(F.col("deprecated"), "1").otherwise("0")
    m = methods.select("class_name", "method_name", "ordinal", row(_quoted(F.col("descriptor")), _quoted(F.col("return_type")), listed("param_types"), listed("modifiers"), listed("throws"), flag).alias("json"))
    m = m.groupBy("class_name", "method_name").agg(F.array_sort(F.collect_list(F.struct("ordinal", "json"))).alias("o"))
    m = m.select("class_name", F.struct(F.col("method_name").alias("key"), row(F.array_join("o.json", ",")).alias("json")).alias("e"))
    f = fields.select("class_name", F.struct(F.col("field_name").alias("key"), row(_quoted(F.col("type")), listed("modifiers")).alias("json")).alias("e"))
    gathered = lambda d, into: d.groupBy("class_name").agg(F.collect_list("e").alias(into))
    rows = classes.withColumnRenamed("name", "class_name").join(gathered(m, "m"), "class_name", "left").join(gathered(f, "f"), "class_name", "left")
    parts = ('{"s":', _quoted(F.col("super_class"))), (',"i":', listed("interfaces")), (',"m":', _object(F.col("m"))), (',"f":', _object(F.col("f")))
    return rows.select(F.col("class_name").alias("name"), F.concat(*(x for k, v in parts for x in (F.lit(k), v)), F.lit("}")).alias("json"))


def supers(classes: DataFrame) -> DataFrame:
    """(name, super, ord): the superclass first, then the interfaces in order."""
    every = classes.select("name", F.posexplode(F.concat(F.filter(F.array("super_class"), lambda s: s.isNotNull()), F.coalesce("interfaces", F.array().cast("array<string>")))).alias("ord", "super"))
    return every.select("name", "super", "ord")


def return_types(asked: DataFrame, classes: DataFrame, methods: DataFrame) -> DataFrame:
    """(class_name, method, return_type): the first overload of the nearest class that has the method; primitives and void are null."""
    found = inherited(asked, linearised(supers(classes)), methods.select(F.col("class_name").alias("owner"), F.col("method_name").alias("member")), "class_name", "method")
    first = methods.where("ordinal = 0").select(F.col("class_name").alias("owner"), F.col("method_name").alias("method"), F.when(F.col("return_type").contains("."), F.col("return_type")).alias("return_type"))
    return found.join(first, ["owner", "method"]).select("class_name", "method", "return_type")


def index_stats(classes: DataFrame, methods: DataFrame, fields: DataFrame) -> DataFrame:
    """One row: classes, methods, overloads past the first, fields."""
    count = lambda rows, what: rows.select(F.lit(what).alias("what"), F.lit(1).alias("n"))
    names = methods.groupBy("class_name", "method_name").agg(F.count("*").alias("n"))
    over = names.select(F.lit("overloads").alias("what"), (F.col("n") - 1).cast("int").alias("n"))
    every = count(classes, "classes").union(count(methods, "methods")).union(over).union(count(fields, "fields"))
    return every.agg(*(F.coalesce(F.sum(F.when(F.col("what") == c, F.col("n"))), F.lit(0)).alias(c) for c in ("classes", "methods", "overloads", "fields")))


def javap_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of what ``javap -public -s`` has printed, one row for a class: the reader itself parts files at closing braces, so
    that one large file is read by many tasks."""
    return spark.read.text(path, lineSep="\n}").select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def write_index(classes: DataFrame, methods: DataFrame, fields: DataFrame, path: str) -> None:
    """The three tables as Parquet below the path, in place of what is there."""
    for name, table in (("classes", classes), ("methods", methods), ("fields", fields)):
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables that ``write_index`` has written."""
    classes, methods, fields = (spark.read.parquet(f"{path}/{name}") for name in ("classes", "methods", "fields"))
    return classes, methods, fields


def overloads(asked: DataFrame, classes: DataFrame, methods: DataFrame) -> DataFrame:
    """(class_name, method, owner, ordinal, descriptor): all overloads of the nearest class that has the method."""
    found = inherited(asked, linearised(supers(classes)), methods.select(F.col("class_name").alias("owner"), F.col("method_name").alias("member")), "class_name", "method")
    there = methods.select(F.col("class_name").alias("owner"), F.col("method_name").alias("method"), "ordinal", "descriptor")
    return found.join(there, ["owner", "method"]).select("class_name", "method", "owner", "ordinal", "descriptor")


def field_types(asked: DataFrame, fields: DataFrame) -> DataFrame:
    """(class_name, field_name, type) of the class's own field; null without one."""
    return asked.join(fields.select("class_name", "field_name", "type"), ["class_name", "field_name"], "left")


def class_info(asked: DataFrame, classes: DataFrame) -> DataFrame:
    """asked (name) with super_class, interfaces and whether the class is known."""
    return asked.join(classes.withColumn("known", F.lit(True)), "name", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def first_returns(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """(class_name, method, return_type) of every method that a class has or inherits: the first overload of the nearest class;
    primitives and void are null."""
    order = linearised(supers(classes)).select(F.col("name").alias("class_name"), F.col("ancestor").alias("owner"), "rank")
    own = methods.where("ordinal = 0").select(F.col("class_name").alias("owner"), F.col("method_name").alias("method"), F.when(F.col("return_type").contains("."), F.col("return_type")).alias("return_type"))
    alone = own.select(F.col("owner").alias("class_name"), "owner").distinct().withColumn("rank", F.lit(None).cast(order.schema["rank"].dataType))
    every = order.unionByName(alone.join(order.select("class_name").distinct(), "class_name", "left_anti"))
    rows = every.join(own, "owner")
    return rows.groupBy("class_name", "method").agg(F.min_by("return_type", F.struct("rank", "owner")).alias("return_type"))
