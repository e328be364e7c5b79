"""Column builders for method signatures, qualified names and parameter lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\r\n\x0B\f]+"


def trimmed(text: Column) -> Column:
    """White space of every kind taken from both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def or_else(value: Column, *others: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in (value, *others)))


def qualified_name(package: Column, class_name: Column, method: Column, types: Column) -> Column:
    """``package.Class.method(T,U)``; empty or null packages and classes are left out."""
    head = F.concat_ws(".", F.nullif(package, F.lit("")), F.nullif(class_name, F.lit("")), method)
    return F.concat(head, F.lit("("), F.array_join(types, ","), F.lit(")"))


def parameter_text(signature: Column) -> Column:
    """What stands in the first parentheses without inner ones; empty if there are none."""
    return F.regexp_extract(signature, r"\(([^()]*)\)", 1)


def split_top_level(text: Column, opening: str = "<", closing: str = ">") -> Column:
    """Parts between commas that are outside the brackets given, trimmed, empty ones dropped."""
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("parts"), F.lit("").alias("open"))

    def step(acc: Column, c: Column) -> Column:
        cut = (c == ",") & (acc["depth"] == 0)
        return F.struct(
            (acc["depth"] + F.when(c.isin(*opening), 1).when(c.isin(*closing), -1).otherwise(0)).alias("depth"),
            F.when(cut, F.concat(acc["parts"], F.array(acc["open"]))).otherwise(acc["parts"]).alias("parts"),
            F.when(cut, F.lit("")).otherwise(F.concat(acc["open"], c)).alias("open"),
        )

    whole = F.aggregate(F.split(text, ""), start, step, lambda acc: F.concat(acc["parts"], F.array(acc["open"])))
    return F.filter(F.transform(whole, trimmed), lambda p: p != "")


def parameters(text: Column) -> Column:
    """(type, name) of each parameter of a list; a lone word is a type without a name."""
    last = lambda p: F.regexp_extract(p, r"^(.*\S)\s+(\S+)$", 2)
    return F.transform(
        split_top_level(text),
        lambda p: F.struct(F.when(last(p) == "", p).otherwise(F.regexp_extract(p, r"^(.*\S)\s+(\S+)$", 1)).alias("type"), last(p).alias("name")),
    )


def last_arguments(line: Column) -> Column:
    """Arguments of the last call on a line whose parentheses hold no others; null without one."""
    return F.try_element_at(F.regexp_extract_all(line, F.lit(r"\w+\s*\(([^()]*)\)"), F.lit(1)), F.lit(-1))


def simple_type(type_: Column) -> Column:
    """Without type arguments, arrays and dots of variable length."""
    return trimmed(F.regexp_replace(F.regexp_replace(type_, r"<.*>", ""), r"\[\]|\.\.\.", ""))


def after_last(text: Column, mark: str) -> Column:
    return F.element_at(F.split(text, "\\" + mark), -1)


def before_last(text: Column, mark: str) -> Column:
    """Empty without the mark."""
    return F.regexp_extract(text, rf"^(.*)\{mark}[^{mark}]*$", 1)


# Java's primitive types with their descriptor letters.
PRIMITIVES = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "Z": "boolean", "V": "void"}


def descriptor_types(descriptor: Column) -> Column:
    """Dotted type names that a JVM method descriptor lists, the return type last."""
    names = F.create_map(*(F.lit(x) for kv in PRIMITIVES.items() for x in kv))
    units = F.regexp_extract_all(descriptor, F.lit(r"\[*(?:[BCDFIJSZV]|L[^;]+;)"), F.lit(0))

    def name(unit: Column) -> Column:
        bare = F.regexp_replace(unit, r"^\[+", "")
        plain = F.when(bare.startswith("L"), F.translate(F.regexp_extract(bare, "^L(.*);$", 1), "/$", "..")).otherwise(F.try_element_at(names, bare))
        return F.concat(plain, F.repeat(F.lit("[]"), F.length(unit) - F.length(bare)))

    return F.transform(units, name)


def package_of_path(path: Column) -> Column:
    """Dotted package of a source file below src/main/java, src/test/java or src; empty otherwise."""
    return F.replace(F.regexp_extract(path, r"(?:^|/)src/(?:(?:main|test)/java/)?(.*)/[^/]+$", 1), F.lit("/"), F.lit("."))


def named_parameters(text: Column) -> Column:
    """(type, name) of the parameters that have a name."""
    return F.filter(parameters(text), lambda p: p["name"] != "")


def reference_parts(name: Column) -> Column:
    """(receiver, method) of a reference, parted at its last dot; without one, or with nothing before it, no receiver."""
    head = F.regexp_extract(name, r"^(.+)\.([^.]*)$", 1)
    return F.struct(head.alias("receiver"), F.when(head == "", name).otherwise(F.regexp_extract(name, r"^(.+)\.([^.]*)$", 2)).alias("method"))


def graph_owner(qualified: Column) -> Column:
    """Class part of a graph name ``file::Class::method``: the last but one; of a name of two parts that is the file."""
    return F.coalesce(F.try_element_at(F.split(qualified, "::"), F.lit(-2)), F.lit(""))


def chained_receiver(text: Column) -> Column:
    """(object, method) of a receiver that is a call: what stands before the last dot before its first parenthesis."""
    rx = r"^([^(]*)\.(\w+)\s*\("
    return F.struct(F.regexp_extract(text, rx, 1).alias("object"), F.regexp_extract(text, rx, 2).alias("method"))


def import_name(line: Column) -> Column:
    """Qualified name of an import line; null for wildcards and other lines."""
    return F.nullif(F.regexp_extract(line, r"^\s*import\s+(?:static\s+)?([\w.]+[\w])\s*;?\s*$", 1), F.lit(""))


def type_name(type_: Column, imported: Column, built_in: dict[str, str]) -> Column:
    """Qualified name of a type without its arguments: a built-in name first, then the file's import, else as it stands."""
    bare = simple_type(type_)
    known = F.create_map(*(F.lit(x) for kv in built_in.items() for x in kv))
    return F.coalesce(F.try_element_at(known, bare), imported, bare)
