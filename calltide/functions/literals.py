"""Column builders for argument expressions: literals, concatenation, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from calltide.functions.signatures import trimmed


def is_literal(text: Column) -> Column:
    """A quoted text without inner quotes, a number, null, true or false."""
    return text.rlike(r"""^("[^"]*"|'[^']*'|-?[0-9]+(\.[0-9]+)?[LlFfDd]?|null|true|false)$""")


def unquoted(text: Column) -> Column:
    return F.regexp_replace(text, r"""^["'](.*)["']$""", "$1")


#: A quoted text, or one that is not closed and runs to the end.
_QUOTED = r"""\"[^\"]*+(?:\"|\z)|'[^']*+(?:'|\z)"""


#: Texts whose brackets close, three deep at most: kinds of brackets are not told apart.
_FLAT = r"[^()<>\[\]{}\"']++"
_DEEP = ""
for _ in range(3):
    _DEEP = rf"[(<\[{{](?:{_FLAT}|{_QUOTED}{_DEEP})*+[)>\]}}]"
    _DEEP = "|" + _DEEP
_CLOSED = rf"\A(?:{_FLAT}|{_QUOTED}{_DEEP})*+\z"


def _kept(parts: Column) -> Column:
    """Parts trimmed, empty ones dropped."""
    return F.filter(F.transform(parts, trimmed), lambda p: p != "")


def arguments(text: Column) -> Column:
    """Arguments of a call: commas inside quotes or brackets do not part them. One pattern cuts texts whose brackets close and are three
    deep at most; in others they are followed from token to token (a quoted text, a bracket, a comma, what stands between)."""
    plain = F.regexp_extract_all(text, F.lit(rf"(?:[^,\"']++|{_QUOTED})++"), F.lit(0))
    closed = F.regexp_extract_all(text, F.lit(rf"(?:[^,()<>\[\]{{}}\"']++|{_QUOTED}{_DEEP})++"), F.lit(0))
    tokens = F.regexp_extract_all(text, F.lit(rf"{_QUOTED}|[,()<>\[\]{{}}]|[^,()<>\[\]{{}}\"']++"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("parts"), F.lit("").alias("open"))

    def step(acc: Column, t: Column) -> Column:
        cut = (t == ",") & (acc["depth"] == 0)
        move = F.when(t.isin("(", "<", "[", "{"), 1).when(t.isin(")", ">", "]", "}"), -1).otherwise(0)
        return F.struct(
            (acc["depth"] + move).alias("depth"),
            F.when(cut, F.concat(acc["parts"], F.array(acc["open"]))).otherwise(acc["parts"]).alias("parts"),
            F.when(cut, F.lit("")).otherwise(F.concat(acc["open"], t)).alias("open"),
        )

    whole = F.aggregate(tokens, start, step, lambda acc: F.concat(acc["parts"], F.array(acc["open"])))
    return _kept(F.when(~text.rlike(r"[()<>\[\]{}]"), plain).when(text.rlike(_CLOSED), closed).otherwise(whole))


def operands(text: Column) -> Column:
    """Operands of a text concatenation: ``+`` inside quotes does not part them."""
    quoted = F.regexp_extract_all(text, F.lit(rf"(?:[^+\"']++|{_QUOTED})++"), F.lit(0))
    return _kept(F.when(text.contains('"') | text.contains("'"), quoted).otherwise(F.split(text, r"\+")))


def merged_literals(parts: Column) -> Column:
    """(text, literal) of each operand, neighbouring literals merged into one."""
    start = F.array().cast("array<struct<text:string,literal:boolean>>")

    def step(acc: Column, p: Column) -> Column:
        literal = is_literal(p)
        text = F.when(literal, unquoted(p)).otherwise(p)
        last = F.try_element_at(acc, F.lit(-1))
        merge = literal & F.coalesce(last["literal"], F.lit(False))
        item = F.struct(F.when(merge, F.concat(last["text"], text)).otherwise(text).alias("text"), literal.alias("literal"))
        return F.concat(F.when(merge, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc), F.array(item))

    return F.aggregate(parts, start, step)


def identifier(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*$")


def call_name(text: Column) -> Column:
    """Name of the method that an argument calls last; empty if it is no call."""
    return F.regexp_extract(text, r"(\w+)\s*\([^()]*\)$", 1)
