"""Operator 1: secret scans by base patterns and a randomness test battery; DataFrame functions only.

Base spans are the leftmost non-overlapping matches of each kind that pass its length (contract of the query). A span is
the whole match. Other candidates are runs of ``MIN`` or more letters, digits, ``+ / _ -``; each gets the encoding with the least
alphabet that holds it (hexadecimal, base 32, one-case alphanumeric, letters, base 62, base 64). Three tests against uniform
random characters of that alphabet give one p-value each: chi-squared of the character counts (Wilson-Hilferty), runs
above and below the alphabet's middle, and serial correlation of neighbours (normal; its distribution function by the
logistic approximation). Fisher's method combines them.

Random characters and short words cannot be told apart by tests alone, so false discoveries are controlled by length:
candidates of letters of one case alone, or of digits alone, are ordinary words and numbers and serve as decoys. Per length
band, a level of the combined p-value is accepted only if the decoys of that and all shorter bands (shorter words look more
random, so this is on the safe side) show a false-discovery rate of at most ``FDR`` there, and the p-value is not below 0.01.
To the decoys are added ``PRIOR`` supposed ones of the band, of which a share of 2 ** -(length / HALVES) passes at any level: a
table with few decoys still accepts long random tokens, and one with many goes by its own.
The table of counts has bands x levels rows whatever the input; its thresholds are the only thing the driver reads. Texts are
scanned once: base spans and tested candidates are written to the shared folder before the thresholds are known.

Defined results: null and empty texts have no spans; offsets are code points, end exclusive; repeated rows are each
scanned; added spans of kind ``random`` touch no base span; a null doc_id is a row like any other; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltide.session import Scratch

KINDS = ("assign", "access", "hex", "random")
MIN, FDR = 20, 0.05
#: Upper lengths of the bands, and levels: -10 log10 of the combined p-value.
BANDS, LEVELS = (23, 27, 31, 39, 47, 63, 127, 255), 60
#: Largest level accepted at all: a combined p-value of 0.01.
LEVEL = 20
#: Supposed decoys of a band, and characters by which the share of them that pass is halved.
PRIOR, HALVES = 20, 4

# The contract's patterns.
_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ACCESS, _HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]{24,}"
_RUN = r"[A-Za-z0-9+/_-]{%d,}" % MIN
_DIGIT, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings by size of alphabet: pattern, alphabet in its order.
ENCODINGS = (
    ("^[0-9a-f]*$", _DIGIT + "abcdef"),
    ("^[0-9A-F]*$", _DIGIT + "ABCDEF"),
    ("^[A-Z2-7]*$", _UPPER + "234567"),
    ("^[0-9a-z]*$", _DIGIT + _LOWER),
    ("^[0-9A-Z]*$", _DIGIT + _UPPER),
    ("^[A-Za-z]*$", _UPPER + _LOWER),
    ("^[0-9A-Za-z]*$", _DIGIT + _UPPER + _LOWER),
    ("^[0-9A-Za-z+/]*$", _UPPER + _LOWER + _DIGIT + "+/"),
    ("^[0-9A-Za-z_-]*$", _UPPER + _LOWER + _DIGIT + "-_"),
    (".*", _UPPER + _LOWER + _DIGIT + "+/-_"),
)


_SPAN = "struct<kind:string,start:int,end:int,found:string>"


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with the value computed once."""
    return F.get(F.transform(F.array(value), of), 0)


def matches(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """docs (doc_id, text) with an array of (kind, start, end, found) for each kind: every leftmost non-overlapping match
    of its pattern. What lies between the matches gives their places."""
    found = docs.select("doc_id", "text", *(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"f_{k}") for k, p in patterns.items()))
    gaps = found.select("doc_id", *(f"f_{k}" for k in patterns), *(F.when(F.size(f"f_{k}") > 0, F.split("text", p, -1)).otherwise(F.array()).alias(f"g_{k}") for k, p in patterns.items()))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("spans"))

    def step(kind: str) -> Callable[[Column, Column], Column]:
        def add(acc: Column, x: Column) -> Column:
            begin = acc["at"] + F.length(x["gap"])
            end = begin + F.length(x["found"])
            span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), x["found"].alias("found"))
            return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

        return add

    pair = lambda g, m: F.struct(g.alias("gap"), m.alias("found"))
    spans = lambda k: F.aggregate(F.zip_with(F.slice(f"g_{k}", 1, F.size(f"f_{k}")), f"f_{k}", pair), start, step(k))["spans"]
    return gaps.select("doc_id", *(spans(k).alias(k) for k in patterns))


def _upper_tail(z: Column) -> Column:
    """Of the normal distribution."""
    return 1 / (1 + F.exp(F.least(1.5976 * z + 0.07056 * z * z * z, F.lit(80.0))))


def _chi_squared(token: Column, chars: Column, n: Column, size: Column) -> Column:
    squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s + F.pow(n - F.length(F.replace(token, c, F.lit(""))), F.lit(2.0)))
    df = size - 1
    return _upper_tail((F.pow(F.greatest(size / n * squares - n, F.lit(1e-9)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))


def _runs(pairs: Column, n: Column, size: Column) -> Column:
    changes = F.size(F.filter(pairs, lambda q: (q["x"] < size / 2) != (q["y"] < size / 2)))
    return 2 * _upper_tail(F.abs(changes - (n - 1) / 2) / F.sqrt((n - 1) / 4))


def _serial(pairs: Column, n: Column, size: Column) -> Column:
    total = F.aggregate(pairs, F.lit(0.0), lambda s, q: s + (q["x"] - size / 2) * (q["y"] - size / 2))
    return 2 * _upper_tail(F.abs(total / (size * size / 12)) / F.sqrt(n - 1))


def _level(p: list[Column]) -> Column:
    """Fisher's method for three p-values, as -10 log10 of the combined one."""
    half = -sum((F.ln(F.greatest(x, F.lit(1e-30))) for x in p[1:]), F.ln(F.greatest(p[0], F.lit(1e-30))))
    return let(half, lambda h: F.least(F.greatest(F.floor(10 * (h - F.ln(1 + h + h * h / 2)) / F.ln(F.lit(10.0))), F.lit(0)), F.lit(LEVELS)).cast("int"))


def battery(token: Column) -> Column:
    """(band, level, decoy) of a candidate."""
    n = F.length(token).cast("double")
    alphabet = F.coalesce(*(F.when(token.rlike(p), F.lit(a)) for p, a in ENCODINGS))
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    couple = lambda v: F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda x, y: F.struct(x.alias("x"), y.alias("y")))

    def tests(a: Column, c: Column, pairs: Column) -> Column:
        size = F.length(a).cast("double")
        return _level([_chi_squared(token, c, n, size), _runs(pairs, n, size), _serial(pairs, n, size)])

    places = lambda a, c: F.transform(c, lambda x: F.position(x, a).cast("double") - 0.5)
    level = let(alphabet, lambda a: let(chars, lambda c: let(places(a, c), lambda v: let(couple(v), lambda q: tests(a, c, q)))))
    band = F.coalesce(*(F.when(n <= b, F.lit(i)) for i, b in enumerate(BANDS)), F.lit(len(BANDS)))
    plain = token.rlike("^([^a-zA-Z]*|[^A-Z0-9]*|[^a-z0-9]*)$")
    return F.struct(band.alias("band"), level.alias("level"), plain.alias("decoy"))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, base, runs): base spans, and the candidates that touch none, each with its ``test``."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = matches(text, {"assign": _ASSIGN, "access": _ACCESS, "hex": _HEX, "random": _RUN})
    value = F.filter("assign", lambda s: F.length(F.regexp_extract(s["found"], _ASSIGN, 2)) >= 6)
    rows = rows.select("doc_id", F.concat(value, F.filter("access", lambda s: F.length(s["found"]) >= 20), "hex").alias("base"), "random")
    clear = F.filter("random", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return rows.select("doc_id", "base", F.transform(clear, lambda s: F.struct(s.alias("span"), battery(s["found"]).alias("test"))).alias("runs"))


def thresholds(found: DataFrame) -> list[int]:
    """Largest accepted level of each length band, -1 for none: bands x levels counts reach the driver."""
    counts = found.select(F.explode("runs.test").alias("t")).groupBy("t.band", "t.level").agg(F.count_if(~F.col("t.decoy")).alias("n"), F.count_if("t.decoy").alias("d")).collect()
    out = []
    for band in range(len(BANDS) + 1):
        decoys = [sum(r.d for r in counts if r.band <= band and r.level <= k) for k in range(LEVELS + 1)]
        targets = [sum(r.n for r in counts if r.band == band and r.level <= k) for k in range(LEVELS + 1)]
        length = BANDS[band - 1] + 1 if band else MIN
        expected = lambda k: (decoys[k] + PRIOR * 2 ** -(length / HALVES)) / (decoys[-1] + PRIOR) * targets[-1]  # noqa: B023, E731
        out.append(max((k for k in range(LEVEL + 1) if targets[k] and expected(k) <= FDR * targets[k]), default=-1))
    return out


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, end, found) by start, then kind as listed."""
    found = Scratch(docs.sparkSession).keep(candidates(docs))
    limits = F.array(*map(F.lit, thresholds(found)))
    kept = F.filter("runs", lambda r: ~r["test"]["decoy"] & (r["test"]["level"] <= F.get(limits, r["test"]["band"])))
    names = F.array(*map(F.lit, KINDS))
    ranked = lambda s: F.struct(s["start"].alias("start"), F.array_position(names, s["kind"]).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"), s["found"].alias("found"))
    plain = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found"))
    order = lambda a: F.transform(F.array_sort(F.transform(a, ranked)), plain)
    return found.select("doc_id", order(F.col("base")).alias("base"), order(F.concat("base", F.transform(kept, lambda r: r["span"]))).alias("spans"))
