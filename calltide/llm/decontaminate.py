"""Operator 5: benchmark decontamination by SimHash windows, multi-index Hamming blocks and exact similarity; DataFrame
functions only.

Texts are lower-cased and cut into words at white space; a shingle is ``SIZE`` words. For each item, the windows of a
document that have the item's number of words are compared with it. A window without any shingle of the benchmark has
similarity 0 with every item; windows are made that line up a shared shingle (shingle join), and all between two of these that
are no further apart than a similarity of 0.8 lets words be inserted or left out. Each gets a
64-bit SimHash of its shingles, weighted by how often they occur in it. Fingerprints are cut into ``BLOCKS`` blocks; the
items' blocks are listed with all their neighbours within ``RADIUS // BLOCKS`` bits, so every window within ``RADIUS``
bits of an item of its size shares a block with it (pigeonhole). Candidates are verified by the exact weighted Jaccard
similarity of their shingles, ``PERCENT`` or more.

Joins on the benchmark are broadcast only where Spark's size limit allows it; beyond, they are shuffled.
Defined results: null and empty texts have no shingle and are clean; items of fewer than ``SIZE`` words have none and
leak nowhere; documents shorter than an item are compared whole; repeated rows and null ids each get a row; other
columns are ignored. Empty tables: no leaks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calltide.llm.filters import sized, without
from calltide.session import Scratch

SIZE, PERCENT = 5, 80
BLOCKS, RADIUS = 4, 15
BITS = 64 // BLOCKS
_SPACE = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Lower-case words; one empty word for a blank text."""
    return F.split(F.lower(F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACE))), r"[\x20\x09-\x0D]+", -1)


def shingles(w: str) -> Column:
    """64-bit hashes of every SIZE neighbouring words of the array column ``w``."""
    at = lambda i, k: F.get(F.col(w), i + k)
    return F.transform(F.slice(w, 1, F.greatest(F.size(w) - (SIZE - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(at(i, k) for k in range(1, SIZE))))


def simhash(grams: str) -> Column:
    """Bit b is set if most shingles, each as often as it occurs, have bit b."""
    ones = lambda b: F.aggregate(grams, F.lit(0), lambda n, g: n + _bit(g, b))
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(63)),
        F.lit(0).cast("long"),
        lambda out, b: out.bitwiseOR(F.when(2 * ones(b) > F.size(grams), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))),
    )


def _bit(g: Column, b: Column) -> Column:
    return F.call_function("shiftright", g, b).bitwiseAND(F.lit(1)).cast("int")


def _block(print_: Column, k: int) -> Column:
    return F.shiftrightunsigned(print_, BITS * k).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def common(a: str, b: str) -> Column:
    """Size of the multiset intersection of two arrays."""
    times = lambda array, x: F.size(F.filter(array, lambda y: y == x))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(times(a, x), times(b, x)))


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows by doc_id and text: repeated rows share a key and a result."""
    return docs.select("*", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__k"), F.xxhash64("text").alias("__th"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(__k, __th, item_id, percent): verified leaks of items in documents."""
    scratch = Scratch(docs.sparkSession)
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") >= SIZE).select("item_id", F.size("w").alias("size"), shingles("w").alias("ig"))
    listed = items.select("size", F.posexplode("ig").alias("at", "g")).distinct()

    texts = _keyed(docs.select("doc_id", "text").where("text is not null")).select("__k", "__th", words(F.col("text")).alias("w"))
    grams = texts.select("__k", "__th", F.size("w").alias("n"), F.posexplode(shingles("w")).alias("pos", "g"))
    start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("at"), F.col("n") - F.col("size")))
    wanted = grams.join(listed, "g").select("__k", "__th", start.alias("start"), "size").distinct()
    near = F.col("size") * (100 - PERCENT) / 100 + 1
    w = Window.partitionBy("__k", "__th", "size").orderBy("start")
    next_ = F.coalesce(F.lead("start").over(w), F.col("start") + 1)
    wanted = wanted.withColumn("next", F.when(next_ - F.col("start") <= near, next_).otherwise(F.col("start") + 1))
    wanted = wanted.select("__k", "__th", "size", F.explode(F.sequence("start", F.col("next") - 1)).alias("start"))
    wanted = scratch.keep(wanted.groupBy("__k", "__th").agg(F.collect_set(F.struct("start", "size")).alias("windows")))  # a document's own windows

    held = texts.join(sized(wanted.select("__k", "__th")), ["__k", "__th"], "left_semi")
    cut = held.join(wanted, ["__k", "__th"]).dropDuplicates(["__k", "__th"]).select("__k", "__th", F.explode("windows").alias("v"), "w")
    cut = cut.select("__k", "__th", "v.size", F.expr("slice(w, v.start + 1, v.size)").alias("w")).select("__k", "__th", "size", shingles("w").alias("wg"))
    printed = cut.select("__k", "__th", "size", "wg", simhash("wg").alias("wp"))

    near = F.filter(F.sequence(F.lit(0), F.lit((1 << BITS) - 1)), lambda x: F.bit_count(x) <= RADIUS // BLOCKS)
    blocks = lambda p: F.explode(F.array(*(F.struct(F.lit(k).alias("block"), _block(F.col(p), k).alias("key")) for k in range(BLOCKS))))
    one = items.select("item_id", "size", "ig", simhash("ig").alias("ip")).select("item_id", "size", "ig", blocks("ip").alias("b"))
    one = one.select("item_id", "size", "b.block", F.explode(F.transform(near, lambda x: x.bitwiseXOR(F.col("b.key")))).alias("key"))
    probes = printed.select("__k", "__th", "size", "wg", blocks("wp").alias("b")).select("__k", "__th", "size", "wg", "b.block", "b.key")
    pairs = probes.join(one, ["size", "block", "key"]).select("__k", "__th", "wg", "item_id").distinct()
    checked = pairs.join(items.select("item_id", "ig"), "item_id").withColumn("both", common("wg", "ig"))
    percent = 100 * F.col("both") / (F.size("wg") + F.size("ig") - F.col("both"))
    return checked.withColumn("percent", percent).where(F.col("percent") >= PERCENT).groupBy("__k", "__th", "item_id").agg(F.max("percent").alias("percent"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no item leaks."""
    found = Scratch(docs.sparkSession).keep(leaks(docs, benchmark).select("__k", "__th").distinct())
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")  # no column of docs can clash with the keys
    kept = without(_keyed(docs.select("doc_id", "text", row)), found)
    return kept.select(*(F.col("__row").getField(c).alias(c) for c in docs.columns))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, n_items, items, percent) of each row; items is the sorted list of leaked item ids."""
    found = leaks(docs, benchmark).groupBy("__k", "__th").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("percent").alias("percent"))
    rows = _keyed(docs.select("doc_id", "text")).select("doc_id", "__k", "__th").join(found, ["__k", "__th"], "left")
    items = F.coalesce("items", F.array().cast("array<bigint>"))
    return rows.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.size(items).cast("long").alias("n_items"), F.array_join(items.cast("array<string>"), ",").alias("items"), F.coalesce("percent", F.lit(0.0)).alias("percent"))
