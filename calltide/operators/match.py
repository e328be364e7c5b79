"""Glob rules over signatures: pattern to regex, and a join that meets most patterns by an equal method name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules without a literal method name that are tested inside a site's row.
LOOSE = 500


def glob_regex(glob: Column) -> Column:
    """``*`` stands for any characters but parentheses; everything else, ``?`` included, for itself; the whole must match."""
    quoted = F.regexp_replace(glob, r"([.+^${}()|?\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit("[^()]*")), F.lit("$"))


def glob_method(glob: Column) -> Column:
    """Literal method name of a glob; null if it has a ``*`` there or no parentheses."""
    return F.nullif(F.regexp_extract(glob, r"^(?:.*\.)?([^.()*]+)\([^()]*\)$", 1), F.lit(""))


def match_rules(sites: DataFrame, patterns: DataFrame, signature: str = "signature", method: str = "method") -> DataFrame:
    """Each row of sites once for every rule of which a pattern (rule_id, glob) matches its signature.

    A rule whose patterns all have a literal method name joins on that name, with one regex for each (rule, name); any other
    rule meets every site with one regex of all its patterns: as part of the site's own row while there are ``LOOSE`` such rules
    at most, beyond that in a join. So a site meets a rule once at most, and nothing is shuffled to take out copies.
    """
    listed = patterns.select("rule_id", glob_regex(F.col("glob")).alias("rx"), glob_method(F.col("glob")).alias("name"))
    loose_rules = listed.groupBy("rule_id").agg(F.bool_or(F.col("name").isNull()).alias("loose"))
    either = lambda: F.array_join(F.array_sort(F.collect_set("rx")), "|").alias("rx")
    told = listed.join(loose_rules, "rule_id")
    by_name = told.where(~F.col("loose")).groupBy("rule_id", "name").agg(either())
    by_regex = told.where("loose").groupBy("rule_id").agg(either())
    hit = F.rlike(F.col(signature), F.col("rx"))
    named = sites.join(by_name, sites[method] == F.col("name")).where(hit)
    columns = [*sites.columns, "rule_id"]
    few = by_regex.limit(LOOSE + 1).collect()
    if len(few) <= LOOSE:
        tests = [F.when(F.col(signature).rlike(r.rx), F.lit(r.rule_id)) for r in few]
        met = F.filter(F.array(*tests), lambda x: x.isNotNull()) if few else F.array().cast("array<string>")
        loose = sites.withColumn("rule_id", F.explode(met))
    else:
        loose = sites.join(by_regex, hit)
    return named.select(*columns).unionByName(loose.select(*columns))
