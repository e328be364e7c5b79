"""Cascading lookups: the first table that knows a key gives the value and its provenance."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltide.session import Scratch

Level = tuple[DataFrame, dict[str, str], str, str]  # table, {row column: table column}, value column, provenance


def cascade(rows: DataFrame, levels: Sequence[Level], default: Column, into: str, provenance: str) -> DataFrame:
    """rows with ``into`` and ``provenance``: left joins in order, the first known value wins. A level's table must have
    one row per key at most (see ``merge.last_wins``)."""
    out = rows
    for k, (table, keys, value, _) in enumerate(levels):
        side = table.select(*(F.col(t).alias(f"_k{k}_{i}") for i, t in enumerate(keys.values())), F.col(value).alias(f"_v{k}"))
        on = [out[c] == side[f"_k{k}_{i}"] for i, c in enumerate(keys)]
        out = out.join(side, on, "left").drop(*(f"_k{k}_{i}" for i in range(len(keys))))
    values = [F.col(f"_v{k}") for k in range(len(levels))]
    told = F.coalesce(*(F.when(v.isNotNull(), F.lit(level[3])) for v, level in zip(values, levels, strict=True)), F.lit("fallback"))
    return out.withColumn(into, F.coalesce(*values, default)).withColumn(provenance, told).drop(*(f"_v{k}" for k in range(len(levels))))


#: Rows of a file, in the order in which a task meets them.
_VARIABLE, _IMPORT, _CLASS, _PACKAGE, _SITE = range(5)
_ASKED = ["path", "tag", "class_name", "scope", "name", "value", "order", "told"]


def _looked_up(batches: Iterator[pa.RecordBatch], columns: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The sites of ``in_files``: what the rows before them, of the same file, say of their names."""
    now, types, imports, classes, package = None, {}, {}, {}, ""
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        for path, tag, class_name, scope, name, value, order, told in zip(*(batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in _ASKED), strict=True):
            if path != now:
                now, types, imports, classes, package = path, {}, {}, {}, ""
            if tag == _SITE:
                if value is None:
                    for where, how in ((scope, "variable"), ("<fields>", "field")):
                        value = types.get((class_name, where, name), (0, None))[1]
                        if value is not None:
                            told = how
                            break
                    else:
                        value, told = name, "return-type" if "(" in name else None
                fqn = imports.get(value)
                looked = "import"
                if fqn is None:
                    fqn = classes.get(value)
                    looked = None if fqn is None else "file"
                for c, v in zip(out, (value, told, package, fqn, looked), strict=True):
                    c.append(v)
            elif path is None:
                continue  # what has no path meets nothing
            elif tag == _VARIABLE:
                known = types.get(key := (class_name, scope, name))
                if known is None or known[0] < order:
                    types[key] = (order, value)
            elif tag == _IMPORT:
                imports[name] = value
            elif tag == _CLASS:
                classes[name] = value
            else:
                package = value or ""
        if out[0]:
            sites = batch.filter(pa.array(batch.column("tag").to_numpy() == _SITE))
            yield pa.RecordBatch.from_arrays([*(sites.column(c) for c in columns), *(pa.array(c, pa.string()) for c in out)], names=[*columns, "short", "told", "package", "fqn", "looked"])


def in_files(sites: DataFrame, variables: DataFrame, imports: DataFrame, classes: DataFrame, packages: DataFrame) -> DataFrame:
    """sites (path, class_name, scope, name, value, told, ...) with ``short``, ``told``, ``package``, ``fqn`` and ``looked``. short is the value, else the
    type of the name among variables (path, class_name, scope, name, type, order: the last counts) of the scope or of the class's fields, else the name; fqn
    is that of imports, else of classes (path, short_name, fqn). All look-ups of a file are made in one task, to which its rows are moved once."""
    side = lambda rows, tag, name, value: rows.select("path", F.lit(tag).alias("tag"), F.col(name).alias("name"), F.col(value).alias("value"))
    named = variables.select("path", F.lit(_VARIABLE).alias("tag"), "class_name", "scope", "name", F.col("type").alias("value"), "order")
    every = sites.withColumn("tag", F.lit(_SITE)).withColumn("order", F.lit(0))
    for rows in (named, side(imports, _IMPORT, "short_name", "fqn"), side(classes, _CLASS, "short_name", "fqn"), side(packages, _PACKAGE, "path", "package")):
        every = every.unionByName(rows, allowMissingColumns=True)
    every = every.withColumn("order", F.coalesce("order", F.lit(0)))
    columns = [c for c in sites.columns if c not in ("name", "value", "told")]
    types = dict(every.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in columns), "short string, told string, package string, fqn string, looked string"])
    return every.repartition("path").sortWithinPartitions("path", "tag").mapInArrow(lambda batches: _looked_up(batches, columns), schema)


def linearised(supers: DataFrame) -> DataFrame:
    """(name, ancestor, rank): the class itself first, then its superclass chain and interfaces, nearest and declared first.

    ``supers`` has (name, super, ord); cycles end at the class itself. Each round joins the new frontier only, and there are as
    many rounds as the deepest hierarchy has levels.
    """
    scratch = Scratch(supers.sparkSession)
    supers = scratch.keep(supers.select("name", "super", "ord"))  # made once for all rounds
    names = supers.select("name").union(supers.select("super")).distinct()
    frontier = scratch.keep(names.select("name", F.col("name").alias("ancestor"), F.array().cast("array<int>").alias("way")))
    known = frontier
    while True:  # ends when no class has a new ancestor: a class has as many as there are classes at most
        step = supers.select(F.col("name").alias("ancestor"), "super", "ord")
        frontier = frontier.join(step, "ancestor").select("name", F.col("super").alias("ancestor"), F.concat("way", F.array(F.col("ord").cast("int"))).alias("way"))
        frontier = frontier.join(known.select("name", "ancestor"), ["name", "ancestor"], "left_anti").groupBy("name", "ancestor").agg(F.min("way").alias("way"))
        frontier = scratch.keep(frontier)
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known.select("name", "ancestor", F.struct(F.size("way").alias("distance"), "way").alias("rank"))


def inherited(rows: DataFrame, closure: DataFrame, members: DataFrame, name: str, member: str) -> DataFrame:
    """(name, member, owner) of each row: the nearest class of the closure that has the member; rows without one are left
    out. ``members`` has (owner, member)."""
    asked = rows.select(name, member).distinct()
    found = asked.join(closure.withColumnRenamed("name", name), name).join(members.select(F.col("owner").alias("ancestor"), F.col("member").alias(member)).distinct(), ["ancestor", member])
    return found.groupBy(name, member).agg(F.min_by("ancestor", F.struct("rank", "ancestor")).alias("owner"))
