"""Objects under several names: what happens to one under a name counts for the others, and for what is made of it.

A name stands for its place (path, class, method) and itself. ``y = x`` makes both names of one object; ``y = x.m(...)`` makes y of x,
so what was done to x counts for y and not the other way round. What a method does to a parameter counts, at the call, for the
argument. Names reach each other inside methods only, so links of a method are moved to one task, which follows them, and the closure
has as many rows as methods have pairs of linked names; methods of more than ``HELD`` links are followed in rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltide.operators import graph
from calltide.session import Scratch

PLACE = ["path", "class_name", "scope"]
_NAME = r"[A-Za-z_$][\w$]*"
#: Links of a place, at most, that a task holds.
HELD = 100_000
#: Rows that a task returns at once, in the mean.
_AT_ONCE = 20_000


def place(columns: tuple[str, str, str] = ("path", "class_name", "scope")) -> Column:
    """One name for a place: 128 bits, as joins move nothing but names."""
    return F.unhex(F.md5(F.concat_ws("\u0001", *columns)))


def links(assigned: DataFrame) -> DataFrame:
    """(place, source, target, both): from each name to one that it is another name of (then ``both`` ways), or that it is made of."""
    same = F.regexp_extract("value", rf"^(?:this\.)?({_NAME})$", 1)
    maker = F.regexp_extract("value", rf"^(?:this\.)?({_NAME})\.{_NAME}\s*\(", 1)
    rows = assigned.select(place().alias("place"), F.col("name").alias("source"), same.alias("same"), maker.alias("maker"))
    both = F.col("same") != ""
    rows = rows.select("place", "source", F.when(both, F.col("same")).otherwise(F.col("maker")).alias("target"), both.alias("both"))
    return rows.where("target <> '' and target <> source and not (both and target in ('null', 'true', 'false', 'this'))")


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, name, object) of links that come place by place."""
    now, edges, out = None, {}, ([], [], [])

    def close() -> None:
        for name in edges:
            met, todo = {name}, [name]
            while todo:
                fresh = edges.get(todo.pop(), set()) - met
                met |= fresh
                todo += fresh
            for c, v in zip(out, ([now] * len(met), [name] * len(met), met), strict=True):
                c.extend(v)

    made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.string(), pa.string()), strict=True)], names=["place", "name", "object"])
    for batch in batches:
        for there, source, target, both in zip(*(batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("place", "source", "target", "both")), strict=True):
            if there != now:
                close()
                now, edges = there, {}
                if len(out[0]) >= _AT_ONCE:
                    yield made()
                    out = ([], [], [])
            edges.setdefault(source, set()).add(target)
            if both:
                edges.setdefault(target, set()).add(source)
    close()
    if out[0]:
        yield made()


def closure(assigned: DataFrame) -> DataFrame:
    """(place, name, object): every name with a link, itself among the objects that count for it."""
    scratch = Scratch(assigned.sparkSession)
    every = links(assigned)
    large = scratch.keep(every.groupBy("place").agg(F.count("*").alias("n")).where(F.col("n") > HELD).select("place"))
    few = large.isEmpty()
    near = every if few else every.join(large, "place", "left_anti")
    found = near.repartition("place").sortWithinPartitions("place").mapInArrow(_followed, "place binary, name string, object string")
    if few:
        return found
    name = lambda c: F.struct("place", F.col(c).alias("name"))
    far = every.join(large, "place", "left_semi").select(name("source").alias("source"), name("target").alias("target"), "both")
    far = far.drop("both").unionByName(far.where("both").select(F.col("target").alias("source"), F.col("source").alias("target")))
    far = graph.reach(far, far.select(F.col("source").alias("root")), 1 << 20)  # ends when nothing new is reached
    return found.unionByName(far.select("root.place", "root.name", F.col("node.name").alias("object")))


def done_to(sites: DataFrame, assigned: DataFrame, methods: list[str], callers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(place, object, seq) of every call of one of ``methods`` on a name, by the method itself or by one that the name is handed to; and
    the closure. ``callers``: see ``provenance.passed_arguments``, with from_seq."""
    scratch = Scratch(sites.sparkSession)
    linked = scratch.keep(closure(assigned))
    own = F.regexp_extract("receiver", rf"^(?:this\.)?({_NAME})", 1)
    done = sites.where(F.col("method").isin(*methods)).select(place().alias("place"), own.alias("object"), "seq").where("object <> ''")
    known = fresh = scratch.keep(done.distinct())
    if callers is None:
        return known, linked
    handed = F.regexp_extract("argument", rf"^(?:this\.)?({_NAME})$", 1)
    given = callers.select(place().alias("of"), F.col("name").alias("param"), place(("from_path", "from_class", "from_scope")).alias("place"), handed.alias("object"), F.col("from_seq").alias("seq"))
    given = scratch.keep(given.where("object <> ''").distinct())
    while True:  # one round for each call that lies between
        names = fresh.select("place", "object").distinct()
        params = names.unionByName(linked.join(names, ["place", "object"]).select("place", F.col("name").alias("object"))).distinct()
        found = given.join(params.select(F.col("place").alias("of"), F.col("object").alias("param")), ["of", "param"]).select("place", "object", "seq").distinct()
        fresh = scratch.keep(found.join(known, ["place", "object", "seq"], "left_anti"))
        if fresh.isEmpty():
            return known, linked
        known = known.unionByName(fresh)


def done_before(sites: DataFrame, done: DataFrame, linked: DataFrame) -> DataFrame:
    """(site_id): sites before which, in their method, something was done to the object that they are called on, to one that it is
    another name of, or to one that it was made of."""
    own = F.regexp_extract("receiver", rf"^(?:this\.)?({_NAME})", 1)
    asked = sites.select("site_id", place().alias("place"), own.alias("name"), F.col("seq").alias("at")).where("name <> ''")
    objects = asked.withColumn("object", F.col("name")).unionByName(asked.join(linked, ["place", "name"]).select(*asked.columns, "object"))
    first = done.groupBy("place", "object").agg(F.min("seq").alias("since"))
    return objects.join(first, ["place", "object"]).where("since < at").select("site_id").distinct()
