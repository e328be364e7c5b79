"""Where the arguments of a call come from: literals, outside input, parameters, constants, fields, results of calls.

Terms are texts in a place (path, class, method). Every operand of an argument, of a value that a name is given, and of an
argument that a known caller passes is a term, once, however often it stands there; it is settled (a literal, a parameter,
a constant, ...) or made of other terms: a name of its value's operands, a pass-through call of its receiver or arguments, a
parameter of what its callers pass. The sources of an argument are the settled terms that its operands reach. They are found
for all operands at once, in rounds that join only what the last one has found new, so names that are used twice, or in
circles, cost one row each. A name that is made of nothing but itself stays a variable. With callers, sources
are handed up from term to term. Without, no search leaves its place: what terms of a place are made of is moved to one task,
searched there, and only the sources that are found are settled; places of more than ``HELD`` terms are searched in rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltide.functions import literals
from calltide.session import Scratch

# Methods whose result is made of their receiver or arguments only.
PASS_RECEIVER = [
    "get", "iterator", "stream", "toArray", "split", "getBytes", "toString", "trim", "substring", "toLowerCase", "toUpperCase", "replace", "replaceAll",
]
PASS_ARGUMENTS = [
    "asList", "singletonList", "unmodifiableList", "unmodifiableSet", "unmodifiableMap", "emptyList", "emptySet", "emptyMap", "of", "valueOf",
]

_PLACE = ["path", "class_name", "scope"]
#: Terms of a place that are made of others, at most, that a task holds.
HELD = 100_000
#: Rows of a place, in the order in which a task meets them.
_PARAM, _CONSTANT, _GIVEN, _THROUGH, _ROOT = range(5)
#: Rows that a task returns at once, in the mean.
_AT_ONCE = 20_000


def _place() -> Column:
    """One name for a place, of which a term's name is made, too."""
    return F.unhex(F.md5(F.concat_ws("\u0001", *_PLACE)))


def _named(text: Column) -> Column:
    """One name for a term: 128 bits, as a round of the search moves nothing but names."""
    return F.unhex(F.md5(F.concat_ws("\u0001", *_PLACE, text)))


def _terms(
    roots: DataFrame, params: DataFrame, variables: DataFrame, constants: DataFrame, callers: DataFrame | None, handlers: DataFrame, scratch: Scratch
) -> tuple[DataFrame, DataFrame]:
    """(term, text, kind, several, value) of every term, value being what a literal or constant says, and the edges (term, next) of those that are made of others."""
    given = variables.where("value is not null and value <> ''").select(*_PLACE, _named(F.col("name")).alias("term"), literals.operands(F.col("value")).alias("made"))
    given = scratch.keep(given)
    parts = given.select(*_PLACE, F.explode(F.array_distinct("made")).alias("text"))
    seeds = roots.select(*_PLACE, "text", F.col("root").alias("term")).unionByName(parts.withColumn("term", _named(F.col("text"))))
    known = params.select(*_PLACE, F.col("name")).join(handlers.hint("merge"), _PLACE, "left").distinct()
    known = known.select(_named(F.col("name")).alias("term"), F.lit(True).alias("is_param"), "is_handler")
    passed = None
    if callers is not None:
        passed = scratch.keep(
            callers.select(
                _named(F.col("name")).alias("term"), F.col("from_path").alias("path"), F.col("from_class").alias("class_name"),
                F.col("from_scope").alias("scope"), F.explode(literals.operands(F.col("argument"))).alias("text"),
            ).distinct()
        )
        seeds = seeds.unionByName(passed.select(*_PLACE, "text").withColumn("term", _named(F.col("text"))))
        called = passed.select("term").distinct().withColumn("is_called", F.lit(True)).hint("merge")
    (own, any_), fields = _constants(constants), _fields(variables)
    # Made once; texts that are put together look small to Spark before they are made, so no side is left to be broadcast.
    known, own, any_, fields = (scratch.keep(side).hint("merge") for side in (known, own, any_, fields))
    made = given.select("term", "made").hint("merge")
    frontier, tables, seen = scratch.keep(seeds.distinct()), [], None
    while True:
        # Many terms have one text: constants are asked for by different texts, and what is found is written, so that Spark knows its size.
        named = scratch.keep(frontier.select("text").distinct().join(any_, "text"))
        # Three joins by the term, which is moved once for them.
        rows = frontier.join(known, "term", "left").join(made, "term", "left")
        rows = rows.join(called, "term", "left") if passed is not None else rows.withColumn("is_called", F.lit(None).cast("boolean"))
        rows = rows.join(own, ["class_name", "text"], "left").join(named, "text", "left")
        call = literals.call_name(F.col("text"))
        is_made = F.col("made").isNotNull() & F.col("is_param").isNull()
        through = _through(F.col("text"), F.col("call"))
        rows = rows.withColumn("call", F.when(F.col("text").endswith(")"), call).otherwise("")).withColumn("literal", literals.is_literal(F.col("text")))
        rows = rows.withColumn("through", F.when(~is_made & (F.col("call") != ""), through)).withColumn("more", F.when(is_made, F.col("made")).otherwise(F.col("through")))
        kind = (
            F.when(F.col("literal"), "hardcoded")
            .when(F.col("is_param") & F.col("is_handler"), "external_input")
            .when(F.col("is_param") & F.col("is_called"), "open")
            .when(F.col("is_param"), "tainted")
            .when(F.col("own_constant") | F.col("constant"), "hardcoded")
            .when(F.size("more") > 0, "open")
            .when(F.col("call") != "", "method_return")
            .when(F.col("text").contains("."), "field")
            .when(literals.identifier(F.col("text")), "variable")
            .otherwise("unknown")
        )
        value = F.when(F.col("literal"), literals.unquoted(F.col("text"))).when(F.col("is_param").isNull(), F.coalesce("own_value", "any_value"))
        several = (F.size("more") > 1) & F.col("is_param").isNull()
        rows = rows.select(*_PLACE, "term", "text", kind.alias("kind"), F.coalesce(several, F.lit(False)).alias("several"), value.alias("value"), "more", F.col("through").isNotNull().alias("passes"))
        tables.append(scratch.keep(rows))
        seen = tables[-1].select("term") if seen is None else seen.unionByName(tables[-1].select("term"))
        opened = tables[-1].where("kind = 'open' and passes").select(*_PLACE, F.explode("more").alias("text")).distinct()  # parts of values were there from the start
        frontier = scratch.keep(opened.withColumn("term", _named(F.col("text"))).join(seen.hint("merge"), "term", "left_anti"))
        if frontier.isEmpty():
            break
    every = reduce(DataFrame.unionByName, tables)
    edges = every.where("kind = 'open' and more is not null").select(*_PLACE, "term", F.explode("more").alias("text"))
    edges = edges.select("term", _named(F.col("text")).alias("next"))
    if passed is not None:
        up = passed.select("term", _named(F.col("text")).alias("next"))
        edges = edges.unionByName(up.join(every.where("kind = 'open'").select("term"), "term", "left_semi"))
    edges = edges.where("term <> next").distinct()
    maybe = F.col("kind").isin("variable", "unknown")
    met = every.where(maybe).join(fields, ["path", "class_name", "text"], "left").withColumn("kind", F.when(F.col("is_field"), "field").otherwise(F.col("kind")))
    told = ["term", "text", "kind", "several", "value"]
    return scratch.keep(every.where(~maybe).select(told).unionByName(met.select(told))), scratch.keep(edges)


def _through(text: Column, call: Column) -> Column:
    """What the result of a pass-through call is made of; null for other texts."""
    inner = F.regexp_extract(text, r"\w+\s*\(([^()]*)\)$", 1)
    receiver = F.regexp_extract(text, r"^(.*)\.\w+\s*\([^()]*\)$", 1)
    return F.when(call.isin(*PASS_ARGUMENTS), literals.arguments(inner)).when(call.isin(*PASS_RECEIVER) & (receiver != ""), F.array(receiver))


def _constants(constants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class_name, text, own_constant, own_value) of constants by their class, and (text, constant, any_value) by their whole name."""
    own = constants.select("class_name", F.col("field_name").alias("text"), F.lit(True).alias("own_constant"), F.col("value").alias("own_value")).distinct()
    full = F.when(F.col("class_name") == "", F.col("field_name")).otherwise(F.concat_ws(".", "class_name", "field_name"))
    return own, constants.select(full.alias("text"), F.lit(True).alias("constant"), F.col("value").alias("any_value")).distinct()


def _fields(variables: DataFrame) -> DataFrame:
    return variables.where("scope = '<fields>'").select("path", "class_name", F.col("name").alias("text"), F.lit(True).alias("is_field")).distinct()


class _Held:
    """The terms of one place: parameters, constants, what names are given and what calls pass through."""

    def __init__(self, place: bytes):
        self.place, self.params, self.fixed = place, set(), set()
        self.given: dict[str, list[list[str]]] = {}
        self.through: dict[str, list[list[str]]] = {}
        self.steps: dict[str, tuple[bool, bool, set[str]]] = {}

    def add(self, tag: int, text: str, more: list[str], literal: bool) -> None:
        if tag == _PARAM:
            self.params.add(text)
            return
        if tag == _CONSTANT or literal:
            self.fixed.add(text)
        if tag != _CONSTANT:
            (self.given if tag == _GIVEN else self.through).setdefault(text, []).append(more)

    def step(self, text: str) -> tuple[bool, bool, set[str]]:
        """Whether the term is settled, whether it is made of several others, and of which it is made."""
        if (known := self.steps.get(text)) is None:
            rows = [] if text in self.params else self.given.get(text) or self.through.get(text) or []
            nexts = set() if text in self.fixed else set().union(*rows)
            known = self.steps[text] = (not rows or text in self.fixed or not all(rows), any(len(r) > 1 for r in rows), nexts)
        return known

    def sources(self, root: str) -> tuple[list[str | None], bool]:
        """The settled terms that the root reaches, and whether one on the way is made of several."""
        met, todo, found, several = {root}, [root], [], False
        while todo:
            settled, many, nexts = self.step(text := todo.pop())
            several = several or many
            if settled:
                found.append(text)
            fresh = nexts - met
            met |= fresh
            todo += fresh
        return found or [None], several


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, own, text, several): the sources of the roots of each place, whose rows come one after the other."""
    held, out = _Held(b""), ([], [], [], [])
    made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.string(), pa.string(), pa.bool_()), strict=True)], names=["place", "own", "text", "several"])
    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("place", "tag", "text", "literal")]
        more, at = batch.column("more").flatten().to_numpy(zero_copy_only=False).tolist(), 0
        sizes = batch.column("more").value_lengths().to_numpy(zero_copy_only=False).tolist()
        for place, tag, text, literal, size in zip(*columns, sizes, strict=True):
            if place != held.place:
                held = _Held(place)
            if tag != _ROOT:
                held.add(tag, text, more[at : at + size], literal)
                at += size
                continue
            found, several = held.sources(text)
            for c, v in zip(out, ([place] * len(found), [text] * len(found), found, [several] * len(found)), strict=True):
                c.extend(v)
            if len(out[0]) >= _AT_ONCE:
                yield made()
                out = ([], [], [], [])
    if out[0]:
        yield made()


def _makers(opened: DataFrame, variables: DataFrame, scratch: Scratch) -> DataFrame:
    """(place, class_name, tag, text, more, literal): every name with what it is given, every pass-through call with what it passes."""
    literal = literals.is_literal(F.col("text")).alias("literal")
    given = variables.where("value is not null and value <> ''").select(*_PLACE, F.col("name").alias("text"), literals.operands(F.col("value")).alias("more"))
    given = scratch.keep(given.select(*_PLACE, _place().alias("place"), F.lit(_GIVEN).alias("tag"), "text", "more", literal))
    call = lambda rows: rows.where(F.col("text").endswith(")")).distinct().withColumn("more", _through(F.col("text"), literals.call_name(F.col("text")))).where("more is not null")
    fresh = seen = scratch.keep(call(opened.select(*_PLACE, "text").unionByName(given.select(*_PLACE, F.explode(F.filter("more", lambda t: t.endswith(")"))).alias("text")))))
    while not fresh.isEmpty():  # a round for each call inside a call
        inner = call(fresh.select(*_PLACE, F.explode("more").alias("text"))).withColumn("place", _place())
        fresh = scratch.keep(inner.join(seen.select(_place().alias("place"), "text").hint("merge"), ["place", "text"], "left_anti").drop("place"))
        seen = seen.unionByName(fresh)
    through = seen.select(_place().alias("place"), "class_name", F.lit(_THROUGH).alias("tag"), "text", "more", literal)
    return given.drop("path", "scope").unionByName(through)


def _within(opened: DataFrame, makers: DataFrame, params: DataFrame, variables: DataFrame, constants: DataFrame, handlers: DataFrame, scratch: Scratch) -> DataFrame:
    """(site_id, pos, kind, text, several, value) of each source of each root, searched place by place."""
    own, any_ = _constants(constants)
    # Many terms have one text: constants are asked for by different texts, and what is found is written, so that Spark knows its size.
    texts = scratch.keep(makers.select("text").distinct())
    whole = scratch.keep(texts.join(any_.select("text").hint("merge"), "text", "left_semi"))
    owned = scratch.keep(own.select("class_name", "text").hint("merge").join(texts, "text", "left_semi").distinct())
    fixed = makers.join(whole, "text", "left_semi").select("place", "text").unionByName(makers.join(owned, ["class_name", "text"], "left_semi").select("place", "text"))
    known = params.select(*_PLACE, F.col("name").alias("text")).join(handlers.hint("merge"), _PLACE, "left").distinct()
    known = scratch.keep(known.select(_place().alias("place"), "text", F.lit(True).alias("is_param"), "is_handler").distinct())
    bare = lambda rows, tag: rows.select("place", F.lit(tag).alias("tag"), "text", F.array().cast("array<string>").alias("more"), F.lit(False).alias("literal"))
    every = makers.drop("class_name").unionByName(bare(known, _PARAM)).unionByName(bare(fixed, _CONSTANT)).unionByName(bare(opened.select("place", "text").distinct(), _ROOT))
    found = every.repartition("place").sortWithinPartitions("place", "tag").mapInArrow(_searched, "place binary, own string, text string, several boolean")
    rows = opened.withColumnRenamed("text", "own").join(found.hint("merge"), ["place", "own"])
    rows = scratch.keep(rows.select("site_id", "pos", "path", "class_name", "place", "own", "text", (F.col("beside") | F.col("several")).alias("several")))
    named = scratch.keep(rows.select("text").distinct().join(any_.hint("merge"), "text"))
    rows = rows.join(known.hint("merge"), ["place", "text"], "left").join(own.hint("merge"), ["class_name", "text"], "left").join(named, "text", "left")
    literal, text = literals.is_literal(F.col("text")), F.col("text")
    kind = (
        F.when(literal, "hardcoded")
        .when(F.col("is_param") & F.col("is_handler"), "external_input")
        .when(F.col("is_param"), "tainted")
        .when(F.col("own_constant") | F.col("constant"), "hardcoded")
        .when(text.endswith(")") & (literals.call_name(text) != ""), "method_return")
        .when(text.contains("."), "field")
        .when(literals.identifier(text) | text.isNull(), "variable")
        .otherwise("unknown")
    )
    value = F.when(literal, literals.unquoted(text)).when(F.col("is_param").isNull(), F.coalesce("own_value", "any_value"))
    rows = scratch.keep(rows.select("site_id", "pos", "path", "class_name", kind.alias("kind"), "text", "own", "several", value.alias("value")))
    maybe = F.col("kind").isin("variable", "unknown") & F.col("text").isNotNull()
    met = rows.where(maybe).join(_fields(variables).hint("merge"), ["path", "class_name", "text"], "left").withColumn("kind", F.when(F.col("is_field"), "field").otherwise(F.col("kind")))
    rows = rows.where(~maybe).unionByName(met.select(*rows.columns))
    return rows.select("site_id", "pos", "kind", F.coalesce("text", "own").alias("text"), "several", "value")


def _reached(asked: DataFrame, terms: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(root, text, kind, several, value) of each term that a root reaches. Inside a method there are as many as it has pairs of terms."""
    frontier = met = scratch.keep(asked.withColumn("term", F.col("root")))
    while True:
        moved = frontier.join(edges.hint("merge"), "term").select("root", F.col("next").alias("term")).distinct()
        frontier = scratch.keep(moved.join(met.hint("merge"), ["root", "term"], "left_anti"))
        if frontier.isEmpty():
            return met.join(terms.hint("merge"), "term").select("root", "text", "kind", "several", "value")
        met = met.unionByName(frontier)


def _handed_up(asked: DataFrame, terms: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """The same with one row for equal sources, in whatever terms they stand. Across calls many roots reach the same terms, so pairs of both
    grow with the depth of the calls; sources are handed up instead, from what is passed to the parameter, each once to a term."""
    frontier = reached = scratch.keep(asked.select(F.col("root").alias("term")))
    while True:  # only what roots reach is looked at, each term once
        moved = frontier.join(edges.hint("merge"), "term").select(F.col("next").alias("term")).distinct()
        frontier = scratch.keep(moved.join(reached.hint("merge"), "term", "left_anti"))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    several = F.unhex(F.md5(F.lit("several")))
    rows = terms.join(reached.hint("merge"), "term", "left_semi")
    rows = rows.withColumn("source", F.when(F.col("kind") != "open", F.unhex(F.md5(F.to_json(F.struct("text", "kind", "value"))))))
    rows = scratch.keep(rows)
    sources = scratch.keep(rows.where("source is not null").select("source", "text", "kind", "value").distinct())  # its size is known, so a few that all share are broadcast
    held = rows.where("source is not null").select("term", "source").unionByName(rows.where("several").select("term", several.alias("source")))
    frontier = held = scratch.keep(held.distinct())
    edges = scratch.keep(edges.join(reached.hint("merge"), "term", "left_semi"))
    while True:  # what a round moves is written, so that later rounds, in which it is little, shuffle neither the edges nor what is held
        moved = scratch.keep(frontier.select(F.col("term").alias("next"), "source").join(edges, "next").select("term", "source").distinct())
        old = held.join(moved, ["term", "source"], "left_semi")
        frontier = scratch.keep(moved.join(old, ["term", "source"], "left_anti"))
        if frontier.isEmpty():
            break
        held = held.unionByName(frontier)
    found = held.withColumnRenamed("term", "root").join(asked.hint("merge"), "root", "left_semi").join(sources, "source", "left")
    found = found.select("root", "text", F.coalesce("kind", F.lit("open")).alias("kind"), (F.col("source") == several).alias("several"), "value")
    return found.unionByName(asked.select("root", F.lit(None).cast("string").alias("text"), F.lit("open").alias("kind"), F.lit(False).alias("several"), F.lit(None).cast("string").alias("value")))


def argument_parts(sites: DataFrame, params: DataFrame, variables: DataFrame, constants: DataFrame, callers: DataFrame | None = None) -> DataFrame:
    """(site_id, pos, kind, text, several, value) for each source of each argument of sites (site_id, path, class_name, scope, is_handler,
    arguments); ``several`` tells that it stands, or stood on its way, beside others; value is what literals and constants say. ``params`` has (path, class_name, scope, name),
    ``variables`` also value, ``constants`` (class_name, field_name, value). With ``callers`` (path, class_name, scope, name, from_path,
    from_class, from_scope, from_handler, argument: see ``passed_arguments``) parameters are followed into callers."""
    scratch = Scratch(sites.sparkSession)
    handlers = sites.select(*_PLACE, "is_handler")
    if callers is not None:
        handlers = handlers.unionByName(callers.select(F.col("from_path").alias("path"), F.col("from_class").alias("class_name"), F.col("from_scope").alias("scope"), F.col("from_handler").alias("is_handler")))
    handlers = handlers.where("is_handler").distinct()
    opened = sites.select("site_id", *_PLACE, F.posexplode(literals.arguments(F.col("arguments"))).alias("pos", "arg"))
    opened = opened.select("site_id", *_PLACE, "pos", literals.operands(F.col("arg")).alias("each"))
    opened = opened.select("site_id", *_PLACE, "pos", F.explode(F.array_distinct("each")).alias("text"), (F.size("each") > 1).alias("beside"))
    opened = scratch.keep(opened.withColumn("place", _place()))
    if callers is not None:
        out = _across(opened, params, variables, constants, callers, handlers, scratch)
    else:
        makers = _makers(opened, variables, scratch)
        large = scratch.keep(makers.groupBy("place").agg(F.count("*").alias("n")).where(F.col("n") > HELD).select("place"))
        if large.isEmpty():
            out = _within(opened, makers, params, variables, constants, handlers, scratch)
        else:
            rest = scratch.keep(opened.join(large, "place", "left_anti"))
            out = _within(rest, makers.join(large, "place", "left_anti"), params, variables, constants, handlers, scratch)
            most, there = scratch.keep(opened.join(large, "place", "left_semi")), variables.withColumn("place", _place())
            there = there.join(large, "place", "left_semi").unionByName(there.where("scope = '<fields>'").join(large, "place", "left_anti").withColumn("value", F.lit("")))
            out = out.unionByName(_across(most, params, there.drop("place"), constants, None, handlers, scratch))
    out = out.repartition("site_id")  # parts of a site meet here, and stay for ``flags``
    return out.groupBy("site_id", "pos", "kind", "text").agg(F.bool_or("several").alias("several"), F.min("value").alias("value"))


def _across(
    opened: DataFrame, params: DataFrame, variables: DataFrame, constants: DataFrame, callers: DataFrame | None, handlers: DataFrame, scratch: Scratch
) -> DataFrame:
    """The same as ``_within``, searched in rounds of joins, also through callers."""
    opened = opened.withColumn("root", _named(F.col("text")))
    terms, edges = _terms(opened, params, variables, constants, callers, handlers, scratch)
    roots = scratch.keep(opened.select("site_id", "pos", "root", F.col("text").alias("own"), "beside").join(terms.withColumnRenamed("term", "root").hint("merge"), "root"))
    # Settled terms are their own only source; what is made of others is searched for them.
    asked = scratch.keep(roots.where("kind = 'open'").select("root").distinct())
    told = scratch.keep(_reached(asked, terms, edges, scratch) if callers is None else _handed_up(asked, terms, edges, scratch))
    beside = told.groupBy("root").agg(F.bool_or("several").alias("several"))
    found = told.where("kind <> 'open'").groupBy("root", "text", "kind").agg(F.min("value").alias("value"))
    found = beside.join(found.hint("merge"), "root", "left")
    out = roots.where("kind = 'open'").select("site_id", "pos", "root", "own", "beside").join(found.hint("merge"), "root")
    out = roots.where("kind <> 'open'").select(*out.columns).unionByName(out)
    kind, text = F.coalesce("kind", F.lit("variable")).alias("kind"), F.coalesce("text", "own").alias("text")
    return out.select("site_id", "pos", kind, text, (F.col("beside") | F.col("several")).alias("several"), "value")


def passed_arguments(sites: DataFrame, methods: DataFrame) -> DataFrame:
    """Which argument each parameter of a method is given at which known call: (path, class_name, scope, name, from_path, from_class,
    from_scope, from_handler, from_seq, argument). sites have (type, called, args, path, class_name, scope, is_handler, seq), methods
    (type, path, class_name, method_name, params); a call meets the methods of its name and type that take as many arguments."""
    given = sites.select(
        "type", "called", F.col("path").alias("from_path"), F.col("class_name").alias("from_class"), F.col("scope").alias("from_scope"),
        F.col("is_handler").alias("from_handler"), F.col("seq").alias("from_seq"), literals.arguments(F.col("args")).alias("given"),
    ).withColumn("n", F.size("given")).where("n > 0")
    taken = methods.select("type", F.col("method_name").alias("called"), *_PLACE[:2], F.col("method_name").alias("scope"), "params", F.size("params").alias("n"))
    met = given.join(taken, ["type", "called", "n"])
    pairs = met.select(*_PLACE, "from_path", "from_class", "from_scope", "from_handler", "from_seq", F.explode(F.arrays_zip("params", "given")).alias("z"))
    return pairs.select(*_PLACE, F.col("z.params.name").alias("name"), "from_path", "from_class", "from_scope", "from_handler", "from_seq", F.col("z.given").alias("argument"))


def flags(parts: DataFrame) -> DataFrame:
    """(site_id, parts, ext, tainted, hard_any, hard_all, kinds, composite, names, settled) of each site; settled is the text of the
    first argument where one literal or constant is its only source."""
    kind = F.col("kind")
    out = parts.groupBy("site_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "kind", "text"))).alias("parts"),
        F.bool_or(kind == "external_input").alias("ext"),
        F.bool_or(kind == "tainted").alias("tainted"),
        F.bool_or(kind == "hardcoded").alias("hard_any"),
        F.bool_and(kind == "hardcoded").alias("hard_all"),
        F.size(F.collect_set("kind")).cast("long").alias("kinds"),
        F.bool_or("several").alias("_several"),
        F.count_if(F.col("pos") == 0).alias("_first"),
        F.max(F.when((F.col("pos") == 0) & (kind == "hardcoded") & ~F.col("several"), F.col("value"))).alias("_value"),
        F.array_join(F.array_sort(F.collect_set(F.when(kind.isin("external_input", "tainted"), F.col("text")))), ", ").alias("names"),
    )
    first = F.element_at("parts", 1)["kind"]
    return out.withColumn("composite", F.when((F.size("parts") > 1) | F.col("_several"), "concat").when(first.isin("method_return", "field", "unknown"), first).otherwise("direct")).withColumn("settled", F.when(F.col("_first") == 1, F.col("_value"))).drop("_several", "_first", "_value")


def receiver_flags(parts: DataFrame) -> DataFrame:
    """(site_id, ext, tainted, hardcoded) of a receiver's parts: it is hard-coded only if every part is."""
    kind = F.col("kind")
    return parts.groupBy("site_id").agg(F.bool_or(kind == "external_input").alias("ext"), F.bool_or(kind == "tainted").alias("tainted"), F.bool_and(kind == "hardcoded").alias("hardcoded"))
