"""What grows with the tables: plans whose sides are larger than Spark can know when it plans."""

import cProfile
import random

from pyspark.sql import functions as F

from calltide.functions import literals
from calltide.operators import graph, lookup, objects, provenance
from calltide.operators.rules import Rule
from calltide.plans import analyze, shape_queries, source_queries
from calltide.session import Scratch
from calltide.sources import java, javascan, maven


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_source_line_broadcasts_no_texts(spark):
    ids = spark.range(40)
    files = ids.select(F.concat(F.lit("f"), "id").alias("path"), F.concat(F.lit("first "), F.col("id"), F.lit("\r\nsecond\n")).alias("text"))
    rows = ids.select(F.concat(F.lit("f"), "id").alias("path"), (F.col("id") % 5).cast("int").alias("line"))
    found = java.source_line(rows, files)
    assert "Broadcast" not in _plan(found)
    texts = {(r.path, r.line): r.source_line for r in found.collect()}
    assert len(texts) == 40 and texts["f6", 1] == "first 6" and texts["f7", 2] == "second"
    assert {texts["f5", 0], texts["f8", 3], texts["f9", 4]} == {""}


def _split(text: str, mark: str, brackets: bool) -> list[str]:
    """Parts between marks outside quotes (and brackets), letter by letter."""
    depth, quote, parts, part = 0, "", [], ""
    for c in text:
        if not quote and c == mark and not depth:
            parts, part = [*parts, part], ""
            continue
        part += c
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif brackets:
            depth += (c in "(<[{") - (c in ")>]}")
    return [p for p in (x.strip() for x in [*parts, part]) if p]


def test_arguments_and_operands_as_letter_by_letter(spark):
    draw = random.Random(5)
    texts = ["".join(draw.choice("ab ,+\"'()<>[]{}") for _ in range(draw.randint(0, 30))) for _ in range(3000)] + ['"a+b" + ' * 20000, "f(x), " * 2000]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    for r in rows.select("t", literals.arguments(F.col("t")).alias("a"), literals.operands(F.col("t")).alias("o")).collect():
        assert r.a == (None if r.t is None else _split(r.t, ",", True)) and r.o == (None if r.t is None else _split(r.t, "+", False))


def test_operands_walk_no_letters(spark):
    assert "aggregate" not in _plan(spark.range(1).select(literals.operands(F.col("id").cast("string"))))


def _scans(df) -> int:
    """How often a plan reads Java files."""
    return sum(line.lstrip(" :+-*()0123456789").startswith("MapInArrow") for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n"))


def test_variables_and_imports_scan_once(spark):
    text = "package p;\nimport a.B;\nclass C { int n; void f(int n, String s) { n = 1; x = new T(1); x = new U(2); final B b = new D(); b = new E(); } }"
    files = spark.createDataFrame([("f", text)], "path string, text string")
    found = java.variables(java.facts(files, ["variable", "assignment", "method"]))
    assert _scans(found) == 1
    rows = {(r.scope, r.name): (r.type, r.value) for r in found.collect()}
    assert rows == {("<fields>", "n"): ("int", ""), ("f", "n"): ("int", ""), ("f", "s"): ("String", ""), ("f", "x"): ("T", "new T(1)"), ("f", "b"): ("D", "new D()")}
    assert {r.kind for r in java.facts(files, ["import"]).collect()} == {"import"}


def test_imports_query_scans_once(spark, tmp_path):
    spark.range(3).selectExpr("id AS p_partkey", "'red ring' AS p_name", "'b' AS p_brand", "'SMALL' AS p_type", "5 AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    found = source_queries.java_imports(spark, str(tmp_path))
    assert _scans(found) == 0 and found.count() == 6  # the facts were read once, and written


def test_arguments_of_many_sites_are_not_broadcast(spark):
    sites = spark.createDataFrame([("s", "f", "C", "m", False, "a")], "site_id string, path string, class_name string, scope string, is_handler boolean, arguments string")
    params = spark.createDataFrame([("f", "C", "m", "id")], "path string, class_name string, scope string, name string")
    made = spark.createDataFrame([("f", "C", "m", "a", "b + b"), ("f", "C", "m", "b", 'id + "x"')], "path string, class_name string, scope string, name string, value string")
    constants = spark.createDataFrame([("D", "NAME", "v")], "class_name string, field_name string, value string")
    found = provenance.argument_parts(sites, params, made, constants)
    assert "Broadcast" not in _plan(found)
    assert {(r.kind, r.text, r.several) for r in found.collect()} == {("tainted", "id", True), ("hardcoded", '"x"', True)}


def test_look_up_tables_of_resolve_are_written(spark):
    files = spark.createDataFrame([(f"f{k}", f"package p; class C{k} {{ void m() {{ F f = F.make(); f.go(); }} }}") for k in range(3)], "path string, text string")
    found = analyze.resolve(analyze.scan(files))
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.signature for r in found.collect()) == ["F.go()"] * 3 + ["F.make()"] * 3


def test_hierarchies_and_poms_are_made_once(spark):
    supers = spark.range(1, 4).select(F.concat(F.lit("C"), "id").alias("name"), F.explode(F.array(F.concat(F.lit("C"), F.col("id") - 1))).alias("super"), F.lit(0).alias("ord"))
    order = lookup.linearised(supers)
    assert "Existing" not in _plan(order) and "Generate" not in _plan(order)
    assert order.where("name = 'C3'").count() == 4
    xml = "<dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version></dependency>"
    poms = spark.createDataFrame([("a", xml), ("b", "")], "path string, xml string")
    found = maven.with_parents(maven.dependencies(poms), spark.createDataFrame([("b", "a")], "path string, parent string"))
    assert "regexp" not in _plan(found)
    assert {(r.path, r.depth) for r in found.collect()} == {("a", 0), ("b", 1)}


def test_path_searches_make_their_edges_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    for search, sides in ((graph.shortest_to, [("root", 1), ("node", 9)]), (graph.between, None)):
        edges = spark.createDataFrame([(k, k + 1) for k in range(12)], "source long, target long").mapInArrow(counted, "source long, target long")
        before = made.value
        given = [spark.createDataFrame([(v,)], f"{c} long") for c, v in sides] if sides else [spark.createDataFrame([(1, 9)], "root long, node long")]
        assert [(r.root, r.node, r.depth, r.path) for r in search(edges, *given, 8).collect()] == [(1, 9, 8, list(range(1, 10)))]
        assert made.value - before == 12



def test_scan_appends_no_token_by_token():
    text = shape_queries._SHAPES * 5
    profile = cProfile.Profile()
    profile.runcall(javascan.scan_text, text)
    appends = sum(e.callcount for e in profile.getstats() if "'append' of 'list'" in str(e.code))
    assert appends < 2 * len(javascan._Scan(text).word)


def test_flags_shuffle_parts_once(spark):
    parts = spark.createDataFrame([("s", 0, "hardcoded", '"a"', False, "a"), ("s", 1, "tainted", "id", False, None)], "site_id string, pos int, kind string, text string, several boolean, value string")
    found = provenance.flags(parts)
    assert _plan(found).count("Exchange") == 1
    assert [(r.kinds, r.settled, r.names) for r in found.collect()] == [(2, "a", "id")]


def test_sources_that_callers_share_are_handed_up_once(spark, monkeypatch):
    n, sizes, keep = 12, [], Scratch.keep

    def counted(self, df):
        out = keep(self, df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "keep", counted)
    place = "path string, class_name string, scope string"
    sites = spark.createDataFrame([(k, "f", "C", f"m{k}", False, "p") for k in range(n)], f"site_id int, {place}, is_handler boolean, arguments string")
    params = spark.createDataFrame([("f", "C", f"m{k}", "p") for k in range(n)], f"{place}, name string")
    made = spark.createDataFrame([], f"{place}, name string, value string")
    constants = spark.createDataFrame([], "class_name string, field_name string, value string")
    calls = [("f", "C", f"m{k}", "p", "f", "C", f"m{k + 1}", False, "p") for k in range(n - 1)] + [("f", "C", f"m{n - 1}", "p", "f", "C", "go", False, '"x"')]
    callers = spark.createDataFrame(calls, f"{place}, name string, from_path string, from_class string, from_scope string, from_handler boolean, argument string")
    found = provenance.argument_parts(sites, params, made, constants, callers).collect()
    assert {(r.site_id, r.kind, r.text, r.several, r.value) for r in found} == {(k, "hardcoded", '"x"', False, "x") for k in range(n)}
    assert max(sizes) <= 4 * n  # the pairs of a method and those that its parameter comes from are n * n / 2


def test_objects_are_followed_only_for_rules_that_ask(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(analyze.objects, "done_to", lambda *given: asked.append(given))
    files = spark.createDataFrame([("f", "package p; class C { void m(String id) { F f = new F(id); } }")], "path string, text string")
    found = analyze.alerts(files, [Rule("T", "made", "high", ["F.F(*)"], "F made", "path")], taint=False, across=False)
    assert not asked and [(r.rule_id, r.confidence, r.message) for r in found.collect()] == [("T", "low", "F made: parameter id")]


def _drawn_files(spark):
    """Files whose calls have receivers of many kinds; some paths come twice or are null."""
    draw, names = random.Random(4), ["a", "b", "Tool", "Q", "List", "Lone"]
    name = lambda: draw.choice(names)
    kind = lambda: draw.choice(["Tool", "Q", "List", "x.y.Z", "Lone", "int", f"C{draw.randint(0, 9)}"])
    step = lambda: draw.choice([
        "{t} {n} = new {u}({m});", "{n} = new {t}();", "{n}.go({m});", "this.{n}.go();", "{n}.x().y(1);", "new {t}(1).run();", "own({n});", "x.y.Z.call();", "{t}.make();", "{t} {n};", "super.go({n});",
    ]).format(t=kind(), u=kind(), n=name(), m=name())
    rows = []
    for k in range(80):
        head = "".join(f"import lib{draw.randint(0, 2)}.{kind().split('.')[-1]};\n" for _ in range(draw.randint(0, 3)))
        body = "".join(f"void m{i}({kind()} {name()}) {{ {' '.join(step() for _ in range(4))} }}\n" for i in range(2))
        text = f"{f'package p{k % 3};' if k % 4 else ''}\n{head}class C{draw.randint(0, 9)} {{ {kind()} {name()}; {body} class In {{ void z() {{ {step()} }} }} }}"
        rows.append((f"f{k}" if k % 10 else None if k % 20 else "same", text))
    return spark.createDataFrame(rows + rows[:5], "path string, text string")


def test_sites_are_looked_up_file_by_file(spark):
    s = analyze.scan(_drawn_files(spark))
    nothing = spark.createDataFrame([], "class_name string, method string, return_type string")
    near, far = analyze.resolve(s), analyze.resolve(s, nothing)
    assert near._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # sites were moved for each of a dozen look-ups
    rows = near.collect()
    assert sorted(map(str, rows)) == sorted(map(str, far.collect())) and len({r.provenance for r in rows}) >= 9
    assert analyze.resolve(s, text=False).where("text is not null").isEmpty()


def test_links_of_a_method_are_followed_in_one_task(spark, monkeypatch):
    kept, keep, draw = [], Scratch.keep, random.Random(2)
    monkeypatch.setattr(Scratch, "keep", lambda self, df: kept.append(1) or keep(self, df))
    columns = "path string, class_name string, scope string, name string, value string"
    chain = spark.createDataFrame([("p", "A", "m", f"v{k}", f"v{k - 1}") for k in range(1, 20)], columns)
    assert objects.closure(chain).count() == 20 * 20 and len(kept) < 5  # a round for each link before
    value = lambda n: draw.choice(["{}", "this.{}", "{}.make(1)", "new {}()", "null", "true"]).format(n)
    name = lambda: f"v{draw.randint(0, 5)}"
    rows = [(draw.choice(["p", "q", None]), "A", f"m{k % 9}", name(), value(name())) for k in range(120)]
    given = spark.createDataFrame(rows + rows[:9] + [("p", "A", "m", None, "v1"), ("p", "A", "m", "v1", None)], columns)
    monkeypatch.setattr(objects, "_AT_ONCE", 5)
    found = lambda: sorted(map(str, objects.closure(given).collect()))
    near = found()
    monkeypatch.setattr(objects, "HELD", 2)
    assert len(near) > 100 and near == found()
