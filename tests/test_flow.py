"""Provenance over terms and calls, user checks, overloads, and traversal of hubs, each against plain Python."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from calltide.operators import checks, graph, overloads, provenance
from calltide.operators.rules import Rule, decide
from calltide.sources.javascan import scan_text

PLACE = "path string, class_name string, scope string"


def parts(spark, arguments, values=(), params=(), constants=(), callers=None, handler=False):
    sites = spark.createDataFrame([("s", "p", "A", "m", handler, arguments)], f"site_id string, {PLACE}, is_handler boolean, arguments string")
    given = spark.createDataFrame([("p", "A", "m", n) for n in params], f"{PLACE}, name string")
    made = spark.createDataFrame([("p", "A", "m", n, v) for n, v in values], f"{PLACE}, name string, value string")
    known = spark.createDataFrame([("A", n, v) for n, v in constants], "class_name string, field_name string, value string")
    if callers is not None:
        columns = f"{PLACE}, name string, from_path string, from_class string, from_scope string, from_handler boolean, argument string"
        callers = spark.createDataFrame(callers, columns)
    found = provenance.argument_parts(sites, given, made, known, callers)
    return sorted((r.pos, r.kind, r.text, r.several) for r in found.collect())


def test_names_used_twice_and_in_circles(spark):
    chain = [("v0", "id")] + [(f"v{k}", f"v{k - 1} + v{k - 1}") for k in range(1, 13)]
    assert parts(spark, "v12", chain, params=["id"]) == [(0, "tainted", "id", True)]
    assert parts(spark, "x", [("x", "y"), ("y", "x")]) == [(0, "variable", "x", False)]
    assert parts(spark, 'x, "b"', [("x", 'x + "a"')]) == [(0, "hardcoded", '"a"', True), (1, "hardcoded", '"b"', False)]
    assert parts(spark, "Arrays.asList(a, NAME).toArray()", [("a", "q.trim()")], ["q"], [("NAME", "n")], handler=True) == [
        (0, "external_input", "q", True), (0, "hardcoded", "NAME", True)
    ]


def test_parameters_are_followed_into_callers(spark):
    calls = [
        ("p", "A", "m", "q", "p2", "B", "go", False, "r"), ("p2", "B", "go", "r", "p3", "C", "handle", True, 'in + "x"'),
        ("p", "A", "m", "q", "p", "A", "m", False, "q"), ("p3", "C", "handle", "in", "p4", "D", "d", False, '"never: a handler"'),
    ]
    places = [("p", "A", "m", "q"), ("p2", "B", "go", "r"), ("p3", "C", "handle", "in")]
    sites = spark.createDataFrame([("s", "p", "A", "m", False, "q")], f"site_id string, {PLACE}, is_handler boolean, arguments string")
    params = spark.createDataFrame(places, f"{PLACE}, name string")
    none = spark.createDataFrame([], f"{PLACE}, name string, value string")
    constants = spark.createDataFrame([], "class_name string, field_name string, value string")
    columns = f"{PLACE}, name string, from_path string, from_class string, from_scope string, from_handler boolean, argument string"
    found = provenance.argument_parts(sites, params, none, constants, spark.createDataFrame(calls, columns))
    assert sorted((r.kind, r.text) for r in found.collect()) == [("external_input", "in"), ("hardcoded", '"x"')]
    alone = provenance.argument_parts(sites, params, none, constants, spark.createDataFrame([], columns))
    assert [(r.kind, r.text) for r in alone.collect()] == [("tainted", "q")]


def _by_name(c):
    if c["sink"]["method"] == "bad":
        raise RuntimeError("no")
    return {"alert": True, "message": c["sink"]["method"] + (" chained" if c["chain"] else "")}


def _by_batch(columns):
    if any(s["method"] == "bad" for s in columns["sink"]):
        raise RuntimeError("no")
    return [s["method"] != "quiet" for s in columns["sink"]]


def test_user_checks_fail_open(spark, tmp_path):
    (tmp_path / "own.py").write_text("def check(c):\n    return c['sink']['method'] == 'exec'\n")
    (tmp_path / "none.py").write_text("x = 1\n")
    added = checks.load_checks(spark, str(tmp_path))
    assert sorted(added) == ["none", "none.py", "own", "own.py"]
    added.add("name", _by_name)
    added.add("batch", _by_batch, batched=True)
    rules = [Rule("A", "a", "high", [], "A", "name"), Rule("B", "b", "low", [], "B", "batch"), Rule("C", "c", "low", [], "C", "own.py"), Rule("D", "d", "low", [], "D", "none"), Rule("E", "e", "low", [], "E", "always"), Rule("F", "f", "low", [], "F", "lost")]
    rows = [(r.id, m, chain) for r in rules for m, chain in (("exec", None), ("bad", "high"), ("quiet", "high"))]
    columns = {"receiver_ext": False, "receiver_tainted": False, "ext": False, "tainted": False, "hard_any": False}
    matched = spark.createDataFrame(rows, "rule_id string, method string, chain string").withColumns({k: F.lit(v) for k, v in columns.items()}).withColumn("names", F.lit(""))
    got = sorted((r.rule_id, r.method, r.confidence, r.message) for r in decide(matched, rules, added).collect())
    lost = "check failed: RuntimeError: no"
    assert got == sorted([
        ("A", "exec", "medium", "exec"), ("A", "bad", "low", lost), ("A", "quiet", "medium", "quiet chained"), ("B", "exec", "medium", "B"), ("B", "bad", "low", lost),
        ("C", "exec", "medium", "C"), *(("D", m, "low", "check failed: TypeError: no function check") for m in ("exec", "bad", "quiet")),
        *(("E", m, "high", "E") for m in ("exec", "bad", "quiet")), *(("F", m, "low", "F") for m in ("exec", "bad", "quiet")),
    ])
    assert decide(matched.limit(0), rules, added).count() == 0


@pytest.mark.parametrize("answer, told", [(True, (True, None, "medium")), (False, (False, None, None)), ({"alert": True, "confidence": "high"}, (True, None, "high")), (None, (True, "check gave no verdict", "low")), ({"alert": 1}, (True, "check gave no verdict", "low")), ({"alert": True, "confidence": "sure"}, (True, "check gave no verdict", "low"))])
def test_verdicts(answer, told):
    assert checks.verdict(answer) == told


def test_overloads(spark):
    supers = spark.createDataFrame([("Dog", "Animal", 0), ("Pup", "Dog", 0), ("Pup", "Small", 1), ("Box", "Base", 0)], "name string, super string, ord int")
    methods = [
        ("Box", "put", 0, ["Animal"]), ("Box", "put", 1, ["Dog"]), ("Base", "put", 0, ["Pup"]), ("Box", "put", 2, ["java.lang.Object"]), ("Box", "put", 3, ["Dog", "int"]),
        ("Box", "put", 4, ["Dog", "double"]), ("Box", "put", 5, []), ("Lone", "put", 0, ["long"]), ("Lone", "put", 1, ["java.lang.Integer"]), ("Lone", "put", 2, ["float"]),
    ]
    asked = [
        (1, "Box", ["Pup"]), (2, "Box", ["Dog"]), (3, "Box", ["Stone"]), (4, "Box", ["Pup", "long"]), (5, "Box", ["Pup", "short"]), (6, "Box", []), (7, "Lone", ["int"]),
        (8, "Lone", ["java.lang.Integer"]), (9, "Lone", ["boolean"]), (10, "Box", [None]), (11, "Box", ["Pup", None]), (12, "Nowhere", ["int"]),
    ]
    calls = spark.createDataFrame([(i, c, "put", g) for i, c, g in asked], "site_id int, class_name string, method string, given array<string>")
    declared = spark.createDataFrame(methods, "class_name string, method_name string, ordinal int, param_types array<string>")
    got = {r.site_id: (r.owner, r.ordinal, r.sure) for r in overloads.choose(calls, declared, supers).collect()}
    assert got == {
        1: ("Base", 0, True), 2: ("Box", 1, True), 3: ("Box", 2, True), 4: ("Box", 4, True), 5: ("Box", 3, True), 6: ("Box", 5, True), 7: ("Lone", 0, True),
        8: ("Lone", 1, True), 10: ("Box", 0, False), 11: ("Box", 3, False),
    }


def walked(edges, root, depth, backward=False):
    out, level = {root: (0, (root,))}, {root: (root,)}
    for k in range(1, depth + 1):
        found = {}
        for node, path in level.items():
            for a, b in edges:
                a, b = (b, a) if backward else (a, b)
                if a == node and b not in out:
                    found[b] = min(found.get(b, (*path, b)), (*path, b))
        out |= {n: (k, p) for n, p in found.items()}
        level = found
    return out


def test_both_ends_meet_on_the_same_paths(spark):
    r = random.Random(4)
    edges = sorted({(r.randint(0, 60), r.randint(0, 60)) for _ in range(170)})
    pairs = sorted({(r.randint(0, 60), r.randint(0, 60)) for _ in range(80)})
    e = spark.createDataFrame(edges, "source long, target long")
    got = {(x.root, x.node): (x.depth, tuple(x.path)) for x in graph.between(e, spark.createDataFrame(pairs, "root long, node long"), 5).collect()}
    want = {(a, b): w[b] for a, b in pairs if b in (w := walked(edges, a, 5))}
    assert got == want
    halves = sum(len(walked(edges, a, 3)) for a in {a for a, _ in pairs}) + sum(len(walked(edges, b, 2, True)) for b in {b for _, b in pairs})
    assert halves < 0.75 * sum(len(walked(edges, a, 5)) for a in {a for a, _ in pairs})


def test_a_hub_is_met_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUB", 1000)
    spokes = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("source"), F.col("id").alias("target"))
    edges = spokes.unionByName(spark.createDataFrame([(-1, 0), (-2, 0), (5, 200_000)], "source long, target long"))
    dealt, hubs = graph.blocks(edges.select(F.col("source").alias("node"), F.col("target").alias("next")))
    assert [(h.node, h.blocks) for h in hubs.collect()] == [(0, 100)]
    sizes = Counter(r.n for r in dealt.where("node = 0").groupBy("block").agg(F.count("*").alias("n")).collect())
    assert max(sizes) < 1200 and sum(sizes.values()) == 100
    found = graph.reach(edges, spark.createDataFrame([(-1,), (-2,)], "root long"), 3)
    counts = defaultdict(int)
    for r in found.groupBy("root", "depth").count().collect():
        counts[r.root, r.depth] = r["count"]
    assert counts == {(x, d): n for x in (-1, -2) for d, n in ((0, 1), (1, 1), (2, 100_000), (3, 1))}


def test_scan_of_annotations_and_compact_constructors():
    text = '@A(b = @B("q"))\nclass C {\n  @Get(value = "/x", n = {1, 2}) @D public R f(@P(name = "v") int v) { g(v); }\n  @X(y = 1) int z = h(2);\n  record P(int a) { P { k(a); } }\n}\n'
    facts = scan_text(text)
    assert [(f.name, [p["name"] for p in f.params]) for f in facts if f.kind == "method"] == [("f", ["v"]), ("P", ["a"])]
    assert [(f.name, f.method_name) for f in facts if f.kind == "call"] == [("g", "f"), ("h", None), ("k", "P")]
    assert [(f.name, f.value) for f in facts if f.kind == "variable"] == [("z", "h(2)"), ("a", "")]


WEAK = """package w;
import javax.crypto.Cipher;
class K {
  static final String ALGO = "DES";
  static final String FINE = "AES/GCM/NoPadding";
  Cipher one() { return Cipher.getInstance(ALGO); }
  Cipher two() { String a = FINE; return Cipher.getInstance(a); }
  Cipher three(boolean b) { String a = b ? ALGO : FINE; return Cipher.getInstance(a); }
  Cipher four() { return made("RC4"); }
  private Cipher made(String name) { return Cipher.getInstance(name); }
}
"""


def test_algorithms_are_settled_by_constants_and_callers(spark):
    from calltide.plans import analyze

    files = spark.createDataFrame([("w/K.java", WEAK)], "path string, text string")
    got = {r.method_name: (r.confidence, r.message) for r in analyze.alerts(files, taint=False).where("rule_id = 'S010'").collect()}
    assert got["one"] == ("high", "Weak algorithm - DES keys are too short")
    assert got["two"] == ("low", "Weak algorithm - the algorithm is not known")  # known, and not on a list
    assert got["three"][0] == "low"
    assert got["made"] == ("high", "Weak algorithm - RC4 is broken")


def _drawn(draw, k):
    """A place's rows at random: names made of each other, also twice, calls in calls, constants, parameters, fields; some rows come twice."""
    names = [f"v{i}" for i in range(7)]
    leaf = lambda: draw.choice([*names, "NAME", "D.FAR", "q", "r", '"x"', "7", "o.f", "go(1)", "a - b"])
    term = lambda: draw.choice(["{}", "{}", "{}", "{}.trim()", "Arrays.asList({}, {})", "of({}.trim())", "{}.trim().split(1)"]).format(leaf(), leaf())
    value = lambda: " + ".join(term() for _ in range(draw.randint(1, 3)))
    place = (f"p{k % 5}", draw.choice(["A", "B"]), f"m{k}")
    values = [(*place, draw.choice([*names, "q", "NAME", "null"]), draw.choice([value(), value(), "+", "", None])) for _ in range(draw.randint(0, 8))]
    fields = [(*place[:2], "<fields>", draw.choice(names), value())]
    params = [(*place, n) for n in draw.sample([*names, "q", "r"], 2)]
    sites = [(f"s{k}.{i}", *place, draw.random() < 0.3, ", ".join(value() for _ in range(draw.randint(1, 2)))) for i in range(2)]
    return sites, params + params[:1], values + values[:2] + fields


def test_search_of_a_place_and_by_joins_agree(spark, monkeypatch):
    draw = random.Random(3)
    sites, params, values = (sum(rows, []) for rows in zip(*(_drawn(draw, k) for k in range(60)), strict=True))
    known = [("A", "NAME", "n"), ("A", "NAME", "m"), ("", "NAME", "z"), ("D", "FAR", "f"), ("B", "v3", "3"), ("A", "v1.trim()", "t")]
    tables = [
        spark.createDataFrame(sites, f"site_id string, {PLACE}, is_handler boolean, arguments string"), spark.createDataFrame(params, f"{PLACE}, name string"),
        spark.createDataFrame(values, f"{PLACE}, name string, value string"), spark.createDataFrame(known, "class_name string, field_name string, value string"),
    ]
    found = lambda: sorted(map(str, provenance.argument_parts(*tables).collect()))
    monkeypatch.setattr(provenance, "_AT_ONCE", 7)
    near = found()
    monkeypatch.setattr(provenance, "HELD", 0)
    assert len(near) > 200 and near == found()
    assert len({x.split("kind='")[1].split("'")[0] for x in near}) == 7


def test_search_of_a_place_takes_no_rounds(spark, monkeypatch):
    kept, keep = [], provenance.Scratch.keep
    monkeypatch.setattr(provenance.Scratch, "keep", lambda self, df: kept.append(1) or keep(self, df))
    chain = [("v0", "id")] + [(f"v{k}", f"v{k - 1} + v{k - 1}") for k in range(1, 40)]
    assert parts(spark, "v39", chain, params=["id"]) == [(0, "tainted", "id", True)]
    assert len(kept) < 15
