"""Operators against plain Python on random inputs, many cases to a frame."""

import random
import re

from pyspark.sql import functions as F

from calltide.functions import literals
from calltide.functions import signatures as sg
from calltide.operators import context, graph, lookup, match, merge
from calltide.streaming import ingest

R = random.Random(11)


def test_globs(spark):
    alphabet = ["a", "B", ".", "(", ")", "*", "$", "?", "+", "[x]", "\\"]
    rows = [("".join(R.choice(alphabet) for _ in range(R.randint(1, 6))), "".join(R.choice(["a", "B", ".", "(", ")", "$", "?", "+", "[x]", "\\"]) for _ in range(R.randint(1, 6)))) for _ in range(400)]
    rows += [("a.B.c(*)", s) for s in ("a.B.c()", "a.B.c(int)", "a.B.c(x(y))", "a.B.cc()", "aXB.c()")] + [("*.c()", "a.b.c()"), ("*", "a()")]
    got = spark.createDataFrame(rows, "glob string, sig string").select("glob", "sig", F.rlike("sig", match.glob_regex(F.col("glob"))).alias("hit")).collect()
    for r in got:
        rx = "".join("[^()]*" if c == "*" else re.escape(c) for c in r.glob)
        assert r.hit == bool(re.fullmatch(rx, r.sig)), r


def test_prefiltered_join_equals_the_plain_one(spark):
    sites = [(i, f"{R.choice('pq')}.{R.choice('AB')}.{m}()", m) for i, m in enumerate(R.choices(["run", "exec", "load"], k=60))]
    globs = [("1", "p.A.run(*)"), ("1", "*.run()"), ("2", "*.*(*)"), ("2", "p.A.run()"), ("3", "q.B.ex*(*)"), ("4", "p.B.load()"), ("5", "none.x()")]
    got = match.match_rules(spark.createDataFrame(sites, "id long, signature string, method string"), spark.createDataFrame(globs, "rule_id string, glob string"))
    want = {(i, rule) for i, s, _ in sites for rule, g in globs if re.fullmatch("".join("[^()]*" if c == "*" else re.escape(c) for c in g), s)}
    rows = [(r.id, r.rule_id) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_reach_and_paths(spark):
    edges = [(R.randint(0, 30), R.randint(0, 30)) for _ in range(60)] + [(3, 3), (1, 2), (1, 2)]
    df, roots = spark.createDataFrame(edges, "source long, target long"), spark.createDataFrame([(k,) for k in range(0, 30, 3)], "root long")
    for backward in (False, True):
        got = {(r.root, r.node): r.depth for r in graph.reach(df, roots, 4, backward).collect()}
        want = {}
        for root in range(0, 30, 3):
            seen, near = {root: 0}, [root]
            for d in range(1, 5):
                near = sorted({(a if backward else b) for n in near for a, b in edges if (b if backward else a) == n} - set(seen))
                seen |= {n: d for n in near}
            want |= {(root, n): d for n, d in seen.items()}
        assert got == want
    for r in graph.shortest_paths(df, roots.withColumn("node", F.lit(7).cast("long")), 5).collect():
        assert r.path[0] == r.root and r.path[-1] == 7 and len(r.path) == r.depth + 1 and all((a, b) in edges for a, b in zip(r.path, r.path[1:], strict=False))
    assert graph.reach(df.limit(0), roots, 3).where("depth > 0").count() == 0


def test_best_chain_order(spark):
    rows = [("s", "a", 0, "high"), ("s", "b", 4, "low"), ("s", "c", 2, "medium"), ("s", "d", 2, "medium"), ("t", "a", 0, "medium")]
    best = {r.root: r.source for r in graph.best_chain(spark.createDataFrame(rows, "root string, source string, depth int, confidence string")).collect()}
    assert best == {"s": "c", "t": "a"}


def test_upsert_twice_adds_nothing(spark):
    new = spark.createDataFrame([(R.randint(0, 5), R.randint(0, 3), k) for k in range(40)], "a int, b int, seq int")
    first = merge.keep_first_upsert(new.limit(0), new, ["a", "b"], ["seq"])
    want = {}
    for a, b, k in [tuple(r) for r in new.collect()]:
        want.setdefault((a, b), k)
        want[(a, b)] = min(want[(a, b)], k)
    assert {(r.a, r.b): r.seq for r in first.collect()} == want
    assert merge.keep_first_upsert(first, new, ["a", "b"], ["seq"]).count() == 0


def test_prefer_merge_keeps_copies(spark):
    base = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (3, "z")], "k int, v string")
    other = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "no"), (9, 5, "q"), (9, 4, "p")], "k int, seq int, v string")
    got = merge.prefer_merge(base, other, ["k"], ["seq"], F.col("v") != "no", ["v"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, "b", "override"), (1, "b", "override"), (2, "y", "base"), (3, "z", "base"), (9, "p", "added")]


def test_lists(spark):
    cases = ["int a, Map<String, List<X>> b", "", "  ", "final String s", "T", "A<B,C> x,D y", "a,,b"]
    got = [[tuple(p) for p in r.p] for r in spark.createDataFrame([(c,) for c in cases], "c string").select(sg.parameters(F.col("c")).alias("p")).collect()]
    assert got[:3] == [[("int", "a"), ("Map<String, List<X>>", "b")], [], []] and got[3:] == [[("final String", "s")], [("T", "")], [("A<B,C>", "x"), ("D", "y")], [("a", ""), ("b", "")]]
    rows = spark.createDataFrame([('"a,b", f(x, y), \'+\' + z',), ("",)], "c string").select(literals.arguments(F.col("c")).alias("a"), literals.operands(F.col("c")).alias("o")).collect()
    assert rows[0].a == ['"a,b"', "f(x, y)", "'+' + z"] and rows[0].o == ['"a,b", f(x, y), \'+\'', "z"] and rows[1].a == []
    lit = spark.createDataFrame([('"x"',), ("'c'",), ("-1.5f",), ("null",), ('"a" + "b"',), ("x",)], "c string").select(literals.is_literal(F.col("c")).alias("l")).collect()
    assert [r.l for r in lit] == [True, True, True, True, False, False]
    names = spark.createDataFrame([("([Lp/A$B;I[[JZ)V",), ("()Lx/Y;",)], "c string").select(sg.descriptor_types(F.col("c")).alias("t")).collect()
    assert [r.t for r in names] == [["p.A.B[]", "int", "long[][]", "boolean", "void"], ["x.Y"]]


def test_inheritance(spark):
    supers = spark.createDataFrame([("C", "B", 0), ("C", "I", 1), ("B", "A", 0), ("I", "A", 0), ("A", "C", 0)], "name string, super string, ord int")
    closure = lookup.linearised(supers)
    assert {r.ancestor: r["rank"].distance for r in closure.where("name = 'C'").collect()} == {"C": 0, "B": 1, "I": 1, "A": 2}
    members = spark.createDataFrame([("A", "m"), ("I", "m"), ("B", "n")], "owner string, member string")
    asked = spark.createDataFrame([("C", "m"), ("C", "n"), ("B", "m"), ("C", "none")], "c string, m string")
    assert {(r.c, r.m): r.owner for r in lookup.inherited(asked, closure, members, "c", "m").collect()} == {("C", "m"): "I", ("C", "n"): "B", ("B", "m"): "A"}


def test_windows(spark):
    kinds = [R.choice("abc") for _ in range(50)]
    rows = spark.createDataFrame([(1, k, x) for k, x in enumerate(kinds)], "g int, k int, x string")
    got = {r.k: r for r in context.usage_counts(rows, ["g"], ["k"], F.col("x") == "a").collect()}
    assert all((r.prior, r.later) == (kinds[:k].count("a"), kinds[k + 1 :].count("a")) for k, r in got.items())
    carried = {r.k: r.v for r in context.carry_forward(rows, ["g"], ["k"], F.when(F.col("x") == "b", F.col("k")), "v").collect()}
    assert all(v == max((j for j in range(k + 1) if kinds[j] == "b"), default=None) for k, v in carried.items())
    back = {r.k: r.v for r in context.look_back(rows, ["g"], ["k"], F.col("x") == "c", 3, "v").collect()}
    assert all(v == ("c" in kinds[max(0, k - 3) : k + 1]) for k, v in back.items())


def test_stream_of_new_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (2, "2024-01-01 00:20:00")], "k int, t string").withColumn("t", F.col("t").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    seen = []
    stream = ingest.first_seen(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), ["k"], "t")
    ingest.append_batches(stream, str(tmp_path / "c"), lambda df, _: seen.extend(r.k for r in df.collect())).awaitTermination()
    assert sorted(seen) == [1, 2]
