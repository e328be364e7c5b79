"""``python -m calltide``: ``analyze PATH``, ``list-rules``, ``graph PATH --method NAME --depth N``, ``build-index JAVAP OUT``.

``analyze`` ends with 0 if no alert is critical or high, with 1 if one is, and with 2 if it could not run. ``--store`` appends new
alerts to a Parquet table (``--clear`` empties it first), ``--stored`` prints what the table holds, newest first; ``--out`` writes all
alerts as JSON lines, as the terminal gets ``--most`` of them only.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from calltide.operators import graph
from calltide.operators.checks import load_checks
from calltide.operators.rules import RULES
from calltide.plans import analyze
from calltide.sources import api_index, java
from calltide.sources.rule_files import load_rules


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="calltide", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze")
    a.add_argument("path")
    a.add_argument("--format", choices=("text", "json"), default="text")
    a.add_argument("--severity", default="")
    a.add_argument("--rules", help="a folder of rule files, with the checks (.py) that they name")
    a.add_argument("--file")
    a.add_argument("--no-taint", action="store_true")
    a.add_argument("--sanitizers", action="store_true")
    a.add_argument("--index", help="an API index (JSON), for types of chained calls")
    a.add_argument("--store", help="a Parquet table that keeps alerts across runs")
    a.add_argument("--clear", action="store_true")
    a.add_argument("--stored", action="store_true")
    a.add_argument("--out")
    a.add_argument("--most", type=int, default=1000)
    sub.add_parser("list-rules")
    g = sub.add_parser("graph")
    g.add_argument("path")
    g.add_argument("--method", required=True)
    g.add_argument("--depth", type=int, default=3)
    g.add_argument("--most", type=int, default=1000)
    x = sub.add_parser("build-index")
    x.add_argument("javap", help="text that javap -public -s has printed, one or more files")
    x.add_argument("out")
    args = p.parse_args(argv)
    if args.command == "list-rules":
        for r in RULES:
            print(f"{r.id}  {r.severity:9}{r.name}{' (needs a taint chain)' if r.needs_chain else ''}")
        return 0
    spark = SparkSession.builder.appName("calltide").getOrCreate()
    try:
        return {"graph": _graph, "build-index": _build_index, "analyze": _analyze}[args.command](spark, args)
    except Exception as why:  # the exit code tells a build that nothing was checked
        print(f"{type(why).__name__}: {why}", file=sys.stderr)
        return 2


def _graph(spark: SparkSession, args: argparse.Namespace) -> int:
    s = analyze.scan(java.source_files(spark, args.path))
    edges = analyze.call_graph(analyze.resolve(s), s)
    roots = edges.select(F.col("source").alias("root")).union(edges.select("target")).distinct()
    roots = roots.where(F.col("root").endswith("::" + args.method) | F.col("root").contains(args.method))
    for way, backward in (("callers", True), ("callees", False)):
        found = graph.reach(edges, roots, args.depth, backward).where("depth > 0").orderBy("root", "depth", "node")
        for r in found.limit(args.most).collect():
            print(f"{way} {r.root} {r.depth} {r.node}")
    return 0


def _build_index(spark: SparkSession, args: argparse.Namespace) -> int:
    texts = api_index.javap_texts(spark, args.javap)
    api_index.write_index(*api_index.parse_javap(texts), args.out)
    return 0


def _analyze(spark: SparkSession, args: argparse.Namespace) -> int:
    began = time.time()
    if args.stored:
        found = analyze.newest(analyze.stored(spark, args.store))
        print("\n".join(found.limit(args.most).toJSON().collect()))
        return 0
    rules, checks = (load_rules(spark, args.rules), load_checks(spark, args.rules)) if args.rules else (None, None)
    files = java.source_files(spark, args.path)
    returns = None
    if args.index:
        classes, methods, _ = api_index.read_compact(spark, args.index)
        returns = api_index.first_returns(classes, methods)
    files = java.one_file(files, args.file) if args.file else files
    found = analyze.alerts(files, rules, returns, int(began * 1000), taint=not args.no_taint, sanitizers=args.sanitizers, checks=checks)
    found = (found.where(F.col("severity") == args.severity) if args.severity else found).cache()
    if args.store:
        analyze.append_alerts(spark, found, args.store, args.clear)
    if args.out:
        found.write.mode("overwrite").json(args.out)
    print("\n".join(found.limit(args.most).toJSON().collect()) if args.format == "json" else analyze.report(found, args.most))
    print(f"{found.count()} alerts in {time.time() - began:.1f} s", file=sys.stderr)
    return int(not found.where("severity in ('critical', 'high')").isEmpty())


if __name__ == "__main__":
    sys.exit(main())
