"""Members of printed classes: modifiers, throws, deprecation, order, repeats, and the compact JSON of them."""

import json

import pytest
from pyspark.sql import functions as F

from calltide.sources import api_index

PRINTED = """Warning: public class no.Class of which this line tells
Compiled from "A.java"
public abstract class p.A$In<K extends java.util.Map<K, java.util.List<int[]>>> implements p.One<K>, p.Two {
  public static final java.lang.String NAME;
    descriptor: Ljava/lang/String;
    Deprecated: true
  public volatile int[][] grid;
    descriptor: [[I
  static {};
    descriptor: ()V
  public p.A$In(long);
    descriptor: (J)V
  public abstract <T> T find(java.lang.Class<T>, int...) throws java.io.IOException, p.A$Bad;
    descriptor: (Ljava/lang/Class;[I)Ljava/lang/Object;
    flags: (0x0401) ACC_PUBLIC, ACC_ABSTRACT
    Deprecated: true
    RuntimeVisibleAnnotations:
      0: #1()
  public static synchronized native void find();
    descriptor: ()V
  public int lost();
}
  public int outside();
    descriptor: ()I
Compiled from "B.java"
public interface p.B extends p.One<java.lang.String>, p.Three {
  public default void again();
    descriptor: ()V
}
public final class p.C extends p.A$In<p.C> {
}
"""
WANT = {
    "p.A.In": {
        "s": "", "i": ["p.One", "p.Two"],
        "m": {
            "<init>": [["(J)V", "void", ["long"], [], [], 0]],
            "find": [
                ["(Ljava/lang/Class;[I)Ljava/lang/Object;", "java.lang.Object", ["java.lang.Class", "int[]"], ["abstract"], ["java.io.IOException", "p.A.Bad"], 1],
                ["()V", "void", [], ["static", "synchronized", "native"], [], 0],
            ],
        },
        "f": {"NAME": ["java.lang.String", ["static", "final"]], "grid": ["int[][]", ["volatile"]]},
    },
    "p.B": {"s": "", "i": ["p.One", "p.Three"], "m": {"again": [["()V", "void", [], ["default"], [], 0]]}, "f": {}},
    "p.C": {"s": "p.A.In", "i": [], "m": {}, "f": {}},
}


def compact(tables):
    return {r.name: json.loads(r.json) for r in api_index.to_compact(*tables).collect()}


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_members_of_a_text(spark, end):
    texts = spark.createDataFrame([("a", PRINTED.replace("\n", end)), ("b", ""), ("c", None)], "file string, text string")
    assert compact(api_index.parse_javap(texts)) == WANT


def test_files_are_parted_by_the_reader(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text(PRINTED)
    with_split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        texts = api_index.javap_texts(spark, str(tmp_path / "in"))
        assert texts.rdd.getNumPartitions() > 2
        assert compact(api_index.parse_javap(texts)) == WANT
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", with_split)


def test_index_goes_to_json_and_parquet_and_back(spark, tmp_path):
    tables = api_index.parse_javap(spark.createDataFrame([("a", PRINTED)], "file string, text string"))
    (tmp_path / "i.json").write_text(json.dumps(compact(tables)))
    assert compact(api_index.read_compact(spark, str(tmp_path / "i.json"))) == WANT
    api_index.write_index(*tables, str(tmp_path / "index"))
    assert compact(api_index.read_index(spark, str(tmp_path / "index"))) == WANT


def test_short_rows_and_names_that_need_quotes(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"p.X": {"m": {'a"b\\': [["(I)V", "void"]]}, "f": {"v": ["int"]}}}))
    assert compact(api_index.read_compact(spark, str(tmp_path / "i.json"))) == {"p.X": {"s": "", "i": [], "m": {'a"b\\': [["(I)V", "void", ["int"], [], [], 0]]}, "f": {"v": ["int", []]}}}


def test_the_last_printing_of_a_class_counts(spark):
    old, new = (f"public class p.X {{\n  public void {m}();\n    descriptor: ()V\n}}\n" for m in ("old", "fresh"))
    for rows in ([("a", old), ("b", new)], [("a", old + new)]):
        _, methods, _ = api_index.parse_javap(spark.createDataFrame(rows, "file string, text string"))
        assert [r.method_name for r in methods.collect()] == ["fresh"]


def test_no_texts_give_empty_tables(spark):
    tables = api_index.parse_javap(spark.createDataFrame([], "file string, text string"))
    assert [t.count() for t in tables] == [0, 0, 0]
    assert tables[1].select(F.max("deprecated")).first()[0] is None
