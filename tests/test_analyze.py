"""The source scan and the rules on a small project written for these tests."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from calltide.operators import graph
from calltide.plans import analyze
from calltide.sources import api_index, java, maven
from calltide.sources.rule_files import load_rules

HANDLER = """package shop.web;

import shop.core.OrderStore;
import java.util.logging.Logger;

@RestController
public class OrderApi {
    private static final Logger LOG = Logger.getLogger("api");
    private final OrderStore store = new OrderStore();

    @GetMapping("/orders")
    public String find(String userName, int size) {
        LOG.info("asked by " + userName);
        // String fake = store.find("x");
        return store.load(userName);
    }

    String quiet(int n) {
        LOG.info("nothing");
        return "";
    }
}
"""
STORE = """package shop.core;

import java.sql.Connection;
import java.sql.Statement;
import javax.crypto.Cipher;

public class OrderStore {
    static final String TABLE = "orders";
    private Connection link;

    public String load(String name) throws Exception {
        Statement s = link.createStatement();
        String sql = "SELECT * FROM " + TABLE + " WHERE a = '" + name + "'";
        s.executeQuery(sql);
        s.executeQuery("SELECT 1 + (2)");
        return helper(name);
    }

    private String helper(String name) throws Exception {
        Cipher c = Cipher
            .getInstance("DES/ECB/PKCS5Padding");
        Cipher d = Cipher.getInstance("AES/GCM/NoPadding");
        Runtime.getRuntime().exec(name);
        new ProcessBuilder("ls", "-l").start();
        return c.toString();
    }

    static class Inner {
        void read(java.io.File f) {
            java.util.Random r = new java.util.Random();
            if (f != null) {
                r.nextInt(3);
            }
        }
    }
}
"""


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for path, text in (("src/main/java/shop/web/OrderApi.java", HANDLER), ("src/main/java/shop/core/OrderStore.java", STORE), ("target/Copy.java", STORE)):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return java.source_files(spark, str(root)).withColumn("path", F.element_at(F.split("path", "/"), -1)).cache()


@pytest.fixture(scope="module")
def scanned(files):
    return analyze.scan(files)


def test_declarations(files, scanned):
    assert files.count() == 2
    rows = {(r.class_name, r.method_name): (r.line, r.end, [p.name for p in r.params], r.is_handler) for r in scanned.methods.collect()}
    assert rows[("OrderApi", "find")] == (12, 16, ["userName", "size"], True)
    assert rows[("OrderApi", "quiet")][:2] == (18, 21)
    assert rows[("OrderStore", "load")] == (11, 17, ["name"], False)
    assert rows[("Inner", "read")][2] == ["f"]
    assert {(r.class_name, r.value) for r in scanned.constants.collect()} == {("OrderStore", "orders"), ("", "orders")}
    assert {r.short_name for r in scanned.imports.where("path = 'OrderStore.java'").collect()} == {"Connection", "Statement", "Cipher"}


def test_resolution(scanned):
    found = {(r.line, r.signature) for r in analyze.resolve(scanned).collect()}
    assert {(12, "java.sql.Connection.createStatement()"), (14, "java.sql.Statement.executeQuery()"), (15, "shop.core.OrderStore.load()"), (13, "java.util.logging.Logger.info()")} <= found
    assert (20, "javax.crypto.Cipher.getInstance()") in found  # a call over two lines
    assert (32, "java.util.Random.nextInt()") in found and (30, "java.util.Random.Random()") in found
    assert not any(line == 14 and "find" in s for line, s in found if "OrderApi" in s)  # a comment is no call


def test_call_graph_and_alerts(spark, files, scanned, tmp_path):
    sites = analyze.resolve(scanned)
    edges = analyze.call_graph(sites, scanned)
    reached = graph.reach(edges, edges.selectExpr("source as root"), 5).where("root like '%::find'").collect()
    assert {r.node.split("::")[-1]: r.depth for r in reached} == {"find": 0, "load": 1, "helper": 2}
    found = analyze.alerts(files).cache()
    by = {(r.rule_id, r.line): r for r in found.collect()}
    assert by[("S001", 14)].confidence == "high" and by[("S001", 14)].chain_source.endswith("::find")
    assert by[("S001", 12)].confidence == "high"
    assert by[("S010", 20)].confidence == "high" and by[("S010", 22)].confidence == "low"
    assert by[("S012", 30)].severity == "medium"
    assert by[("S013", 13)].confidence == "high" and ("S013", 19) not in by
    assert by[("S004", 14)].confidence in ("high", "medium")
    without = analyze.alerts(files, taint=False)
    assert without.where("rule_id = 'S004'").count() == 0
    one = analyze.append_alerts(spark, found, str(tmp_path / "alerts"))
    n = one.count()
    assert analyze.append_alerts(spark, found, str(tmp_path / "alerts")).count() == n == found.count()
    assert "S001" in analyze.report(found)


def test_empty_project(spark, files):
    none = files.where("path = 'none'")
    assert analyze.alerts(none).count() == 0


def test_rule_files(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("id: X1\nname: one\nseverity: HIGH\nsignaturePatterns:\n  - 'a.B.c(*)'\ntags: [x]\nrequiresTaintAnalysis: true\n")
    (tmp_path / "b.json").write_text(json.dumps({"id": "X2", "signaturePatterns": ["d(*)"]}))
    (tmp_path / "c.yaml").write_text("name: no id\n")
    rules = load_rules(spark, str(tmp_path))
    assert [(r.id, r.severity, r.globs, r.needs_chain) for r in rules] == [("X1", "high", ["a.B.c(*)"], True), ("X2", "medium", ["d(*)"], False)]


JAVAP = """Compiled from "Base.java"
public class p.Base<T extends java.lang.Object> {
  public p.Base();
    descriptor: ()V
  public java.lang.String name(int, java.util.List<java.lang.String>);
    descriptor: (ILjava/util/List;)Ljava/lang/String;
  public int name();
    descriptor: ()I
  public static final int MAX;
    descriptor: I
}
Compiled from "Sub.java"
public final class p.Sub extends p.Base<java.lang.String> implements java.util.Map<java.lang.String, p.Base>, p.Named {
  public p.Sub other();
    descriptor: ()Lp/Sub;
}
"""


def test_api_index(spark, tmp_path):
    classes, methods, fields = api_index.parse_javap(spark.createDataFrame([("x", JAVAP)], "file string, text string"))
    assert {(r.name, r.super_class, tuple(r.interfaces)) for r in classes.collect()} == {("p.Base", None, ()), ("p.Sub", "p.Base", ("java.util.Map", "p.Named"))}
    assert {(r.class_name, r.method_name, r.ordinal, r.return_type) for r in methods.collect()} == {("p.Base", "<init>", 0, "void"), ("p.Base", "name", 0, "java.lang.String"), ("p.Base", "name", 1, "int"), ("p.Sub", "other", 0, "p.Sub")}
    assert [tuple(r) for r in fields.collect()] == [("p.Base", "MAX", "int", ["static", "final"])]
    assert tuple(api_index.index_stats(classes, methods, fields).first()) == (2, 4, 1, 1)
    asked = spark.createDataFrame([("p.Sub", "name"), ("p.Sub", "other"), ("p.Sub", "none")], "class_name string, method string")
    assert {tuple(r) for r in api_index.return_types(asked, classes, methods).collect()} == {("p.Sub", "name", "java.lang.String"), ("p.Sub", "other", "p.Sub")}
    compact = {r.name: json.loads(r.json) for r in api_index.to_compact(classes, methods, fields).collect()}
    (tmp_path / "index.json").write_text(json.dumps(compact))
    again = api_index.read_compact(spark, str(tmp_path / "index.json"))
    assert {tuple(r)[:4] for r in again[1].select("class_name", "method_name", "ordinal", "descriptor").collect()} == {tuple(r)[:4] for r in methods.select("class_name", "method_name", "ordinal", "descriptor").collect()}


POM = """<project><properties><v.a>1.2</v.a></properties><dependencies>
<dependency><groupId>g.x</groupId><artifactId>a</artifactId><version>${v.a}</version></dependency>
<dependency><groupId>g.x</groupId><artifactId>b</artifactId><version>${none}</version></dependency>
<dependency><groupId>g.x</groupId><artifactId>t</artifactId><version>1</version><scope>test</scope></dependency>
</dependencies></project>"""
PARENT = "<project><dependencies><dependency><groupId>g.x</groupId><artifactId>a</artifactId><version>9</version></dependency><dependency><groupId>g.x</groupId><artifactId>c</artifactId><version>3</version></dependency></dependencies></project>"


def test_maven(spark, tmp_path):
    poms = spark.createDataFrame([("pom", POM), ("parent", PARENT)], "path string, xml string")
    deps = maven.dependencies(poms)
    assert {(r.artifact_id, r.version) for r in deps.where("path = 'pom'").collect()} == {("a", "1.2"), ("b", None)}
    parents = spark.createDataFrame([("pom", "parent"), ("parent", "pom")], "path string, parent string")
    every = maven.with_parents(deps, parents).where("path = 'pom'")
    assert {(r.artifact_id, r.version) for r in every.collect()} == {("a", "1.2"), ("b", None), ("c", "3")}
    files = spark.createDataFrame([(p,) for p in ("g/x/a/1.2/a-1.2.jar", "g/x/a/1.2/a-1.2-sources.jar", "g/x/b/1.9/b-1.9.jar", "g/x/b/1.10/b-1.10.jar")], "path string")
    assert {(r.artifact_id, r.jar, r.how) for r in maven.resolved_jars(every, files).collect()} == {("a", "g/x/a/1.2/a-1.2.jar", "exact"), ("b", "g/x/b/1.9/b-1.9.jar", "latest"), ("c", None, "missing")}
    with zipfile.ZipFile(tmp_path / "x.jar", "w") as z:
        for n in ("p/A.class", "p/A$B.class", "META-INF/x.class", "p/readme"):
            z.writestr(n, "")
    jars = spark.read.format("binaryFile").load(str(tmp_path / "x.jar"))
    assert [r.name for r in maven.class_names(jars).collect()] == ["p.A"]
    settings = spark.createDataFrame([("s", "<settings><localRepository> /r </localRepository><repository><id>i</id><url>http://u</url></repository></settings>")], "path string, xml string")
    assert [tuple(r) for r in maven.repositories(settings).collect()] == [("s", "/r", "http://u")]


SHAPES = '''package a.b;
import java.util.*;
import java.io.File;
/* a comment
   Cipher.getInstance("DES");
*/
@RestController
public class Shapes<T> extends Base {
  private final Map<String, List<T>> held = new HashMap<>();
  String one() { return x; }
  public <R> List<R> two(@Param("a") final String a,
      Map<String, int[]> b)
      throws Exception {
    try (Connection c = source.open(); Statement s = c.make()) {
      Rows r = s
          .run("SELECT { " + a
             + part(b, 1));
      for (String q : list) { use(q); }
      int i = 0, j = 2;
      late = new File(a);
      x.y().z(w.v());
      list.forEach(k -> { seen(k); });
      Object o = new Task() { public void go() { work(a); } };
    } catch (IllegalStateException | Error e) { log.info("no } end"); }
    if (o instanceof Shapes p && p.ok()) return null;
    String t = """
      text { of "lines"
      """;
    return null;
  }
  abstract void none();
  enum Kind { A(1), B(2) { int q() { return deep(); } }; Kind(int i) {} }
  record Pair(int left, String right) { int sum() { return left; } }
}'''


def test_facts_of_many_shapes(spark):
    rows = [("s", SHAPES), ("bad", "class X { void f() { g(); "), ("open", "class Y { } /* never"), ("empty", ""), ("null", None)]
    found = java.facts(spark.createDataFrame(rows, "path string, text string")).cache()
    methods = {(r.class_name, r.method_name): (r.line, r.end, [(p.type, p.name) for p in r.params]) for r in java.methods(found.where("path = 's'")).collect()}
    assert methods[("Shapes", "one")] == (10, 10, []) and methods[("Shapes", "none")] == (31, 31, [])
    assert methods[("Shapes", "two")] == (11, 30, [("String", "a"), ("Map<String, int[]>", "b")])
    assert methods[("Shapes", "go")][:2] == (23, 23) and methods[("Pair", "sum")][0] == 33 and ("Kind", "q") in methods
    names = {(r.scope, r.name): (r.type, r.value) for r in java.variables(found.where("path = 's'")).collect()}
    assert names[("<fields>", "held")][0] == "HashMap" and names[("two", "s")] == ("Statement", "c.make()") and names[("two", "q")][0] == "String"
    assert names[("two", "j")] == ("int", "2") and names[("two", "e")][0] == "IllegalStateException" and names[("two", "p")][0] == "Shapes"
    assert names[("two", "late")] == ("File", "new File(a)") and names[("two", "b")][0] == "Map" and names[("<fields>", "right")][0] == "String"
    calls = [(r.line, r.receiver, r.method, r.args) for r in java.calls(found.where("path = 's'")).orderBy("seq").collect()]
    assert (15, "s", "run", 'SELECT { " + a + part(b, 1)'.join(('"', ""))) in calls and (21, "x.y()", "z", "w.v()") in calls
    assert calls.index((21, "x.y()", "z", "w.v()")) < calls.index((21, "x", "y", "")) and not any(m == "getInstance" for _, _, m, _ in calls)
    assert {m for _, _, m, _ in calls} >= {"open", "make", "part", "use", "v", "forEach", "seen", "work", "info", "ok", "deep", "<init>"}
    read = {r.path: (r.calls, r.error is None) for r in java.files_read(found).collect()}
    assert read["s"][1] and read["bad"] == (1, False) and read["open"][1] is False and set(read) <= {"s", "bad", "open", "empty", "null"}


PROBES = '''package p;
import javax.xml.parsers.*;
import javax.crypto.Cipher;
import javax.naming.InitialContext;
import javax.xml.parsers.DocumentBuilder;
import javax.xml.parsers.DocumentBuilderFactory;
public class RunController {
  String run(String cmd) throws Exception { Runtime.getRuntime().exec(cmd); return cmd; }
  void begin(String cmd) throws Exception {
    ProcessBuilder b = new ProcessBuilder(cmd);
    b.start();
    new ProcessBuilder("ls").start();
  }
  void codes() throws Exception { Cipher.getInstance("DESede/CBC");
    Cipher.getInstance("ARCFOUR"); }
  void names(String n, InitialContext c) throws Exception { c.lookup(n); }
  void safe(String f) throws Exception {
    DocumentBuilderFactory k = DocumentBuilderFactory.newInstance();
    k.setFeature("x", true);
    DocumentBuilder d = k.newDocumentBuilder();
    d.parse("a.xml");
  }
  void open() throws Exception {
    DocumentBuilderFactory k = DocumentBuilderFactory.newInstance();
    DocumentBuilder d = k.newDocumentBuilder();
    d.parse("a.xml");
    other.parse("b");
  }
}'''


def test_rules_of_the_probe_project(spark, tmp_path):
    returns = spark.createDataFrame([("java.lang.Runtime", "getRuntime", "java.lang.Runtime")], "class_name string, method string, return_type string")
    found = analyze.alerts(spark.createDataFrame([("P.java", PROBES)], "path string, text string"), returns=returns, taint=False).cache()
    got = {(r.rule_id, r.line): r.confidence for r in found.collect()}
    assert got[("S003", 8)] == "high" and got[("S003", 11)] == "high" and ("S003", 12) not in {k for k in got if got[k] == "high"}
    assert got[("S010", 14)] == "low" and got[("S010", 15)] == "high"
    assert got[("S008", 16)] == "critical"
    assert ("S007", 21) not in got and got[("S007", 26)] == "high" and ("S007", 27) not in got and got[("S007", 18)] == got[("S007", 24)] == "medium"
    table = str(tmp_path / "alerts")
    first = analyze.append_alerts(spark, found, table).count()
    assert first == analyze.append_alerts(spark, found.withColumn("detected_at", F.lit(5).cast("long")), table).count()
    later = found.withColumn("line", F.col("line") + 100).withColumn("detected_at", F.lit(9).cast("long"))
    both = analyze.newest(analyze.append_alerts(spark, later, table)).collect()
    assert len(both) == 2 * first and both[0].detected_at == 9 and both[0].taint is None and analyze.with_taint(found).count() == 0
    assert analyze.append_alerts(spark, later, table, clear=True).count() == first
    assert sum(r.n for r in analyze.summary(found).collect()) == first
