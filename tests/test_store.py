"""Appends that keep each key once, by one run and by several at a time."""

import threading
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from calltide.sources.store import CommitLost, Store

SCHEMA = "k long, who string, at long"


def store(spark, path) -> Store:
    return Store(spark, str(path / "t"), SCHEMA, ["k"], ["at", "who"])


def rows(spark, first, last, who, at=0):
    return spark.range(first, last).select(F.col("id").alias("k"), F.lit(who).alias("who"), F.lit(at).cast("long").alias("at"))


def found(s):
    return {r.k: r.who for r in s.rows().collect()}


def test_first_commit_of_a_key_wins(spark, tmp_path):
    s = store(spark, tmp_path)
    assert found(s) == {}
    assert s.append(rows(spark, 0, 5, "a")) == 1
    assert s.append(rows(spark, 3, 8, "b", 1).union(rows(spark, 6, 7, "a", 0))) == 2
    assert found(s) == {**dict.fromkeys(range(5), "a"), 5: "b", 6: "a", 7: "b"} and s.rows().count() == 8
    assert s.append(rows(spark, 0, 2, "c"), clear=True) == 3
    assert found(s) == {0: "c", 1: "c"}


def test_runs_at_once_leave_each_key_once(spark, tmp_path):
    s, start, failed = store(spark, tmp_path), threading.Barrier(4), []

    def run(i):
        try:
            start.wait()
            s.append(rows(spark, i * 10, i * 10 + 40, f"w{i}"))
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=run, args=(i,)) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    assert sorted(r.k for r in s.rows().collect()) == list(range(70))
    assert [c["number"] for c in s.commits()] == [1, 2, 3, 4]


def test_a_run_that_comes_second_looks_again(spark, tmp_path, monkeypatch):
    s, other = store(spark, tmp_path), store(spark, tmp_path)
    commit, came = Store._commit, []

    def late(self, number, batch, clear):
        if self is s and not came:
            came.append(number)
            other.append(rows(spark, 2, 6, "other"))
        commit(self, number, batch, clear)

    monkeypatch.setattr(Store, "_commit", late)
    assert s.append(rows(spark, 0, 4, "late")) == 2 and came == [1]
    assert found(s) == {0: "late", 1: "late", **dict.fromkeys(range(2, 6), "other")} and s.rows().count() == 6


def test_keys_that_another_run_clears_meanwhile_are_free(spark, tmp_path, monkeypatch):
    s, other = store(spark, tmp_path), store(spark, tmp_path)
    s.append(rows(spark, 0, 3, "old"))
    commit, came = Store._commit, []

    def late(self, number, batch, clear):
        if self is s and not came:
            came.append(number)
            other.append(rows(spark, 2, 4, "other"), clear=True)
        commit(self, number, batch, clear)

    monkeypatch.setattr(Store, "_commit", late)
    assert s.append(rows(spark, 0, 5, "late")) == 3
    assert found(s) == {0: "late", 1: "late", 2: "other", 3: "other", 4: "late"}


def test_a_run_that_fails_leaves_nothing_to_read(spark, tmp_path):
    s = store(spark, tmp_path)
    s.append(rows(spark, 0, 2, "a"))
    s._write(rows(spark, 2, 9, "never committed"))
    broken = rows(spark, 2, 9, "b").withColumn("at", F.expr("raise_error('lost')").cast("long"))
    with pytest.raises(Exception, match="lost"):
        s.append(broken)
    assert found(s) == {0: "a", 1: "a"}


def test_compaction_gives_way_to_other_runs(spark, tmp_path, monkeypatch):
    s, other = store(spark, tmp_path), store(spark, tmp_path)
    s.append(rows(spark, 0, 2, "a"))
    s.append(rows(spark, 2, 4, "b"))
    write = Store._write

    def slow(self, batch):
        name = write(self, batch)
        if self is s:
            other.append(rows(spark, 4, 5, "c"))
        return name

    with monkeypatch.context() as m:
        m.setattr(Store, "_write", slow)
        assert not s.compact()
    assert found(s) == {0: "a", 1: "a", 2: "b", 3: "b", 4: "c"}
    before = found(s)
    assert s.compact() and len(s.commits()) == 1 and found(s) == before


def test_rows_written_without_a_commit_count_first(spark, tmp_path):
    s = store(spark, tmp_path)
    rows(spark, 0, 3, "old").write.parquet(s.path)
    s.append(rows(spark, 2, 4, "new"))
    assert found(s) == {0: "old", 1: "old", 2: "old", 3: "new"}


def test_the_rename_of_other_file_systems_refuses_a_taken_name(spark, tmp_path):
    s = store(spark, tmp_path)
    (tmp_path / "t").mkdir()
    for n in ("d1", "d2"):
        (tmp_path / "t" / n).write_text(n)
    fs = s._there("d1").getFileSystem(s._conf())

    real = fs.makeQualified(s._there("x")).toUri()
    other = SimpleNamespace(exists=fs.exists, makeQualified=lambda p: SimpleNamespace(toUri=lambda: SimpleNamespace(getScheme=lambda: "other")))
    with pytest.MonkeyPatch.context() as m:
        context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext
        m.setattr(Store, "_context", lambda self, uri: context.getFileContext(real, self._conf()))
        s._place(other, s._there("d1"), s._there("x"))
        with pytest.raises(CommitLost):
            s._place(other, s._there("d2"), s._there("x"))
    assert (tmp_path / "t" / "x").read_text() == "d1"
