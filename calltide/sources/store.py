"""A table of rows with a key that several runs may append to at once, each key being kept once.

A run writes what is new to a folder of its own, which nobody reads until a commit names it. Commits are numbered files; a file
is put in its place in one step, which fails if another run has put one there. The run that comes second then looks its
rows up among what the first has added, and tries the next number. So the first commit of a key wins, a run that fails leaves
nothing that is read, and readers see whole commits only. Rows are compared by anti-joins in Spark; the driver holds the names of
the commits. The file system must refuse a rename onto a file that is there, as HDFS does.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from calltide.operators.merge import keep_first_upsert


class CommitLost(Exception):
    """Another run has taken this number."""


@dataclass
class Store:
    """Rows of ``schema`` below ``path``; of the rows of one key in one append, the first by ``order`` is kept."""

    spark: SparkSession
    path: str
    schema: str
    key: Sequence[str]
    order: Sequence[str]

    def _there(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _conf(self):
        return self.spark.sparkContext._jsc.hadoopConfiguration()

    def _listed(self, pattern: str) -> list[str]:
        there = self._there(pattern)
        found = there.getFileSystem(self._conf()).globStatus(there)
        return sorted(x.getPath().getName() for x in found or [])

    def commits(self) -> list[dict]:
        """What counts, in order: {number, batch, clear}, from the last commit on that cleared the table. Rows that were written to
        the folder itself, without a commit, are number 0."""
        names = [n for n in self._listed("_commits/*") if n.isdigit()]
        lines = self.spark.read.text([f"{self.path}/_commits/{n}" for n in names]).collect() if names else []
        told = sorted((json.loads(r.value) for r in lines), key=lambda c: c["number"])
        first = max((i for i, c in enumerate(told) if c["clear"]), default=None)
        if first is not None:
            return told[first:]
        return ([{"number": 0, "batch": "*.parquet", "clear": False}] if self._listed("*.parquet") else []) + told

    def rows(self, commits: Sequence[dict] | None = None) -> DataFrame:
        """The rows of these commits, or of all that count."""
        commits = self.commits() if commits is None else commits
        if not commits:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{c['batch']}" for c in commits))

    def _write(self, rows: DataFrame) -> str:
        batch = f"batch-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{batch}")
        return batch

    def _commit(self, number: int, batch: str, clear: bool) -> None:
        """Put commit ``number`` in its place, whole and in one step; ``CommitLost`` if it is taken."""
        name, draft = f"_commits/{number:09d}", self._there(f"_drafts/{batch}-{number}")
        fs = draft.getFileSystem(self._conf())
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({"number": number, "batch": batch, "clear": clear}).encode()))
        out.close()
        fs.mkdirs(self._there("_commits"))
        try:
            self._place(fs, draft, self._there(name))
        finally:
            fs.delete(draft, False)

    def _place(self, fs, draft, target) -> None:
        uri = fs.makeQualified(target).toUri()
        if uri.getScheme() == "file":  # a local rename would replace the file that is there; a second link never does
            try:
                os.link(fs.makeQualified(draft).toUri().getPath(), uri.getPath())
            except FileExistsError as e:
                raise CommitLost(str(target)) from e
            return
        sc = self.spark.sparkContext
        kind = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = sc._gateway.new_array(kind, 1)
        how[0] = kind.NONE
        try:
            self._context(uri).rename(draft, target, how)
        except Exception as e:
            if fs.exists(target):
                raise CommitLost(str(target)) from e
            raise

    def _context(self, uri):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, self._conf())

    def append(self, new: DataFrame, clear: bool = False) -> int:
        """Add the rows whose key the table does not hold yet, or with ``clear`` put them in the place of all others; the number of
        the commit."""
        empty = self.spark.createDataFrame([], self.schema)
        seen = [] if clear else self.commits()
        batch = self._write(keep_first_upsert(self.rows(seen) if seen else empty, new, self.key, self.order))
        while True:
            try:
                number = self._next()
                if not clear and (since := self._since(seen)):
                    over = any(c["clear"] for c in since)  # keys that were held before may be free now
                    mine = new if over else self.spark.read.schema(self.schema).parquet(f"{self.path}/{batch}")
                    seen = since if over else seen + since
                    batch = self._write(keep_first_upsert(self.rows(since), mine, self.key, self.order))
                self._commit(number, batch, clear)
                return number
            except CommitLost:
                continue

    def _next(self) -> int:
        return 1 + max((int(n) for n in self._listed("_commits/*") if n.isdigit()), default=0)

    def _since(self, seen: Sequence[dict]) -> list[dict]:
        """Commits that count and have not been looked at."""
        known = {c["number"] for c in seen}
        return [c for c in self.commits() if c["number"] not in known]

    def compact(self) -> bool:
        """Rewrite all that counts as one batch; false, and nothing done, if another run commits meanwhile."""
        number = self._next()
        commits = self.commits()
        if len(commits) < 2:
            return True
        batch = self._write(self.rows(commits))
        try:
            self._commit(number, batch, True)
        except CommitLost:
            return False
        return True
