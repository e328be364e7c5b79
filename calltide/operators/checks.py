"""Checks that a user adds: Python functions over the context of a matched call, run in Spark's workers, failing open.

A check is a function of a context, a dictionary with the parts that ``context`` lists, or a text with a function ``check``,
as rule folders have them. It answers with whether there is an alert, or with a dictionary (alert, message, confidence). The
text is compiled once in each task. A row whose check is not there, cannot be compiled, throws, or answers in another way
becomes an alert of low confidence that says so: a broken check is seen, and never hides a call or ends the run. A check that
takes whole batches gets lists by column and answers with a list; of a batch that fails, halves are tried until only the rows
that fail alone are left, so the others keep their answers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONFIDENCES = ("critical", "high", "medium", "low")


@dataclass(frozen=True)
class Check:
    """``run`` takes a context or, with ``batched``, a dictionary of lists; ``source`` is text with a function ``check``."""

    name: str
    run: Callable[[dict[str, Any]], Any] | None = None
    source: str = ""
    batched: bool = False

    def function(self) -> Callable[[dict[str, Any]], Any]:
        if self.run is not None:
            return self.run
        names: dict[str, Any] = {"__name__": self.name}
        exec(compile(self.source, self.name, "exec"), names)  # the rule's author is trusted with it, as with any job's code
        if not callable(names.get("check")):
            raise TypeError("no function check")
        return names["check"]


class Registry(dict[str, Check]):
    """Checks by name."""

    def add(self, name: str, run: Callable[[dict[str, Any]], Any], batched: bool = False) -> None:
        self[name] = Check(name, run, batched=batched)

    def add_text(self, name: str, source: str) -> None:
        self[name] = Check(name, source=source)


def load_checks(spark: SparkSession, folder: str) -> Registry:
    """The ``.py`` files of a rule folder, by file name with and without its ending; Spark reads them, so any store will do. As
    rule folders are small by nature, the driver holds them."""
    out = Registry()
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.py").select(F.col("_metadata.file_path").alias("path"), "value")
    for path, text in sorted((r.path, r.value) for r in files.collect()):
        name = path.rsplit("/", 1)[-1]
        out.add_text(name, text)
        out.add_text(name.removesuffix(".py"), text)
    return out


#: Parts of a context and the columns of a matched call that each is made of; what a row lacks is left out.
PARTS = {
    "sink": ["signature", "type", "receiver_type", "called", "method", "args", "path", "line", "seq", "text"],
    "method": ["path", "class_name", "method_name", "method_line", "is_handler"],
    "params": ["parts", "ext", "tainted", "hard_any", "hard_all", "kinds", "composite", "names"],
    "receiver": ["receiver", "receiver_ext", "receiver_tainted", "hardened", "n_prior", "n_later"],
    "chain": ["chain", "chain_source", "chain_depth", "chain_path", "chain_reason"],
}


def context(rows: DataFrame) -> Column:
    """What a check is given: the call itself (``sink``), the method around it, where arguments and receiver come from, the taint
    chain (null without one)."""
    parts = []
    for name, columns in PARTS.items():
        there = [F.col(c) for c in columns if c in rows.columns]
        if there:
            one = F.struct(*there)
            parts.append((F.when(F.col("chain").isNotNull(), one) if name == "chain" and "chain" in rows.columns else one).alias(name))
    return F.struct(F.col("rule_id"), *parts)


def verdict(answer: Any) -> tuple[bool, str | None, str | None]:
    """(alert, message, confidence) of what a check has answered; an alert without more is one of medium confidence."""
    if isinstance(answer, bool):
        return answer, None, "medium" if answer else None
    if isinstance(answer, dict) and isinstance(answer.get("alert"), bool):
        sure = answer.get("confidence")
        told = answer.get("message")
        if (sure is None or sure in CONFIDENCES) and (told is None or isinstance(told, str)):
            return answer["alert"], told, (sure or "medium") if answer["alert"] else None
    return True, "check gave no verdict", "low"


def _failed(why: Exception) -> tuple[bool, str, str]:
    return True, f"check failed: {type(why).__name__}: {why}", "low"


def _each(run: Callable[[dict[str, Any]], Any], rows: list[dict[str, Any]]) -> list[tuple[bool, str | None, str | None]]:
    out = []
    for row in rows:
        try:
            out.append(verdict(run(row)))
        except Exception as why:
            out.append(_failed(why))
    return out


def _halved(run: Callable[[dict[str, Any]], Any], rows: list[dict[str, Any]]) -> list[tuple[bool, str | None, str | None]]:
    """The answers of a check that takes batches."""
    if not rows:
        return []
    try:
        answers = list(run({k: [r[k] for r in rows] for k in rows[0]}))
        if len(answers) != len(rows):
            raise ValueError(f"{len(answers)} answers for {len(rows)} calls")
        return [verdict(a) for a in answers]
    except Exception as why:
        if len(rows) == 1:
            return [_failed(why)]
    middle = len(rows) // 2
    return _halved(run, rows[:middle]) + _halved(run, rows[middle:])


def checked(matched: DataFrame, names: dict[str, str], checks: dict[str, Check]) -> DataFrame:
    """matched (with rule_id) with ``verdict_alert``, ``verdict_message`` and ``verdict`` (its confidence), by the check that each
    rule names. Rules with a name that no check has get an alert of low confidence."""
    used = {k: checks.get(k) for k in set(names.values())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, Callable | Exception] = {}
        for name, check in used.items():
            try:
                ready[name] = check.function() if check is not None else LookupError(f"no check {name}")
            except Exception as why:
                ready[name] = why
        for batch in batches:
            contexts = batch.column("_context").to_pylist()
            asked: dict[str, list[int]] = {}
            for i, c in enumerate(contexts):
                asked.setdefault(names[c["rule_id"]], []).append(i)
            out: list[tuple[bool, str | None, str | None]] = [(False, None, None)] * len(contexts)
            for name, at in asked.items():
                rows, function = [contexts[i] for i in at], ready[name]
                if isinstance(function, Exception):
                    answers = [_failed(function)] * len(rows)
                else:
                    answers = (_halved if used[name].batched else _each)(function, rows)
                for i, a in zip(at, answers, strict=True):
                    out[i] = a
            kept = batch.drop_columns(["_context"])
            more = [pa.array([a[k] for a in out], t) for k, t in enumerate((pa.bool_(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*kept.columns, *more], names=[*kept.schema.names, "verdict_alert", "verdict_message", "verdict"])

    rows = matched.where(F.col("rule_id").isin(*names))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.withColumn("_context", context(rows)).mapInArrow(run, f"{schema}, verdict_alert boolean, verdict_message string, verdict string")
