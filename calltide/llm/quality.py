"""Operator 7: quality rules by gradient-boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled rows (``SAMPLE`` of each class, those with the least hash of
doc_id) that count as their class does among all labels, so the cut means the same at any table size; flattened to
node arrays, and sent to the tasks. The verdict never gets better as symbols, repeated words,
repeated lines, capitals or exclamation marks grow (monotonic constraints).

Defined results: null, empty or blank texts have no words and fail the base rule; repeated rows are each scored; with
no labels, or labels of one class, the trees are a constant and only the base rule decides if that class is good.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltide.llm import trees
from calltide.llm.batches import bound
from calltide.llm.tokens import shingles, slices, words

#: Labelled rows of each class that the trees are fitted on, at most.
SAMPLE = 2000
WINDOW = 8
FEATURES = ("log_words", "word_length", "symbols", "repeat_lines", "repeat_words", "capitals", "digits", "exclaims", "bars", "marks", "line_words", "distinct")
_DOWN = {"symbols", "repeat_lines", "repeat_words", "capitals", "exclaims", "bars"}
MONOTONE = np.array([-1 if f in _DOWN else 0 for f in FEATURES])
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _statistics(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(rows, 5) base counts and (rows, features) for the trees."""
    w = words(batch.column("text"))
    counts, features = np.zeros((batch.num_rows, 5), np.int64), np.zeros((batch.num_rows, len(FEATURES)))
    raw = w.data.tobytes()
    for i in range(batch.num_rows):
        a, b = w.first[i], w.first[i + 1]
        begin, end = w.offset[i], w.offset[i + 1]
        n = int(b - a)
        seen = np.bincount(w.data[begin:end], minlength=256)
        chars = int(seen[:128].sum() + seen[192:].sum() - seen[9:14].sum() - seen[32])
        symbols = int(seen[[35, 36, 37, 38, 42, 60, 62, 124]].sum())
        known: set[bytes] = set()
        lines = again = 0
        for line in raw[begin:end].split(b"\n"):
            if line.strip():
                lines += 1
                if line in known:
                    again += 1
                known.add(line)
        repeat = 0
        if n > WINDOW:
            code = shingles(w.hash[a:b], WINDOW)
            _, back, times = np.unique(code, return_inverse=True, return_counts=True)
            if times.max() > 1:
                hit = np.concatenate([(times > 1)[back], np.zeros(WINDOW, bool)]).astype(np.int64)
                cover = np.cumsum(hit - np.concatenate([np.zeros(WINDOW, np.int64), hit[:-WINDOW]]))
                repeat = int((cover[:n] > 0).sum())
        counts[i] = n, chars, symbols, again, repeat
        c, m = max(chars, 1), max(n, 1)
        features[i] = (
            np.log1p(n), chars / m, symbols / c, again / max(lines, 1), repeat / m, seen[65:91].sum() / c, seen[48:58].sum() / c, seen[33] / c, seen[124] / c,
            (seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum()) / c, n / max(lines, 1), len(np.unique(w.hash[a:b])) / m,
        )
    return counts, features


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept) of each row."""
    forest, rows = _fitted(docs, labels), docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, failed, good = _verdict(batch, forest)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(counts[:, j]) for j in range(5)), pa.array(failed), pa.array(good), pa.array(~failed & (good >= 0.5))],
                names=["doc_id", *_COUNTS, "base_failed", "score", "kept"],
            )

    return rows.mapInArrow(score, "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", base_failed boolean, score double, kept boolean")


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    forest = _fitted(docs, labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            _, failed, good = _verdict(batch, forest)
            yield batch.filter(pa.array(~failed & (good >= 0.5)))

    return docs.mapInArrow(keep, docs.schema)


def _verdict(batch: pa.RecordBatch, forest: trees.Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base counts, base failure and score of each row."""
    counts, x = _statistics(batch)
    return counts, (counts[:, 0] < 20) | (100 * counts[:, 4] > 30 * counts[:, 0]), forest.score(x)


def _fitted(docs: DataFrame, labels: DataFrame) -> trees.Forest:
    """The trees, fitted on the labelled sample; each class weighs as much as all its labels do."""
    bound(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    pick = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).withColumn("h", F.xxhash64("doc_id"))
    counts = {int(r.quality): r["count"] for r in pick.where("quality in (0, 1)").groupBy("quality").count().collect()}
    some = lambda q: pick.where(F.col("quality") == q).orderBy("h", "doc_id").limit(SAMPLE)
    sample = F.broadcast(some(0).union(some(1)).select("doc_id", "quality"))  # 2 * SAMPLE rows at most

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            _, x = _statistics(batch)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column("quality").cast(pa.int32())], names=["x", "y"])

    rows = docs.join(sample, "doc_id").select("text", "quality").mapInArrow(gather, "x array<double>, y int").collect()
    x = np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES))
    order = np.lexsort(x.T)
    y = np.array([r.y for r in rows], dtype=float)[order]
    weight = np.where(y == 1, counts.get(1, 0) / max(y.sum(), 1), counts.get(0, 0) / max((1 - y).sum(), 1))
    return trees.fit(x[order], y, MONOTONE, weight=weight / weight.mean() if len(y) else None)
