"""Operator 6: substring dedup by paragraph MinHash banding.

A paragraph here is a sentence or a line without one: it ends at a line feed or after a word that ends in a full stop, question
or exclamation mark (``ENDS``). So a passage set into the middle of other text still stands as paragraphs of its own. A
sentence of fewer than ``LEAST`` words, which has no shingle, is part of the one before it on its line, or of the next at the
beginning of a line. Equal paragraphs (by their lower-case words) are one node; each node gets MinHash bands over its
five-word shingles, with bands tuned so that pairs at the threshold share one with probability ``RECALL`` or more.
Paragraphs that share a band are joined, their exact Jaccard similarity is verified on whole shingle sets, and verified
pairs are clustered into components (see ``simjoin``). Of each class, the first occurrence (least doc_id, then place)
stays; of rows with one doc_id, that of the least text hash.

With ``verbatim``, runs of words that repeat word for word are found too, whatever their sentences and borders. Each text
keeps as anchors the sequences of ``ANCHOR`` words with the least hash of any ``WINDOW`` neighbouring ones, so two equal
runs of ANCHOR + WINDOW - 1 = 50 words or more have an anchor in common. An anchor that stands at a lesser (doc_id, text's
hash, place) too is a repeat of the least such place; neighbouring anchors join, as they overlap, and both ends grow word by
word while the words equal those around that place. Where a longer copy is elsewhere than the least place, fewer than
WINDOW words at an end can stay.

Repeats that touch or overlap make a run; a run of ``run`` words or more is removed. Runs hold repeated words only: what lies
between two repeats stays. ``run`` says what counts as a repeated passage: a shared line or phrase below it does not.

Defined results: null and empty texts have no paragraphs; repeated rows (doc_id and text) share one result; a null
doc_id comes after all others; places are code points, end exclusive; other columns are kept by ``deduplicated`` and
ignored by ``removals``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calltide.llm import simjoin
from calltide.llm.batches import bound
from calltide.llm.filters import sized
from calltide.llm.tokens import U, mix, sequences, shingles, signed, slices, words
from calltide.session import Scratch

SIZE, PERCENT, RECALL, HASHES = 5, 80, 0.997, 12
#: Words of a paragraph, at least: fewer have no shingle. Words of a removed run, at least.
LEAST, RUN = SIZE, 24
#: What ends a sentence: ASCII marks, and the full stops and marks of other scripts as three UTF-8 bytes.
ENDS = b".?!"
WIDE_ENDS = tuple(x.encode() for x in "\u3002\uff01\uff1f\u0964")
#: Words of an anchor, and anchors' choice: 50 equal words have one in common, and neighbouring anchors overlap.
ANCHOR, WINDOW = 26, 25
_LAST = (1 << 63) - 1


def tuned(percent: int = PERCENT, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band that still find pairs at the threshold with the recall asked for."""
    fit = [r for r in range(1, hashes + 1) if 1 - (1 - (percent / 100) ** r) ** (hashes // r) >= recall]
    if not fit:
        raise ValueError("too few hashes for this recall")
    return hashes // max(fit), max(fit)


class Paragraphs:
    """Paragraphs of a batch: row, words (first, last), those counted inside their text (word, to_word), node."""

    def __init__(self, batch: pa.RecordBatch):
        w = self.words = words(batch.column("text"), lower=True)
        n = len(w.start)
        row = np.repeat(np.arange(batch.num_rows), np.diff(w.first))
        line = np.cumsum(w.data == 10)[w.start] if n else row
        opens = np.ones(n, dtype=bool)
        opens[1:] = (row[1:] != row[:-1]) | (line[1:] != line[:-1])
        fresh = opens.copy()
        fresh[1:] |= self._ends(w)[:-1]
        first = np.flatnonzero(fresh)
        short = np.diff(np.append(first, n)) < LEAST
        head = opens[first]
        apart = head | ~short
        apart[1:] &= head[1:] | ~(head[:-1] & short[:-1])  # what follows a short head of its line is part of it
        first = first[apart]
        last = np.append(first[1:], n)
        keep = last - first >= LEAST
        self.first, self.last = first[keep], last[keep]
        self.row = row[self.first]
        self.word, self.to_word = self.first - w.first[self.row], self.last - w.first[self.row]
        self.node = signed(sequences(w.hash, self.first, self.last))

    @staticmethod
    def _ends(w) -> np.ndarray:
        if not len(w.end):
            return np.zeros(0, dtype=bool)
        last = [w.data[np.maximum(w.end - k, 0)].astype(np.int64) for k in (1, 2, 3)]
        wide = [int.from_bytes(x, "big") for x in WIDE_ENDS]
        return np.isin(last[0], np.frombuffer(ENDS, np.uint8)) | np.isin(last[0] | last[1] << 8 | last[2] << 16, wide)


def _bands(bands: int, rows: int) -> Callable:
    seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * U(0xD6E8FEB86659FD93))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            p = Paragraphs(batch)
            _, one = np.unique(p.node, return_index=True)
            # sets of n shingles that differ have a similarity of n / (n + 1) at most: the shortest are linked with equal ones only
            one = one[100 * (p.last - p.first)[one] - 100 * (SIZE - 1) >= PERCENT * ((p.last - p.first)[one] - SIZE + 2)]
            if not len(one):
                continue
            first, count = p.first[one], p.last[one] - p.first[one] - SIZE + 1
            head = np.concatenate([[0], np.cumsum(count)[:-1]])
            grams = shingles(p.words.hash, SIZE)[np.repeat(first - head, count) + np.arange(count.sum())]
            low = [np.minimum.reduceat((grams ^ s) * (s | U(1)), head) for s in seeds]
            sig = []
            for b in range(bands):
                code = np.full(len(one), b + 1, dtype=np.uint64)
                for k in range(rows):
                    code = mix(code ^ low[b * rows + k])
                sig.append(code)
            yield simjoin.local_stars(signed(np.concatenate(sig)), np.tile(p.node[one], bands))

    return of


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        p = Paragraphs(batch)
        raw = p.words.data.tobytes()
        _, one = np.unique(p.node, return_index=True)
        begin, end = p.words.start[p.first[one]], p.words.end[p.last[one] - 1]
        yield pa.RecordBatch.from_arrays([pa.array(p.node[one]), pa.array([raw[a:b].decode() for a, b in zip(begin, end, strict=True)], pa.string())], names=["node", "text"])


def _sliding(x: np.ndarray, of: np.ufunc) -> np.ndarray:
    """``of`` over every WINDOW neighbours, at the first of them."""
    have, size = x, 1
    while 2 * size <= WINDOW:
        have, size = of(have[:-size], have[size:]), 2 * size
    return of(have[: len(x) - WINDOW + 1], have[WINDOW - size :]) if size < WINDOW else have


def _anchors(w) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word of the batch, gram) of a batch's anchors."""
    none = np.zeros(0, dtype=np.int64)
    n = len(w.hash) - ANCHOR + 1
    if n < WINDOW:
        return none, none, none
    row = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    at = np.arange(n)
    code = sequences(w.hash, at, at + ANCHOR)
    least = _sliding(code, np.minimum)
    whole = row[: len(least)] == row[ANCHOR + WINDOW - 2 :]  # windows inside one text
    edge = np.zeros(WINDOW - 1, dtype=np.uint64)
    best = _sliding(np.concatenate([edge, np.where(whole, least, U(0)), edge]), np.maximum)
    at = np.flatnonzero((best == code) & (best > 0))
    return row[at], at, signed(mix(code[at] ^ U(0xA11C0)))


def _pieces(anchors: bool) -> Callable:
    """(__id, __th, code, anchor, word, to_word): paragraphs, and anchors if wanted."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            p = Paragraphs(batch)
            parts = [(p.row, p.node, np.zeros(len(p.row), bool), p.word, p.to_word)]
            if anchors:
                row, at, gram = _anchors(p.words)
                word = at - p.words.first[row]
                parts.append((row, gram, np.ones(len(row), bool), word, word + ANCHOR))
            row, *rest = (np.concatenate(x) for x in zip(*parts, strict=True))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("__id").take(take), batch.column("__th").take(take), *map(pa.array, rest)], names=["__id", "__th", "code", "anchor", "word", "to_word"])

    return of


def _codes(anchors: bool) -> Callable:
    """(code, p, q) of a batch: the least and the greatest place of each paragraph and anchor."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(anchors)(batches):
            key = mix(batch.column("__id").to_numpy().view(U) ^ mix(batch.column("__th").to_numpy().view(U) + batch.column("word").to_numpy().view(U)))
            code, place = batch.column("code").to_numpy(), signed(key)
            order = np.argsort(code)
            code, place = code[order], place[order]
            head = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
            if len(head):
                yield pa.RecordBatch.from_arrays([pa.array(code[head]), pa.array(np.minimum.reduceat(place, head)), pa.array(np.maximum.reduceat(place, head))], names=["code", "p", "q"])

    return of


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each wish (twice the word ``at``, and the side) of a text: the hashes of WINDOW words at most before (side 0) or from (side 1) the word ``at``,
    going away from it."""
    for batch in slices(batches):
        w = words(batch.column("text"), lower=True)
        code = signed(w.hash)
        rows, side, at, near = [], [], [], []
        for i, wishes in enumerate(batch.column("wishes").to_pylist()):
            a, b = w.first[i], w.first[i + 1]
            for wish in wishes:
                p = a + (wish >> 1)
                near.append(code[p : min(b, p + WINDOW)] if wish & 1 else code[max(a, p - WINDOW) : p][::-1])
                rows.append(i)
                side.append(wish & 1)
                at.append(wish >> 1)
        take = pa.array(rows, pa.int64())
        lists = pa.array(near, pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("__id").take(take), batch.column("__th").take(take), pa.array(side, pa.int64()), pa.array(at, pa.int64()), lists], names=["__id", "__th", "side", "at", "near"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("__id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__th"))


def _again(hits: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """Hits other than the least of their key, with its place (f_id, f_th, f_word)."""
    first = hits.groupBy(key).agg(F.count("*").alias("n"), F.min(F.struct("__id", "__th", "word")).alias("at")).where("n > 1")
    first = scratch.keep(first.select(key, F.col("at.__id").alias("f_id"), F.col("at.__th").alias("f_th"), F.col("at.word").alias("f_word")))
    found = hits.join(first, key)
    return found.where(~((F.col("__id") == F.col("f_id")) & (F.col("__th") == F.col("f_th")) & (F.col("word") == F.col("f_word"))))


def _verbatim(docs: DataFrame, hits: DataFrame, scratch: Scratch) -> DataFrame:
    """(__id, __th, word, to_word, first): runs of anchors that repeat what stands at a lesser place, grown at both ends."""
    again = _again(hits, "code", scratch).withColumn("shift", F.col("word") - F.col("f_word"))
    again = again.where(~((F.col("__id") == F.col("f_id")) & (F.col("__th") == F.col("f_th")) & (F.col("shift") < ANCHOR)))  # a copy does not overlap what stays
    w = Window.partitionBy("__id", "__th").orderBy("word")
    before = F.max("word").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = again.withColumn("opens", F.when(F.col("word") <= before + ANCHOR, 0).otherwise(1)).withColumn("run", F.sum("opens").over(w))
    # inside a run anchors overlap or touch, whatever they repeat: its first one is grown backwards, its last one forwards
    place = F.struct("word", "shift", "f_id", "f_th")
    runs = runs.groupBy("__id", "__th", "run").agg(F.min_by(place, "word").alias("b"), F.max_by(place, "word").alias("e"), F.collect_set("f_id").alias("firsts"))
    runs = scratch.keep(runs)
    edge = lambda side, c, more: F.struct(F.lit(side).cast("long").alias("side"), (F.col(f"{c}.word") + more).alias("at"), (F.col(f"{c}.word") + more - F.col(f"{c}.shift")).alias("f_at"), f"{c}.f_id", f"{c}.f_th")
    edges = runs.select("__id", "__th", "run", F.explode(F.array(edge(0, "b", 0), edge(1, "e", ANCHOR))).alias("x"))
    edges = scratch.keep(edges.select("__id", "__th", "run", "x.f_id", "x.f_th", "x.side", "x.at", "x.f_at"))
    wishes = edges.select("__id", "__th", "side", "at").union(edges.select("f_id", "f_th", "side", "f_at")).distinct()
    wishes = scratch.keep(wishes.groupBy("__id", "__th").agg(F.collect_list(F.col("at") * 2 + F.col("side")).alias("wishes")))
    found = docs.join(sized(wishes), ["__id", "__th"]).mapInArrow(_sides, "__id long, __th long, side long, at long, near array<long>")
    found = scratch.keep(found.dropDuplicates(["__id", "__th", "side", "at"]))
    theirs = found.select(F.col("__id").alias("f_id"), F.col("__th").alias("f_th"), "side", F.col("at").alias("f_at"), F.col("near").alias("f_near"))
    ends = edges.join(found, ["__id", "__th", "side", "at"]).join(theirs, ["f_id", "f_th", "side", "f_at"])
    differs = F.array_position(F.zip_with("near", "f_near", lambda x, y: F.coalesce(x != y, F.lit(True))), True)
    more = F.when(differs > 0, differs - 1).otherwise(F.size("near"))
    of = lambda side, c: F.max(F.when(F.col("side") == side, c))
    grown = ends.groupBy("__id", "__th", "run").agg(of(0, F.col("at") - more).alias("word"), of(1, F.col("at") + more).alias("to_word"))
    # a run may repeat several texts, one behind the other: each of them is a link
    return grown.join(runs.select("__id", "__th", "run", F.explode("firsts").alias("first")), ["__id", "__th", "run"]).drop("run")


def repeats(docs: DataFrame, scratch: Scratch, verbatim: bool = False) -> DataFrame:
    """(__id, __th, word, to_word, first): paragraphs, and verbatim runs, that stand at a lesser place too; __id and __th
    are the key of a row (see ``_keyed``), first is the __id where the repeat stays."""
    bound(docs.sparkSession)
    docs = _keyed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).drop("doc_id")

    def payload(nodes: DataFrame) -> DataFrame:
        return docs.mapInArrow(_texts, "node long, text string").join(sized(nodes), "node", "left_semi").dropDuplicates(["node"])

    comps = simjoin.classes(docs.select("text").mapInArrow(_bands(*tuned()), "sig long, a long, b long"), payload, SIZE, PERCENT, scratch)
    known = docs.mapInArrow(_codes(verbatim), "code long, p long, q long").groupBy("code").agg(F.min("p").alias("p"), F.max("q").alias("q"))
    known = known.where("p <> q").select("code").union(comps.select("node")).distinct()
    known = scratch.keep(known)
    scratch.release()
    pieces = docs.mapInArrow(_pieces(verbatim), "__id long, __th long, code long, anchor boolean, word long, to_word long")
    hits = scratch.keep(pieces.join(sized(known), "code", "left_semi").distinct())
    same = hits.where("not anchor").join(comps.withColumnRenamed("node", "code"), "code", "left").withColumn("class", F.coalesce("comp", "code"))
    found = _again(same, "class", scratch).select("__id", "__th", "word", "to_word", F.col("f_id").alias("first"))
    if verbatim:
        found = found.union(_verbatim(docs, hits.where("anchor"), scratch).select(found.columns))
    return found


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(__id, __th, spans) of texts with runs (2 ** 32 times the first word, and the one behind the last) in order: the code points
    that these take."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in slices(batches):
        w = words(batch.column("text"), lower=True)
        points = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
        out = []
        for i, runs in enumerate(batch.column("runs").to_pylist()):
            a, zero = w.first[i], points[w.offset[i]]
            out.append([{"start": points[w.start[a + (r >> 32)]] - zero, "end": points[w.end[a + (r & 0xFFFFFFFF) - 1]] - zero} for r in runs])
        yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__th"), pa.array(out, kind)], names=["__id", "__th", "spans"])


def removals(docs: DataFrame, verbatim: bool = False, run: int = RUN) -> DataFrame:
    """(__id, __th, spans, firsts) of each text with runs to remove: their code points in order, and the __ids where what they
    repeat stays."""
    scratch = Scratch(docs.sparkSession)
    w = Window.partitionBy("__id", "__th").orderBy("word", "to_word")
    before = F.max("to_word").over(w.rowsBetween(Window.unboundedPreceding, -1))
    found = repeats(docs, scratch, verbatim).withColumn("opens", F.when(F.col("word") <= before, 0).otherwise(1)).withColumn("run", F.sum("opens").over(w))
    runs = found.groupBy("__id", "__th", "run").agg(F.min("word").alias("word"), F.max("to_word").alias("to_word"), F.collect_set("first").alias("firsts"))
    runs = runs.where(F.col("to_word") - F.col("word") >= run).groupBy("__id", "__th")
    runs = scratch.keep(runs.agg(F.array_sort(F.collect_list(F.shiftleft("word", 32) + F.col("to_word"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("firsts")))).alias("firsts")))
    texts = _keyed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).drop("doc_id").join(sized(runs.select("__id", "__th", "runs")), ["__id", "__th"])
    spans = texts.mapInArrow(_spans, "__id long, __th long, spans array<struct<start: bigint, end: bigint>>").dropDuplicates(["__id", "__th"])
    gone = scratch.keep(spans.join(runs.select("__id", "__th", "firsts"), ["__id", "__th"]))
    scratch.drop(gone)
    scratch.release()
    return gone


def substring_dedup(docs: DataFrame, verbatim: bool = False) -> DataFrame:
    """(doc_id, repeated, n_removed, removed, kept_in) of each row: removed lists start:end of the removed runs in order,
    kept_in the doc_ids where what they repeat stays."""
    rows = _keyed(docs.select("doc_id", "text")).select("doc_id", "__id", "__th").join(removals(docs, verbatim), ["__id", "__th"], "left")
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = F.when(F.col("spans").isNull(), 0).otherwise(F.size("spans")).cast("long").alias("n_removed")
    kept_in = F.coalesce("firsts", F.array().cast("array<bigint>")).alias("kept_in")
    return rows.select("doc_id", F.col("spans").isNotNull().alias("repeated"), count, F.coalesce(joined, F.lit("")).alias("removed"), kept_in)


def deduplicated(docs: DataFrame, verbatim: bool = False) -> DataFrame:
    """docs with the removed runs cut out of ``text``; every column is kept."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}  # no column of docs can clash with the keys
    plain = _keyed(docs.select(F.col("doc_id"), F.col("text"), F.struct("*").alias("__row"))).select("text", "__row", "__id", "__th")
    rows = plain.join(removals(docs, verbatim).select("__id", "__th", F.col("spans").alias("__spans")), ["__id", "__th"], "left")
    kept = F.expr(
        "concat(array_join(transform(__spans, (s, i) -> substring(text, if(i = 0, 0, __spans[i - 1].end) + 1, s.start - if(i = 0, 0, __spans[i - 1].end))), ''),"
        " substring(text, element_at(__spans, -1).end + 1))"
    )
    kept = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(kept)
    return rows.select(*((kept if c == "text" else F.col("__row").getField(c)).alias(names[c]) for c in docs.columns)).toDF(*docs.columns)
