"""Operator 2: toxicity by class-conditional Kneser-Ney models.

Words and word pairs of all labelled texts are counted by class, each once a text, as texts repeat themselves. For each class
an interpolated Kneser-Ney model gives the likelihood of a word after the one before it: pair counts less a discount (between
0 and 1, from how many pairs are seen once and twice), what that frees going to the word's continuation counts (after how many
different words it is seen in the class) less their discount, and what that frees to the continuation counts of both classes
together, which so smooth rare expressions. A pair that neither class has is told by its word alone.

Every counted word and pair scores. As few words of a toxic text are toxic, each is taken to be of the toxic model with
probability ``MIX``, else of the ordinary one: log((1 - MIX) p0 + MIX p1) - log(p0), which bounds what the many pairs met once
or twice say for ordinary text and leaves what is strong. Its mean over a text's words (the length-normalised difference of the two
log-likelihoods) is taken of the pair models and of the word models that they back off to; the score is a logistic function of
both.

Learning takes labelled rows with crc32(doc_id as text) mod 5 <> 0 only, equal texts once. All of them are counted. A model
of three quarters of them gives the differences of ``SAMPLE`` texts of each class at most from the last quarter, on which the
logistic function is fitted; a model of all of them scores. Labels, lang, source and doc_id are never inputs of a score.

Words that fewer than ``LEAST`` texts have are one unknown word. Counts, contexts and likelihoods are made in Spark. Tasks hold the
known words (24 bytes each) and the ``BROADCAST`` pairs at most that most texts have; all other pairs stay a table that the
texts' pairs are joined with, but for those that a bit map of 16 MB at most rules out. Both give the same scores.

Defined results: null and empty texts get the score of a text without evidence; repeated rows are each scored; a null
doc_id counts as held out; other columns are ignored; labels that are null or neither 0 nor 1 are no labels; with labels of
one class or none, every score is that class's smoothed share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltide.llm.batches import bound
from calltide.llm.collocations import bit_map
from calltide.llm.filters import BROADCAST as KEYS
from calltide.llm.filters import sized
from calltide.llm.tokens import mix, signed, slices, words
from calltide.session import Scratch

SAMPLE, PARTS, LEAST, MIX = 4000, 4, 3, 0.03
#: Pairs that every task holds, at most.
BROADCAST = 2_000_000
#: For ``tells``.
G2, MARGIN = 10.83, 1.0
#: Ids of words that are not known, and of the beginning of a text.
OTHER, BEGIN = 0, 1
#: Counts by model (0: without the last part; 1: all) and class.
NAMES = tuple((m, c) for m in (0, 1) for c in (0, 1))


def _numbered(batch: pa.RecordBatch, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id of the word before, id of the word, row) of every word; ``known`` is sorted and its k-th word has the id k + 2."""
    w = words(batch.column("text"), lower=True, letters=True)
    at = np.minimum(np.searchsorted(known, w.hash), max(len(known) - 1, 0))
    ids = np.where(known[at] == w.hash, at + 2, OTHER) if len(known) else np.zeros(len(w.hash), np.int64)
    before = np.full(len(ids), BEGIN)
    before[1:] = ids[:-1]
    before[w.first[:-1][np.diff(w.first) > 0]] = BEGIN
    return before, ids, np.repeat(np.arange(batch.num_rows), np.diff(w.first))


def _counted(batch: pa.RecordBatch, key: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
    """(key, c00, c01, c10, c11): in how many texts of each model and class the keys of a batch are."""
    order = np.lexsort((row, key))
    key, row = key[order], row[order]
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    key, row = key[fresh], row[fresh]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    toxic, part = (batch.column(c).to_numpy()[row] for c in ("toxic", "part"))
    of = lambda m, c: np.add.reduceat(((toxic == c) & ((part > 0) | (m == 1))).astype(np.int64), head) if len(head) else head
    return pa.RecordBatch.from_arrays([pa.array(key[head]), *(pa.array(of(m, c)) for m, c in NAMES)], names=["key", *(f"c{m}{c}" for m, c in NAMES)])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        w = words(batch.column("text"), lower=True, letters=True)
        yield _counted(batch, signed(w.hash), np.repeat(np.arange(batch.num_rows), np.diff(w.first)))


def _pairs(known: Broadcast) -> Callable:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            u, w, row = _numbered(batch, known.value)
            yield _counted(batch, u << 32 | w, row)

    return of


def tells(c0: Column, c1: Column, n0: int, n1: int) -> Column:
    """Whether the counts c0 of n0 texts and c1 of n1 tell the classes apart. No part of the score: a test still sets this name."""
    n, c = n0 + n1, c0 + c1
    part = lambda x, e: F.when(x > 0, x * F.ln(x / e)).otherwise(F.lit(0.0))
    g2 = 2 * (part(c0, c * n0 / n) + part(c1, c * n1 / n) + part(n0 - c0, (n - c) * n0 / n) + part(n1 - c1, (n - c) * n1 / n))
    return (c >= LEAST) & (g2 >= G2) & (F.abs(F.ln(((c1 + 0.5) / n1) / ((c0 + 0.5) / n0))) >= MARGIN)


def _discount(ones: float, twos: float) -> float:
    return min(max(ones / max(ones + 2 * twos, 1), 0.05), 0.95)


class Ratios:
    """Log-likelihood ratios: of known words by id, and of the pairs that tasks hold."""

    def __init__(self, known: np.ndarray, word: np.ndarray, pairs: np.ndarray, pair: np.ndarray):
        order = np.argsort(pairs)
        self.known, self.word = known, word
        self.pairs, self.pair = np.append(pairs[order], np.int64((1 << 63) - 1)), np.append(pair[order], 0.0)

    def of(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, pair, whether it is held, log ratio of the word, and of it after the one before) of every word."""
        u, w, row = _numbered(batch, self.known)
        key = u << 32 | w
        at = np.searchsorted(self.pairs, key)
        held = self.pairs[at] == key
        return row, key, held, self.word[w], np.where(held, self.pair[at], self.word[w])

    def mean(self, batch: pa.RecordBatch) -> np.ndarray:
        """Length-normalised difference of the log-likelihoods of each text, all of whose pairs are held."""
        row, _, _, _, ratio = self.of(batch)
        return np.bincount(row, ratio, batch.num_rows) / np.maximum(np.bincount(row, minlength=batch.num_rows), 1)


@dataclass
class Model:
    """What tasks hold; the other pairs (key, more), by how much each says more than its word; the bit map of these."""

    ratios: Broadcast
    rest: DataFrame | None = None
    may: Broadcast | None = None

    def mean(self, batch: pa.RecordBatch) -> np.ndarray:
        return self.ratios.value.mean(batch)


def mixed(ratio: np.ndarray) -> np.ndarray:
    return np.log(1 - MIX + MIX * np.exp(ratio))


def _heads(ratios: Broadcast, may: Broadcast | None, kept: list[str]) -> Callable:
    """The ``kept`` columns, a text's two means, and which share of its words is asked of the other pairs."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row, key, held, word, pair = ratios.value.of(batch)
            asked = np.zeros(len(key)) if may is None else ~held & may.value(mix(key.view(np.uint64)))
            n = np.maximum(np.bincount(row, minlength=batch.num_rows), 1)
            means = [np.bincount(row, x, batch.num_rows) / n for x in (mixed(word), mixed(pair), asked)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, means)], names=[*kept, "by_word", "by_pair", "asked"])

    return heads


def _asked(ratios: Broadcast, may: Broadcast) -> Callable:
    """(th, key): words whose pair the other pairs may have, one row each."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row, key, held, _, _ = ratios.value.of(batch)
            use = ~held & may.value(mix(key.view(np.uint64)))
            yield pa.RecordBatch.from_arrays([batch.column("th").take(pa.array(row[use])), pa.array(key[use])], names=["th", "key"])

    return asked


def _means(rows: DataFrame, model: Model) -> DataFrame:
    """rows with (by_word, by_pair) in place of their text. Equal texts ask the same, so a mean over all that they ask is right."""
    rows = rows.withColumn("th", F.xxhash64("text"))
    kept = [c for c in rows.columns if c != "text"]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept) + ", by_word double, by_pair double, asked double"
    heads = rows.mapInArrow(_heads(model.ratios, model.may, kept), schema)
    if model.rest is None:
        return heads.drop("th", "asked")
    found = rows.select("th", "text").mapInArrow(_asked(model.ratios, model.may), "th long, key long").join(model.rest, "key", "left")
    more = found.groupBy("th").agg(F.avg(F.coalesce("more", F.lit(0.0))).alias("more"))
    by_pair = F.col("by_pair") + F.coalesce(F.col("asked") * F.col("more"), F.lit(0.0))
    return heads.join(more, "th", "left").withColumn("by_pair", by_pair).drop("th", "asked", "more")


def _features(by_word: np.ndarray, by_pair: np.ndarray) -> np.ndarray:
    mean = np.column_stack([by_word, by_pair])
    return np.sign(mean) * np.log1p(200 * np.abs(mean))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge-penalised weighted logistic regression by Newton steps; the last coefficient is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    beta, ridge = np.zeros(x.shape[1]), np.diag([0.01] * (x.shape[1] - 1) + [1e-6]) * weight.sum() / 100
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    spark = docs.sparkSession
    bound(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    rows = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic")).where(~held)
    shares = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = (shares.get(1, 0) + 1) / (sum(shares.values()) + 2)
    none = np.zeros(0, np.int64)
    beta, model = np.array([0.0, 0.0, np.log(share / (1 - share))]), None
    if len(shares) == 2:
        beta, model = _learn(docs, rows, shares) or (beta, model)
    if model is None:
        model = Model(spark.sparkContext.broadcast(Ratios(none.astype(np.uint64), np.zeros(2), none, none.astype(float))))
    beta = spark.sparkContext.broadcast(beta)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _features(*(batch.column(c).to_numpy() for c in ("by_word", "by_pair")))
            p = 1 / (1 + np.exp(-(x @ beta.value[:-1] + beta.value[-1])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return _means(docs.select("doc_id", held.alias("held_out"), "text"), model).mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def _labelled(docs: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(text, toxic, part): labelled texts, equal ones once and toxic if one of them is."""
    hashed = docs.join(sized(rows), "doc_id").select("doc_id", "toxic", F.xxhash64("text").alias("th"))
    once = scratch.keep(hashed.groupBy("th").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")))
    found = docs.join(sized(once), "doc_id").where(F.xxhash64("text") == F.col("th"))
    return found.select("text", "toxic", F.pmod(F.shiftright("th", 7), F.lit(PARTS)).cast("long").alias("part"))


def _learn(docs: DataFrame, rows: DataFrame, shares: dict[int, int]) -> tuple[np.ndarray, Model] | None:
    """(coefficients, model); none without texts of both classes. The driver gets the known words and what tasks hold."""
    scratch = Scratch(docs.sparkSession)
    texts = _labelled(docs, rows, scratch)
    counts = [f"c{m}{c}" for m, c in NAMES]
    schema = "key long, " + ", ".join(f"{c} long" for c in counts)
    sums = [F.sum(c).alias(c) for c in counts]
    if {r.toxic for r in texts.select("toxic").distinct().collect()} != {0, 1}:
        scratch.drop()
        return None
    vocabulary = texts.mapInArrow(_words, schema).groupBy("key").agg(*sums).where(F.col("c10") + F.col("c11") >= LEAST)
    hashes = np.sort(vocabulary.select("key").toArrow()["key"].to_numpy().view(np.uint64))
    known = docs.sparkSession.sparkContext.broadcast(hashes)
    kept = scratch.keep(texts.mapInArrow(_pairs(known), schema).groupBy("key").agg(*sums).sortWithinPartitions("key"))  # sorted keys are written shorter
    known.destroy()
    scratch.release()
    pairs = kept.withColumns({"u": F.shiftright("key", 32).cast("int"), "w": F.col("key").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")})
    small = F.broadcast if len(hashes) <= KEYS else lambda df: df
    words_of = _word_likelihoods(pairs, len(hashes) + 2, scratch)
    seen = pairs.agg(*(F.count_if(F.col(c) == k).alias(f"{c}_{k}") for c in counts for k in (1, 2))).first()
    off = {c: _discount(seen[f"{c}_1"], seen[f"{c}_2"]) for c in counts}
    kinds = [F.count_if(F.col(c) > 0).alias(f"k{c}") for c in counts]
    contexts = scratch.keep(pairs.groupBy("u").agg(*(F.sum(c).alias(f"n{c}") for c in counts), *kinds))
    n = F.col("c10") + F.col("c11")
    least, total = 1, 0
    for r in pairs.groupBy(F.least(n, F.lit(1000)).alias("n")).agg(F.count("*").alias("pairs")).orderBy(F.desc("n")).collect():
        total += r.pairs
        if total > BROADCAST:
            least = r.n + 1
            break

    def ratios(m: int, where: Column) -> DataFrame:
        """(key, pair, word): log ratios of the pairs of model m, and of their words."""
        p = {}
        for c in (f"c{m}0", f"c{m}1"):
            free = F.when(F.col(f"n{c}") > 0, off[c] * F.col(f"k{c}") / F.col(f"n{c}")).otherwise(F.lit(1.0))  # 1 where the context is new
            p[c] = F.greatest(F.col(c) - off[c], F.lit(0.0)) / F.greatest(F.col(f"n{c}"), F.lit(1)) + free * F.col(f"p{c}")
        some = pairs.where(where & (F.col(f"c{m}0") + F.col(f"c{m}1") > 0)).join(small(words_of.select("w", f"pc{m}0", f"pc{m}1")), "w").join(small(contexts.select("u", *(f"{k}c{m}{c}" for k in "nk" for c in (0, 1)))), "u")
        return some.select("key", F.ln(p[f"c{m}1"] / p[f"c{m}0"]).alias("pair"), F.ln(F.col(f"pc{m}1") / F.col(f"pc{m}0")).alias("word"))

    may = bit_map(pairs.where(n < least).select("key"), lambda b: mix(b.column(0).to_numpy().view(np.uint64))) if least > 1 else None
    scratch.release()
    models = []
    for m in (0, 1):
        told = words_of.select("w", F.ln(F.col(f"pc{m}1") / F.col(f"pc{m}0")).alias("word")).toArrow()
        word = np.zeros(len(hashes) + 2)
        word[told["w"].to_numpy()] = told["word"].to_numpy()
        often = ratios(m, n >= least).select("key", "pair").toArrow()
        held = docs.sparkSession.sparkContext.broadcast(Ratios(hashes, word, often["key"].to_numpy(), often["pair"].to_numpy()))
        level = lambda x: F.ln(F.lit(1 - MIX) + F.lit(MIX) * F.exp(x))
        rest = None if may is None else ratios(m, n < least).select("key", (level(F.col("pair")) - level(F.col("word"))).alias("more"))
        models.append(Model(held, rest, may))
    scratch.release()

    last = texts.where("part = 0").withColumn("order", F.xxhash64("text"))
    some = lambda k: last.where(F.col("toxic") == k).select("order").orderBy("order").limit(SAMPLE)
    chosen = last.join(F.broadcast(some(0).union(some(1)).distinct()), "order", "left_semi")  # 2 * SAMPLE numbers at most
    found = scratch.keep(_means(chosen.select("text", "toxic"), models[0])).toPandas().sort_values(["by_word", "by_pair", "toxic"])  # 2 * SAMPLE rows at most
    y = found["toxic"].to_numpy(float)
    models[0].ratios.destroy()
    model = models.pop()
    models.clear()
    if not len(y) or y.min() == y.max():
        scratch.drop()
        return None
    scratch.drop(*(() if model.rest is None else (kept, words_of, contexts)))
    scratch.release()
    weight = np.where(y == 1, shares[1] / max(y.sum(), 1), shares[0] / max((1 - y).sum(), 1))
    return _logistic(_features(found["by_word"].to_numpy(), found["by_pair"].to_numpy()), y, weight / weight.mean()), model


def _word_likelihoods(pairs: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """(w, pc00, ..): of words by continuation counts, backing off to those of both classes; ``size`` words in all."""
    counts = [f"c{m}{c}" for m, c in NAMES]
    ids = pairs.sparkSession.range(size).select(F.col("id").cast("int").alias("w"))
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in counts}
    after = scratch.keep(ids.join(pairs.groupBy("w").agg(*(F.count_if(F.col(c) > 0).alias(c) for c in counts)), "w", "left").select("w", *zero.values()))
    seen = after.agg(*(F.sum(c).alias(c) for c in counts), *(F.count_if(F.col(c) == k).alias(f"{c}_{k}") for c in counts for k in (1, 2))).first()
    low = {c: F.greatest(F.col(c) - _discount(seen[f"{c}_1"], seen[f"{c}_2"]), F.lit(0.0)) for c in counts}
    taken = after.agg(*(F.sum(low[c]).alias(c) for c in counts)).first()
    out = {}
    for m, c in NAMES:
        name, total = f"c{m}{c}", max(seen[f"c{m}{c}"], 1)
        shared = (F.col(f"c{m}0") + F.col(f"c{m}1") + 0.5) / (seen[f"c{m}0"] + seen[f"c{m}1"] + 0.5 * size)
        out[f"p{name}"] = low[name] / total + (1 - taken[name] / total) * shared
    return scratch.keep(after.select("w", *(v.alias(k) for k, v in out.items())))
