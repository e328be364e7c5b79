"""Phrases whose words stand together more often than their parts let expect, by language.

Texts are cut into pieces at marks and line ends, and pieces into words. All counts cover all texts, by languages:

1. Words are counted; frequent are those with ``least`` occurrences.
2. Candidates of two words and more are found level by level (Apriori): a run of k words counts only where its first and its
   last k - 1 words may both be frequent. What may be frequent is asked of a bit map of hashes, which has no false negatives and
   a proven size (``2**WIDTH`` words of 64 bits, 16 MB); the runs' counts, summed up in each task first, are summed by a shuffle
   and those below ``least`` go. Words stand for their hashes here: one that shares its hash with another only makes counts too
   high. From the third word on, only stretches of the texts in which frequent pairs follow each other are read again, twice: runs
   of which one of two buckets of hashes has fewer than ``least`` in all texts go before they are counted one by one.
3. The candidates get their exact counts: each shard of at most some ``SHARD`` of them becomes a double-array trie that is
   broadcast (its size is bounded by the shard's), numpy moves the states of all positions of a slice of text along at once, level
   by level, and bincounts the accepting ones; tasks' counts are summed up as vectors. Every shard is one pass over the texts.
4. Scores, the parts' counts and which phrase stands inside an equally frequent longer one come from joins. Products are decimals
   of 38 digits.

Null texts are empty; the language null is ``und``. Repeated rows count as often as they stand there. Texts of any length are
read whole, in slices of whole texts. Empty tables give no rows; extra columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calltide.llm import batches, tokens
from calltide.llm.double_array import DoubleArray
from calltide.llm.filters import sized
from calltide.session import Scratch

#: Candidates in one broadcast trie, in the mean, at most.
SHARD = 250_000
#: From three words on, runs are counted by two sets of 2**BUCKETS buckets of their hashes first, each from bits of its own; a run that
#: is frequent fills both of its buckets, and others seldom meet two full ones. On larger tables more of them are full.
BUCKETS = 20
#: Phrases whose counts a task hands on together.
BLOCK = 256
#: A bit map of what may be frequent has 2**WIDTH 64-bit words at most.
WIDTH = 21
LONGEST = 5
#: Bytes of text in a slice, and different runs that a task holds while it adds up their counts.
SLICE, TOGETHER = 4_000_000, 1_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Marks and line ends that end a piece; space and tab part words.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[9, 32]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2


@dataclass
class Positions:
    """All words of a slice: the number of each in ``words`` (different ones), its text's language, and whether the next word
    follows in the same piece."""

    code: np.ndarray
    words: pa.Array
    lang: np.ndarray
    langs: list[str]
    joined: np.ndarray


def positions(batch: pa.RecordBatch) -> Positions:
    """The words of a batch (text, lang)."""
    text = tokens.strings(batch.column("text"))
    lang = batch.column("lang").cast(pa.string()).fill_null("und").dictionary_encode()
    none = np.zeros(0, dtype=np.int64)
    if text.buffers()[2] is None:
        return Positions(none, pa.array([], pa.string()), none, [], np.zeros(0, dtype=bool))
    offset = np.frombuffer(text.buffers()[1], dtype=np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = _LOWER[np.frombuffer(text.buffers()[2], dtype=np.uint8)[offset[0] : offset[-1]]]
    offset = offset - offset[0]
    kind = _KIND[data]
    inside = kind == 0
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[offset] = True
    start = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | begins[:-1]))
    end = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | begins[1:])) + 1
    where = np.searchsorted(offset, start, side="right") - 1
    marks = np.cumsum(kind == 2, dtype=np.int32)
    joined = np.zeros(len(start), dtype=bool)
    joined[:-1] = (marks[start[1:]] == marks[start[:-1]]) & (where[1:] == where[:-1])
    bounds = np.zeros(len(start) + 1, dtype=np.int32)
    np.cumsum(end - start, out=bounds[1:])
    each = pa.StringArray.from_buffers(len(start), pa.py_buffer(bounds), pa.py_buffer(data[inside])).dictionary_encode()
    of = lang.indices.to_numpy().astype(np.int64)[where]
    return Positions(each.indices.to_numpy().astype(np.int64), each.dictionary, of, lang.dictionary.to_pylist(), joined)


def _named(lang: str) -> np.uint64:
    return np.frombuffer(hashlib.blake2b(lang.encode(), digest_size=8).digest(), dtype=np.uint64)[0]


def _hashes(p: Positions) -> tuple[np.ndarray, np.ndarray]:
    """For each position a small number of its word and language, and the hash of each of these numbers; none is 0."""
    word = tokens.words(p.words).hash
    table = np.concatenate([tokens.mix(word ^ _named(x)) for x in p.langs]) if p.langs else word
    return p.lang * len(p.words) + p.code, np.maximum(table, np.uint64(1))


def _counts(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The different values of x, all below ``most``, and how often each is there."""
    if most > 4 * len(x) + 1_000_000:
        return np.unique(x, return_counts=True)
    n = np.bincount(x, minlength=1)
    return np.flatnonzero(n), n[n > 0]


def _word_rows(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, h, n) of each slice's words, and with word null those of all its words by language."""
    for batch in tokens.slices(source, most=SLICE):
        p = positions(batch)
        local, table = _hashes(p)
        value, n = _counts(local, max(1, len(p.langs)) * len(p.words))
        size = max(1, len(p.words))
        names = pa.array(p.langs, pa.string())
        of, total = np.unique(p.lang, return_counts=True)
        columns = [
            names.take(pa.array(np.concatenate([value // size, of]))), pa.concat_arrays([p.words.take(pa.array(value % size)), pa.nulls(len(of), pa.string())]),
            pa.array(tokens.signed(np.concatenate([table[value], np.zeros(len(of), np.uint64)]))), pa.array(np.concatenate([n, total]), pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "h", "n"])


class BitMap:
    """Which hashes may be among the frequent ones."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.shift = bits, np.uint64(64 - int(len(bits)).bit_length() + 1)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        return (self.bits[h >> self.shift] >> (h & np.uint64(63))) & np.uint64(1) == 1


def bit_map(rows: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray]) -> Broadcast:
    """The broadcast bit map of hashes of rows: made in tasks, put together by words, so that no more than these are collected."""
    width = min(WIDTH, max(1, int(rows.count()).bit_length()))
    shift = np.uint64(64 - width)

    def bits(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            h = hashes(b)
            yield pa.RecordBatch.from_pydict({"at": (h >> shift).astype(np.int64), "bits": tokens.signed(np.uint64(1) << (h & np.uint64(63)))})

    found = rows.mapInArrow(bits, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << width, dtype=np.uint64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return rows.sparkSession.sparkContext.broadcast(BitMap(out))


def _longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of runs by that of their first words and that of their last word."""
    return tokens.mix(h * np.uint64(0x9E3779B97F4A7C15) + word)


def _run_hash(batch: pa.RecordBatch, k: int) -> np.ndarray:
    """Hashes of runs of k words (t1, ...)."""
    h = batch.column("t1").to_numpy().view(np.uint64)
    for i in range(2, k + 1):
        h = _longer(h, batch.column(f"t{i}").to_numpy().view(np.uint64))
    return h


def _pair_rows(may: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.slices(source, most=SLICE):
            p = positions(batch)
            local, table = _hashes(p)
            alive = may.value(table)[local]
            at = np.flatnonzero(p.joined[:-1] & alive[:-1] & alive[1:])
            m = max(1, len(table))
            value, n = np.unique(local[at] * m + local[at + 1], return_counts=True)
            yield pa.RecordBatch.from_pydict({"t1": tokens.signed(table[value // m]), "t2": tokens.signed(table[value % m]), "n": n.astype(np.int64)})

    return rows


def _stretches(may: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One list of word hashes for each slice: its stretches of pairs that may be frequent, a 0 behind each."""

    def rows(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.slices(source, most=SLICE):
            p = positions(batch)
            local, table = _hashes(p)
            h = table[local]
            on = np.zeros(len(h), dtype=bool)  # this word and the next one are such a pair
            on[:-1] = p.joined[:-1] & may.value(_longer(h[:-1], h[1:]))
            kept = on.copy()
            kept[1:] |= on[:-1]
            at = np.flatnonzero(kept)
            last = (~on[at]).astype(np.int64)
            out = np.zeros(len(at) + int(last.sum()), dtype=np.uint64)
            out[np.arange(len(at)) + np.cumsum(last) - last] = h[at]
            yield pa.RecordBatch.from_pydict({"hashes": pa.array([tokens.signed(out)], pa.list_(pa.int64()))})

    return rows


def _at(h: np.ndarray, may: BitMap, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of k words begin in stretches of which the first and the last k - 1 may be frequent, and each one's two buckets."""
    run, whole = h, h != 0
    for j in range(1, k - 1):
        run, whole = _longer(run[:-1], h[j:]), whole[:-1] & (h[j:] != 0)
    alive = may(run) & whole
    at = np.flatnonzero(alive[:-1] & alive[1:])
    x = _longer(run[at], h[at + k - 1])
    first, second = x >> np.uint64(64 - BUCKETS), x & np.uint64((1 << BUCKETS) - 1)
    return at, np.stack([first, second + np.uint64(1 << BUCKETS)]).astype(np.int64)


def _bucket_rows(may: Broadcast, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(block, counts): how many runs of k words of one task fall into each bucket of their hashes, the first set before the second."""

    def rows(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 << BUCKETS, dtype=np.int64)
        for batch in source:
            for h in _lists(batch):
                if len(h) >= k:
                    total += np.bincount(_at(h, may.value, k)[1].reshape(-1), minlength=len(total))
        each = len(total) // 256
        blocks = [(i, total[i * each : (i + 1) * each]) for i in range(256)]
        blocks = [(i, x.tobytes()) for i, x in blocks if x.any()]
        yield pa.RecordBatch.from_pydict({"block": pa.array([i for i, _ in blocks], pa.int32()), "counts": pa.array([x for _, x in blocks], pa.binary())})

    return rows


def _full_buckets(stretches: DataFrame, may: Broadcast, k: int, least: int) -> Broadcast:
    """Which buckets hold ``least`` runs of k words or more: only runs with both buckets among these can be frequent. Tasks hand their
    buckets on as vectors; 2 * 2**BUCKETS bits are collected."""

    def summed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, total in _summed(source):
            yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int32()), "bits": pa.array([np.packbits(total >= least).tobytes()], pa.binary())})

    dealt = stretches.mapInArrow(_bucket_rows(may, k), "block int, counts binary").repartition("block").sortWithinPartitions("block")
    found = dealt.mapInArrow(summed, "block int, bits binary").toArrow()
    full = np.zeros((256, (2 << BUCKETS) // 256), dtype=bool)
    for i, bits in zip(found["block"].to_pylist(), found["bits"].to_pylist(), strict=True):
        full[i] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).astype(bool)
    return stretches.sparkSession.sparkContext.broadcast(full.reshape(-1))


def _lists(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for i in range(batch.num_rows):
        yield np.asarray(batch.column("hashes")[i].values.to_numpy(zero_copy_only=False), dtype=np.int64).view(np.uint64)


def _summed(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(block, counts) of rows that come sorted by block, their vectors added up."""
    block, total = -1, np.zeros(0, dtype=np.int64)
    for batch in source:
        for i, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            x = np.frombuffer(counts, dtype=np.int64)
            if i == block:
                total = total + x
                continue
            if block >= 0:
                yield block, total
            block, total = i, x
    if block >= 0:
        yield block, total


def _added_up(runs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ones of runs (a column each) and the sums of their counts."""
    order = np.lexsort(runs)
    runs, n = runs[:, order], n[order]
    first = np.ones(len(n), dtype=bool)
    first[1:] = (runs[:, 1:] != runs[:, :-1]).any(axis=0)
    return runs[:, first], np.add.reduceat(n, np.flatnonzero(first)) if len(n) else n


def _run_rows(may: Broadcast, full: Broadcast, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs of k words in full buckets of which the first and the last k - 1 may be frequent, with how often each is there. A task's
    runs are added up over all its stretches; only if more than ``TOGETHER`` different ones are held are they handed on before."""

    def handed_on(runs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({**{f"t{j + 1}": tokens.signed(runs[j]) for j in range(k)}, "n": n})

    def rows(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros((k, 0), dtype=np.uint64), np.zeros(0, dtype=np.int64))
        held, fresh, size = none, [], 0
        for batch in source:
            for h in _lists(batch):
                if len(h) < k:
                    continue
                at, bucket = _at(h, may.value, k)
                at = at[full.value[bucket].all(axis=0)]
                fresh.append(_added_up(np.stack([h[at + j] for j in range(k)]), np.ones(len(at), dtype=np.int64)))
                size += len(fresh[-1][1])
                if size < TOGETHER:
                    continue
                held, fresh, size = _added_up(*(np.concatenate(x, axis=-1) for x in zip(held, *fresh, strict=True))), [], 0
                if len(held[1]) > TOGETHER:
                    yield handed_on(*held)
                    held = none
        yield handed_on(*_added_up(*(np.concatenate(x, axis=-1) for x in zip(held, *fresh, strict=True))))

    return rows


def candidates(docs: DataFrame, words: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """(lang, phrase, size): every phrase of 2 to LONGEST words that is there ``least`` times, and by chance some others."""
    asked = [f"t{k}" for k in range(1, LONGEST + 1)]
    may = bit_map(words, lambda b: b.column("h").to_numpy().view(np.uint64))
    found, stretches = [], None
    for k in range(2, LONGEST + 1):
        schema = ", ".join(f"{t} long" for t in asked[:k]) + ", n long"
        full = _full_buckets(stretches, may, k, least) if k > 2 else None
        rows = docs.mapInArrow(_pair_rows(may), schema) if k == 2 else stretches.mapInArrow(_run_rows(may, full, k), schema)
        runs = scratch.keep(rows.groupBy(*asked[:k]).agg(F.sum("n").alias("n")).where(F.col("n") >= least).select(*asked[:k]))
        found.append(runs.select(*asked[:k], *(F.lit(None).cast("long").alias(t) for t in asked[k:])))
        may.unpersist()
        if k < LONGEST:
            may = bit_map(runs, lambda b, k=k: _run_hash(b, k))
        if k == 2:
            stretches = scratch.keep(docs.mapInArrow(_stretches(may), "hashes array<long>"))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    own = [words.select(F.col("h").alias(t), F.col("lang").alias(f"l{t}"), F.col("word").alias(f"w{t}")) for t in asked]
    for t, w in zip(asked, own, strict=True):
        every = every.join(sized(w), t, "left")
    same = F.lit(True)
    for t in asked[1:]:
        same = same & (F.col(t).isNull() | (F.col(f"l{t}") == F.col("lt1")))
    phrase = F.concat_ws(" ", *(f"w{t}" for t in asked))
    size = sum((F.col(t).isNotNull().cast("int") for t in asked[1:]), F.lit(1))
    return scratch.keep(every.where(same).select(F.col("lt1").alias("lang"), phrase.alias("phrase"), size.alias("size")).distinct())


@dataclass
class Shard:
    """A trie of phrases, each behind its language, as codes: languages first, words behind them."""

    trie: DoubleArray
    langs: list[str]
    words: pa.Array
    lang: pa.Array
    phrase: pa.Array

    @classmethod
    def of(cls, rows: pa.Table) -> Shard:
        lang, phrase = (pa.concat_arrays(rows[c].chunks) if rows[c].num_chunks else pa.array([], pa.string()) for c in ("lang", "phrase"))
        parts = pc.split_pattern(phrase, " ")
        each = parts.flatten().dictionary_encode()
        size = parts.value_lengths().to_numpy().astype(np.int64)
        names = lang.dictionary_encode()
        codes = np.zeros((len(phrase), int(size.max(initial=0)) + 1), dtype=np.int64)
        codes[:, 0] = names.indices.to_numpy() + 1
        row = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        codes[row, place + 1] = each.indices.to_numpy() + 1 + len(names.dictionary)
        return cls(DoubleArray.build(codes, size + 1), names.dictionary.to_pylist(), each.dictionary, lang, phrase)


def _count_rows(shard: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(block, counts): how often each phrase of the shard stands in the texts of one task, ``BLOCK`` phrases in a row."""

    def rows(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shard.value
        trie, total, number_of = s.trie, np.zeros(len(s.phrase), dtype=np.int64), {x: i + 1 for i, x in enumerate(s.langs)}
        for batch in tokens.slices(source, most=SLICE):
            p = positions(batch)
            if not len(p.code):
                continue
            known = pc.index_in(p.words, value_set=s.words).fill_null(-1).to_numpy().astype(np.int64)
            code = np.where(known < 0, 0, known + 1 + len(s.langs))[p.code]
            lang = np.array([number_of.get(x, 0) for x in p.langs], dtype=np.int64)
            root = trie.step(np.zeros(len(lang), dtype=np.int64), lang)[p.lang]
            at = np.flatnonzero((root >= 0) & (code > 0))
            state = root[at]
            for k in range(LONGEST):
                state = trie.step(state, code[at + k])
                at, state = at[state >= 0], state[state >= 0]
                number = trie.leaf[state]
                total += np.bincount(number[number >= 0], minlength=len(total))
                go = p.joined[at + k]
                at, state = at[go], state[go]
        blocks = [(i // BLOCK, total[i : i + BLOCK]) for i in range(0, len(total), BLOCK)]
        blocks = [(i, x.tobytes()) for i, x in blocks if x.any()]
        yield pa.RecordBatch.from_pydict({"block": pa.array([i for i, _ in blocks], pa.int32()), "counts": pa.array([x for _, x in blocks], pa.binary())})

    return rows


def _sum_rows(shard: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, phrase, n) of all tasks' blocks, which come sorted by block."""

    def told(block: int, total: np.ndarray) -> pa.RecordBatch:
        s, hit = shard.value, np.flatnonzero(total)
        at = pa.array(hit + block * BLOCK)
        return pa.RecordBatch.from_arrays([s.lang.take(at), s.phrase.take(at), pa.array(total[hit])], ["lang", "phrase", "n"])

    def rows(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, total in _summed(source):
            yield told(block, total)

    return rows


def _exact(docs: DataFrame, asked: DataFrame, scratch: Scratch) -> DataFrame:
    """(lang, phrase, n): the asked phrases' counts in all texts, one trie after the other."""
    spark: SparkSession = docs.sparkSession
    shards = -(-asked.count() // SHARD)
    parted = asked.withColumn("shard", F.pmod(F.xxhash64("lang", "phrase"), F.lit(shards or 1)))
    out = spark.createDataFrame([], "lang string, phrase string, n long")
    for i in range(shards):
        shard = spark.sparkContext.broadcast(Shard.of(parted.where(F.col("shard") == i).select("lang", "phrase").toArrow()))
        counted = docs.mapInArrow(_count_rows(shard), "block int, counts binary").repartition("block").sortWithinPartitions("block")
        out = out.unionByName(scratch.keep(counted.mapInArrow(_sum_rows(shard), "lang string, phrase string, n long")))
        shard.unpersist()
    return out


def collocations(docs: DataFrame, least: int = 100, share: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the ``top`` phrases of docs (text, lang) by score, which is
    floor(1000 * a * n / (l * r)) at the cut where it is least. Phrases inside a longer candidate that is there in ``share``
    percent of their own places or more are left out."""
    spark = docs.sparkSession
    batches.bound(spark)
    scratch = Scratch(spark)
    docs = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counted = docs.mapInArrow(_word_rows, "lang string, word string, h long, n long").groupBy("lang", "word", "h").agg(F.sum("n").alias("n"))
    counted = scratch.keep(counted.where((F.col("n") >= least) | F.col("word").isNull()))
    totals, words = counted.where("word is null").select("lang", F.col("n").alias("total")), counted.where("word is not null")
    asked = candidates(docs, words, least, scratch)
    found = scratch.keep(_exact(docs, asked, scratch).where(F.col("n") >= least))

    known = found.select("lang", "phrase", "n").unionByName(words.select("lang", F.col("word").alias("phrase"), "n"))
    split = found.select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = split.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    rest = F.array_join(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"), rest.alias("rest"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    cuts = cuts.join(F.broadcast(totals) if totals.limit(10_001).count() <= 10_000 else totals, "lang")
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = cuts.withColumn("up", F.lit(1000).cast("decimal(4,0)") * (exact("a") * exact("total")).cast("decimal(34,0)"))
    cuts = cuts.withColumn("down", (exact("l") * exact("r")).cast("decimal(38,0)")).withColumn("score", F.expr("up div down").cast("long"))
    least_cut = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r", "total")).alias("cut"))

    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.size("words") - 1),
            lambda m: F.transform(F.sequence(F.lit(1), F.size("words") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " ")),
        )
    )
    inside = split.where(F.size("words") > 2).select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a")
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = least_cut.join(inside, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    left = left.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.total").alias("n"), F.col("cut.score").alias("score"))
    return _first(left, top)


def _first(rows: DataFrame, top: int) -> DataFrame:
    """The first rows of each language; those of 256 parts of it are found first, then of 16, so that no task sorts all of one."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(256)))
    for parts in (256, 16, 1):
        w = Window.partitionBy("lang", *([F.col("part") % parts] if parts > 1 else [])).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
