"""Operator 10: exact n-gram Jaccard self-join by PartEnum signatures.

Two texts link when 100 * |A n B| >= percent * |A u B| over their distinct word shingles. Sets are put in size
bands; two linked sets are in one band or in neighbouring ones, and the join instance of a band serves pairs whose smaller
set is in it, so a set takes part in the instances of its own band and of the one below. There the symmetric difference
of a linked pair is at most k. The 64-bit shingle domain is cut into parts, each into three sub-parts; fewer than
k // 2 + 1 parts hold more than one difference, and in any other part two of the three sub-parts agree. So the three
two-of-three subsets of each part, hashed with what the set has in them, are signatures of which a linked pair shares one.

Subsets in which the set has nothing make no signature, so that unrelated sets do not meet by having nothing. No link is
lost by that: call a part full if two of its sub-parts have members of the set, so that none of its subsets is empty. If either
set of a pair has more than k // 2 full parts, one of these has one difference at most and yields a signature that both have.
A set with fewer also takes part in finer plain partitions (of 2, 4, 8 ... times k + 1 parts, each a signature) up to the first
in which more than k of its parts are not empty; two such sets agree in one of these. Where k is 0, linked sets are equal,
and equal sets are one node from the start. Shared signatures only propose pairs; every link is checked on the whole sets
(see ``simjoin``).

Defined results: null, empty or blank texts have an empty set and link with nothing; repeated rows and equal texts
are one class; a null doc_id is a row of its own whose class id is the least known doc_id of its class; other columns
are ignored; an empty table gives no rows. Sets are told apart by a 64-bit fingerprint (collisions are expected at about 4e9
different texts). ``percent`` is 62 or more: below, a linked pair may have nothing in common but small parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltide.llm import simjoin
from calltide.llm.batches import bound
from calltide.llm.filters import sized, without
from calltide.llm.tokens import U, mix, signed, slices
from calltide.session import Scratch

SIZE, PERCENT = 3, 90
_SUBSETS = ((0, 1), (0, 2), (1, 2))
#: Stands for a null doc_id where ids are compared.
_NO_ID = -(1 << 63)


def _print(s: np.ndarray) -> int:
    """Fingerprint of a set: order-free sum of mixed members, with its size."""
    return int(mix(np.array([mix(s).sum() + U(len(s))], dtype=np.uint64)).view(np.int64)[0])


def _band(n: int, percent: int) -> int:
    """Band of a set size: bands grow by 100 / percent."""
    return int(np.floor(np.log(n) / np.log(100 / percent) + 1e-9))


def _parts(instance: int, percent: int) -> tuple[int, int]:
    """(k, parts) of an instance: the largest difference, and as many parts as most sets need for k // 2 + 1 full ones."""
    top = (100 / percent) ** (instance + 1)  # the smaller set of a pair is smaller than this
    k = int(top * (100 - percent) / percent + 1e-9)
    need = k // 2 + 1
    thin = min(0.5, 3 * np.exp(-2 / 3 * top * percent / 100 / need))  # share of parts that are not full
    return k, need + 1 + int(np.ceil(1.5 * thin * need + 2 * np.sqrt(thin * need)))


def _held(s: np.ndarray, values: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the members in each of ``parts`` ranges of the hash; s is sorted."""
    place = ((s >> U(32)) * U(parts)) >> U(32)
    edge = np.searchsorted(place, np.arange(parts + 1, dtype=np.uint64))
    return values[edge[1:]] - values[edge[:-1]], edge[1:] - edge[:-1]


def _signatures(s: np.ndarray, percent: int) -> np.ndarray:
    out = [np.zeros(0, dtype=np.uint64)]
    band = _band(len(s), percent)
    values = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s))])
    for instance in (band - 1, band):
        k, parts = _parts(instance, percent)
        if not k:
            continue
        name = U(((instance + 2) * 1_000_003) << 20)
        held, count = (x.reshape(-1, 3) for x in _held(s, values, 3 * parts))
        sums = np.stack([mix(held[:, i] + U(0x51ED27)) + held[:, j] * U(3) for i, j in _SUBSETS], axis=1)
        some = np.stack([count[:, i] + count[:, j] for i, j in _SUBSETS], axis=1) > 0
        where = (np.arange(3 * parts, dtype=np.uint64) + name).reshape(-1, 3)
        out.append(mix(sums ^ mix(where))[some])
        full = int(((count > 0).sum(axis=1) > 1).sum())
        finer = k + 1
        while full <= k // 2:
            finer = min(2 * finer, 1 << 32)
            places, first = np.unique(((s >> U(32)) * U(finer)) >> U(32), return_index=True)
            sums = values[np.append(first[1:], len(s))] - values[first]
            out.append(mix(sums ^ mix(places + name + U(finer << 4))))
            if len(places) > k or finer == 1 << 32:
                break
    return np.concatenate(out)


def _prints(size: int, percent: int) -> Callable:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = simjoin.sets(batch, size)
            node = pa.array([_print(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), node, simjoin.sketches(sets, percent)],
                names=["doc_id", "n_shingles", "node", "sketch"],
            )

    return of


def _flat(size: int, percent: int) -> Callable:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            known: dict[int, np.ndarray] = {}
            for s in simjoin.sets(batch, size):
                if len(s) and (node := _print(s)) not in known:
                    known[node] = _signatures(s, percent)
            if known:
                node = np.repeat(np.array(list(known), dtype=np.int64), [len(x) for x in known.values()])
                yield simjoin.local_stars(signed(np.concatenate(list(known.values()))), node)

    return of


def _texts(size: int) -> Callable:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = simjoin.sets(batch, size)
            node = pa.array([_print(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([node, batch.column("text").cast(pa.string())], names=["node", "text"])

    return of


def ngram_groups(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text)."""
    if not 62 <= percent <= 100:
        raise ValueError("percent must be from 62 to 100")
    bound(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = scratch.keep(docs.mapInArrow(_prints(size, percent), "doc_id long, n_shingles long, node long, sketch array<long>"))
    known = rows.where("node is not null").withColumn("id", F.coalesce("doc_id", F.lit(_NO_ID)))
    nodes = known.groupBy("node").agg(F.min("id").alias("id"), F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    nodes = scratch.keep(nodes)

    def profile(wanted: DataFrame) -> DataFrame:
        first = nodes.join(wanted, "node", "left_semi").select("node", "id")
        return known.select("node", "id", F.col("n_shingles").alias("n"), "sketch").join(first, ["node", "id"], "left_semi").drop("id").dropDuplicates(["node"])

    def payload(wanted: DataFrame) -> DataFrame:
        first = scratch.keep(nodes.join(wanted, "node", "left_semi").select("node", "id"))
        some = docs.withColumn("id", F.coalesce("doc_id", F.lit(_NO_ID))).join(sized(first.select("id").distinct()), "id", "left_semi")
        return some.mapInArrow(_texts(size), "node long, text string").join(first.select("node"), "node", "left_semi").dropDuplicates(["node"])

    comps = simjoin.classes(docs.select("text").mapInArrow(_flat(size, percent), "sig long, a long, b long"), payload, size, percent, scratch, profile)
    linked = scratch.keep(nodes.join(comps, "node", "left").where("comp is not null or rows > 1").select("node", F.coalesce("comp", "node").alias("comp"), "least"))
    least = scratch.keep(linked.groupBy("comp").agg(F.min("least").alias("component_id")))
    ids = scratch.keep(linked.join(least, "comp").select("node", "component_id"))
    scratch.drop(rows, ids)
    scratch.release()
    return rows.join(ids, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs without those that link to a lower doc_id, at any number of links; of repeated rows one stays.
    Rows without doc_id and texts without words stay."""
    scratch = Scratch(docs.sparkSession)
    groups = scratch.keep(ngram_groups(docs, size, percent))
    gone = scratch.keep(groups.where("doc_id <> component_id").select("doc_id").distinct())
    kept = without(docs, gone)
    again = scratch.keep(groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return kept
    return without(kept, again).unionByName(kept.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))
