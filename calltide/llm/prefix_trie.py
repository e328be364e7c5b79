"""The trie of conversation prefixes: which turns conversations share from their start on, and what storing them once saves.

Every conversation becomes its turns' ids, two 64-bit hashes of role and text, with the number of words of each text. Rows are
dealt out by ranges of their whole id sequences and the conversation's own id, so that a first turn, or a whole conversation,
that very many share is spread over as many shards as it needs. In a shard, numpy sorts padded matrices of turn ids
(``lexsort``), 16 columns at a time, of the rows that are that long; OR-accumulated masks of changed columns tell how many
turns a row shares with the one before it, thus where nodes begin, and ``reduceat`` over the rows that reach a depth sums up
its nodes. A shard knows everything of a node but of those that its first or last row runs through: these boundary nodes,
at most two for each depth and shard, recombine by Spark joins, with what neighbouring shards both counted taken out once.

Nothing is gathered whole but one conversation's ids (20 bytes a turn, in one row) and a shard's rows (``TURNS`` turns in the
mean). The digest of who ends at a node is fed shard by shard where many end there: the task holds one shard's ids at a time.

Null roles and texts are empty; null turns come first; of equal turns, roles and then hashes of the text decide. Rows without
a conversation id belong to no conversation. Repeated rows are turns of their own. No conversations give no nodes, not even a
root. Extra columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltide.llm.filters import sized
from calltide.session import Scratch

#: Turns in a shard, in the mean, at most; small tables are parted more finely, down to LEAST.
TURNS, LEAST = 1 << 19, 1 << 12
#: Columns of a padded matrix.
BAND = 16

_SCHEMA = (
    "shard int, j int, pj int, key binary, pkey binary, first boolean, last boolean, end_last boolean, depth long, conv_id long, parent_conv_id long, "
    "n long, n_children long, n_leaves long, nw long, sw long, w long, wcum long, ends string"
)
_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
_FIELDS = [(c.split()[0], _ARROW[c.split()[1]]) for c in _SCHEMA.split(", ")]
_NONE = hashlib.sha256(b"").hexdigest()


def turn_ids(turns: DataFrame) -> DataFrame:
    """(conv_id, ids, words): each conversation's turns in order, as pairs of hashes, and the number of words of each."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    one = F.struct(
        F.col("turn"), role.alias("role"), F.xxhash64(role, text).alias("a"), F.xxhash64(text, F.lit("trie"), role).alias("b"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("w"),
    )
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("t"))
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    ids = F.transform("t", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b")))
    return listed.select("conv_id", ids.alias("ids"), F.transform("t", lambda t: t["w"]).alias("words"))


def rebuilt(convs: DataFrame, every: int = 20, most: int = 3) -> DataFrame:
    """Each conversation c with the first h turns of c - c % every in the place of its own; h = crc32(c) % (most + 1)."""
    heads = convs.where(F.col("conv_id") % every == 0)
    heads = heads.select(F.col("conv_id").alias("base"), F.slice("ids", 1, most).alias("h_ids"), F.slice("words", 1, most).alias("h_words"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    rows = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", h).join(heads, "base", "left")

    def spliced(own: str, head: str) -> Column:
        first = F.when(F.col(head).isNull(), F.slice(own, 1, 0)).otherwise(F.slice(head, F.lit(1), F.col("h")))
        return F.concat(first, F.slice(own, F.col("h") + 1, F.size(own))).alias(own)

    return rows.select("conv_id", spliced("ids", "h_ids"), spliced("words", "h_words"))


def _matrix(ids: np.ndarray, begin: np.ndarray, size: np.ndarray, low: int) -> np.ndarray:
    """Columns low to low + BAND of the rows' ids, 0 behind their ends."""
    out = np.zeros((len(begin), BAND), dtype=np.int64)
    for c in range(BAND):
        there = size > low + c
        out[there, c] = ids[begin[there] + low + c]
    return out


def _sorted(ids: np.ndarray, begin: np.ndarray, size: np.ndarray, conv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' order by ids, then by conversation, and how many ids each row shares with the one before it (-1: none before)."""
    order, shared = np.arange(len(size)), np.full(len(size), -1, dtype=np.int64)
    at, group, low = np.arange(len(size)), np.zeros(len(size), dtype=np.int64), 0
    while len(at):  # places of the rows that have a column in this band, and what they share with others so far
        rows = order[at]
        m, longer = _matrix(ids, begin[rows], size[rows], low), size[rows] > low + BAND
        k = np.lexsort((conv[rows], longer, *m.T[::-1], group))
        rows, m, longer = rows[k], m[k], longer[k]
        order[at] = rows
        changed = np.logical_or.accumulate(m[1:] != m[:-1], axis=1)
        near = np.flatnonzero(group[1:] == group[:-1])
        same = low + BAND - changed.sum(axis=1)[near]
        shared[at[near + 1]] = np.minimum(same, np.minimum(size[rows[near]], size[rows[near + 1]]))
        parted = np.ones(len(at), dtype=bool)
        parted[near + 1] = changed[near, -1]
        group, at, low = np.cumsum(parted)[longer], at[longer], low + BAND
    return order, shared


def _sums(x: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(x)])
    return total[first + n] - total[first]


def _keys(a: np.ndarray, b: np.ndarray) -> list[bytes]:
    """A 128-bit name of each prefix of one row's ids, the empty one first."""
    out = [b""]
    for x in np.stack([a, b], axis=1).astype("<i8"):
        out.append(hashlib.blake2b(out[-1] + x.tobytes(), digest_size=16).digest())
    return out


def _nodes(shard: int, conv: np.ndarray, begin: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The nodes of one shard. Row r has the ids begin[r] to begin[r] + size[r]."""
    by = np.lexsort((b, a))
    fresh = np.ones(len(by), dtype=bool)
    fresh[1:] = (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1])
    ids = np.empty(len(by), dtype=np.int64)
    ids[by] = np.cumsum(fresh)
    order, shared = _sorted(ids, begin, size, conv)
    conv, begin, size, end = conv[order], begin[order], size[order], len(order) - 1
    ends = [_keys(a[begin[r] : begin[r] + size[r]], b[begin[r] : begin[r] + size[r]]) for r in (0, end)]
    levels, rows = [], np.arange(len(order))
    while len(rows):
        d = len(levels)
        s = np.flatnonzero(shared[rows] < d)
        n = np.diff(np.append(s, len(rows)))
        start = rows[s]
        w = words[begin[start] + d - 1].astype(np.int64) if d else np.zeros(1, dtype=np.int64)
        up = np.searchsorted(levels[-1]["start"], start, side="right") - 1 if d else np.zeros(1, dtype=np.int64)
        here = np.add.reduceat((size[rows] == d).astype(np.int64), s)
        levels.append({"start": start, "stop": rows[s + n - 1], "n": n, "conv": np.minimum.reduceat(conv[rows], s), "w": w, "up": up, "here": here})
        rows = rows[size[rows] > d]
    for d in range(len(levels) - 1, -1, -1):
        x, below = levels[d], levels[d + 1] if d + 1 < len(levels) else None
        x["kids"] = np.bincount(below["up"], minlength=len(x["n"])) if below else np.zeros(len(x["n"]), dtype=np.int64)
        first = np.cumsum(x["kids"]) - x["kids"]
        of = lambda c: _sums(below[c], first, x["kids"]) if below else 0  # noqa: B023, E731
        x["leaves"], x["nw"], x["sw"] = (x["kids"] == 0) + of("leaves"), x["n"] * x["w"] + of("nw"), x["w"] + of("sw")
    wcum = np.cumsum([x["w"][0] for x in levels[: size[0] + 1]])
    for d, x in enumerate(levels):
        m, first, last = len(x["n"]), x["start"] == 0, x["stop"] == end
        edge = first | last
        local = np.where(first, d, size[0] + 1 + d)
        joined, key, pkey = np.where(edge, "", _NONE).astype(object), np.full(m, None), np.full(m, None)
        for i in np.flatnonzero(x["here"]):
            listed = ",".join(map(str, conv[x["start"][i] : x["start"][i] + x["here"][i]].tolist()))
            joined[i] = listed if edge[i] else hashlib.sha256(listed.encode()).hexdigest()
        for i in np.flatnonzero(edge):
            path = ends[0 if first[i] else 1]
            key[i], pkey[i] = path[d], path[d - 1] if d else None
        of_edge, parent = np.zeros(m, dtype=bool), levels[d - 1] if d else None
        if d:
            of_edge = ((parent["start"] == 0) | (parent["stop"] == end))[x["up"]]
        up_local = np.where(parent["start"][x["up"]] == 0, d - 1, size[0] + d) if d else np.zeros(1, dtype=np.int64)
        some = lambda values, where: pa.array(values, mask=~where)
        out = {
            "shard": np.full(m, shard), "j": some(local, edge), "pj": some(up_local, of_edge & ~edge), "key": key, "pkey": pkey, "first": first, "last": last,
            "end_last": last & (d == size[end]), "depth": np.full(m, d), "conv_id": x["conv"], "n": x["n"], "n_children": x["kids"], "n_leaves": x["leaves"], "nw": x["nw"], "sw": x["sw"],
            "parent_conv_id": some(parent["conv"][x["up"]] if d else np.zeros(1, dtype=np.int64), ~of_edge & bool(d)),
            "w": x["w"], "wcum": np.full(m, wcum[d] if d < len(wcum) else 0), "ends": joined,
        }
        yield pa.RecordBatch.from_arrays([out[c].cast(t) if isinstance(out[c], pa.Array) else pa.array(out[c], t) for c, t in _FIELDS], [c for c, _ in _FIELDS])


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All nodes of the rows of one partition."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held).combine_chunks()
    column = lambda c: pa.concat_arrays(t[c].chunks)
    ids = column("ids")
    size = np.asarray(ids.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    flat = ids.flatten()
    a, b = (np.asarray(flat.field(k).to_numpy(zero_copy_only=False), dtype=np.int64) for k in (0, 1))
    words = np.asarray(column("words").flatten().to_numpy(zero_copy_only=False), dtype=np.int64)
    yield from _nodes(int(t["shard"][0].as_py()), t["conv_id"].to_numpy(), np.cumsum(size) - size, size, a, b, words)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends) of rows sorted by key and shard, each key's lists put through one digest."""
    key, digest = None, None
    for batch in batches:
        for k, text in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if k != key or digest is None:
                if digest is not None:
                    yield pa.RecordBatch.from_pydict({"key": [key], "ends": [digest.hexdigest()]})
                key, digest = k, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(text.encode())
    if digest is not None:
        yield pa.RecordBatch.from_pydict({"key": [key], "ends": [digest.hexdigest()]})


def _recombined(edges: DataFrame) -> DataFrame:
    """One row for each boundary node: what its shards know of it, with what two of them counted taken out once.

    A shard's first row may begin with nodes that an earlier shard has too, down to a depth ``both``: of these, the words of a
    node and the child that they go on by are counted twice. A shard's last row ends at a leaf, unless a later shard has that
    node too: as the same leaf again, or with a child."""
    span = edges.groupBy("key").agg(F.min("shard").alias("least"), F.max("shard").alias("most"))
    known = edges.join(sized(span), "key")
    earlier, later = F.col("shard") > F.col("least"), F.col("shard") < F.col("most")
    fix = known.groupBy("shard").agg(
        F.max(F.when(earlier, F.col("depth"))).alias("both"), F.max_by("wcum", F.when(earlier, F.col("depth"))).alias("upto"),
        F.bool_or(F.col("end_last") & later).alias("goes_on"),
    )
    known = known.join(sized(fix), "shard")
    again = F.col("first") & F.coalesce(F.col("depth") <= F.col("both"), F.lit(False))
    kids = F.col("n_children") - F.when(again & (F.col("depth") < F.col("both")), 1).otherwise(0)
    sw = F.col("sw") - F.when(again, F.col("upto") - F.col("wcum") + F.col("w")).otherwise(0)
    leaves = F.col("n_leaves") - F.when(F.col("last") & F.col("goes_on"), 1).otherwise(0)
    return known.groupBy("key").agg(
        F.min("pkey").alias("pkey"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), F.sum(kids).alias("n_children"),
        F.sum(leaves).alias("n_leaves"), F.sum("nw").alias("nw"), F.sum(sw).alias("sw"),
    )


def prefix_trie(convs: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node of the trie of
    conversations (conv_id, ids, words)."""
    spark = convs.sparkSession
    scratch = Scratch(spark)
    kept = scratch.keep(convs)
    turns = kept.agg(F.sum(F.size("ids") + 1)).first()[0] or 0
    few = min(int(spark.conf.get("spark.sql.shuffle.partitions")), turns // LEAST + 1)
    parted = kept.repartitionByRange(max(turns // TURNS + 1, few), "ids", "conv_id").withColumn("shard", F.spark_partition_id())
    found = scratch.keep(parted.mapInArrow(_shard, _SCHEMA))
    edges = found.where("j is not null")
    whole = scratch.keep(_recombined(edges))
    lists = edges.where("ends <> ''").select("key", "shard", "ends").repartition("key").sortWithinPartitions("key", "shard")
    digests = scratch.keep(lists.mapInArrow(_digests, "key binary, ends string"))

    parents = whole.select(F.col("key").alias("pkey"), F.col("conv_id").alias("parent_conv_id"))
    told = whole.join(sized(parents), "pkey", "left").join(sized(digests), "key", "left")
    out = ["conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", (F.col("nw") - F.col("sw")).alias("saved_tokens")]
    told = told.select(*out, F.coalesce("ends", F.lit(_NONE)).alias("ends_sha256"))
    above = edges.select("shard", F.col("j").alias("pj"), "key").join(sized(parents.withColumnRenamed("pkey", "key")), "key").drop("key")
    inner = found.where("j is null")
    inside = inner.where("pj is null").select(*out, F.col("ends").alias("ends_sha256"))
    below = inner.where("pj is not null").drop("parent_conv_id").join(sized(above), ["shard", "pj"])
    return told.unionByName(inside).unionByName(below.select(*out, F.col("ends").alias("ends_sha256")))
