"""From shared signatures to exact similarity classes, in steps whose rows are linear in a group.

A bucket is all nodes with one signature. Buckets are first joined as trees: inside a batch, the least node with each
other one; across batches, the least of these with each of them. So a bucket's rows are one for each member, and what
many batches share meets once for each batch. The pairs are checked exactly and connected.

A bucket whose members are then in different components is open. In rounds, every member of an open bucket that is
not in its largest component names the nearest possible partners of other components; these are checked and connected,
refuted ones are remembered, and a bucket stays open while a member had more possible partners than it named. A bucket
in which nothing possible is left is closed, so no link that the signatures show is lost, and a round has ``MOST * 4 ** round``
rows for each member at most. Buckets of more than ``BLOCK`` members are compared in pairs of blocks.

What is possible is told by odd sketches: a bit differs only where sets have different members, so two sets whose
sketches differ in more bits than a link allows are no link. The bound is exact; sketches grow with the set's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltide.llm.tokens import U, mix, shingles, slices, words
from calltide.session import Scratch

#: Bits of the least odd sketch, and bits for each member by which linked sets may differ.
SKETCH, BITS = 512, 16
#: Members of a block, and words of sketches compared at a time.
BLOCK, CELLS = 2048, 1 << 20
#: Partners that a member names in the first round; four times as many in each further one.
MOST = 2

Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def sets(batch: pa.RecordBatch, size: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, sorted."""
    w = words(batch.column("text"), lower=True)
    return [np.unique(shingles(w.hash[a:b], size)) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]


def local_stars(sig: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    """(sig, a, b) of a batch's different (sig, node): the least node of each signature with itself, and with each other."""
    order = np.argsort(sig)
    sig, node = sig[order], node[order]
    opens = np.ones(len(sig), dtype=bool)
    opens[1:] = sig[1:] != sig[:-1]
    low = np.minimum.reduceat(node, np.flatnonzero(opens))[np.cumsum(opens) - 1] if len(sig) else node
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (sig, low, node)], names=["sig", "a", "b"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (sig, a, b): pairs once each, and of rows with a = b the least of a signature with each other one.
    Keeps two rows between batches."""
    last: tuple[int, int, int] | None = None
    root: tuple[int, int] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        sig, a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("sig", "a", "b"))
        fresh = np.ones(len(sig), dtype=bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        fresh[0] = (sig[0], a[0], b[0]) != last
        last = (sig[-1], a[-1], b[-1])
        pair = fresh & (a != b)
        sole = np.flatnonzero(fresh & (a == b))
        s, x = sig[sole], a[sole]
        opens = np.ones(len(s), dtype=bool)
        opens[1:] = s[1:] != s[:-1]
        if len(s) and root is not None and s[0] == root[0]:
            opens[0] = False
        place = np.cumsum(opens) - 1
        heads = x[opens]
        low = np.where(place >= 0, heads[np.maximum(place, 0)] if len(heads) else 0, root[1] if root else 0)
        if len(s):
            root = (s[-1], low[-1])
        out = [np.concatenate(z) for z in ((sig[pair], s[~opens]), (a[pair], low[~opens]), (b[pair], x[~opens]))]
        if len(out[0]):
            yield pa.RecordBatch.from_arrays([pa.array(z) for z in out], names=["sig", "a", "b"])


def stars(signatures: DataFrame) -> DataFrame:
    """Local stars to (sig, a, b): tree edges of every bucket with two nodes or more. Pairs of one batch are dealt out by
    themselves, so a signature's task gets a row for each batch that has it."""
    key = F.when(F.col("a") == F.col("b"), F.xxhash64("sig")).otherwise(F.xxhash64("sig", "b"))
    return signatures.repartition(key).sortWithinPartitions("sig", "a", "b").mapInArrow(_stars, "sig long, a long, b long")


def _star(large: bool) -> Mapper:
    """One half round over edges (u, v) sorted by (u, v): every node's neighbours get its least one, m, in its place. ``large``:
    rows are both ways round, and neighbours above u are linked with m; otherwise v < u, and u and its neighbours are. A node's
    rows are streamed; a row tells whether its edge is new, or was new in the half round before."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int] | None = None
        first = (0, 0)  # the node whose rows go on, and its m
        for batch in batches:
            if not batch.num_rows:
                continue
            u, v, new = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            fresh = np.ones(len(u), dtype=bool)
            fresh[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
            opens = np.ones(len(u), dtype=bool)
            opens[1:] = u[1:] != u[:-1]
            if last is not None:
                fresh[0], opens[0] = (u[0], v[0]) != last, u[0] != last[0]
            heads = np.flatnonzero(opens)
            place = np.cumsum(opens) - 1
            m = np.where(place >= 0, np.minimum(u, v)[heads[np.maximum(place, 0)]] if len(heads) else 0, first[1])
            last, first = (u[-1], v[-1]), (u[-1], m[-1])
            if large:
                keep = fresh & (v > u)
                out = (v[keep], m[keep], m[keep] != u[keep])
            else:
                rest = fresh & (v != m)
                out = (np.concatenate([u[opens], v[rest]]), np.concatenate([m[opens], m[rest]]), np.concatenate([new[opens], np.ones(rest.sum(), bool)]))
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["u", "v", "new"])

    return of


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp): the least node that links reach, for every node of an edge (a, b) between two nodes. Large and small stars
    (Kiveris and others, 2014) by turns: one shuffle each, and a logarithmic number of rounds, squared at worst."""
    step = lambda rows, large: rows.repartition("u").sortWithinPartitions("u", "v", F.desc("new")).mapInArrow(_star(large), "u long, v long, new boolean")
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), F.lit(False).alias("new"))
    while True:
        both = links.select("u", "v", F.lit(False).alias("new"))
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"), "new"))
        links = scratch.keep(step(step(both, True), False))
        if links.where("new").isEmpty():
            break
    own = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("comp"))
    return scratch.keep(own.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()))


def sketch(s: np.ndarray, percent: int) -> np.ndarray:
    """Odd sketch of a set as longs: each member turns over one bit. Halves of a sketch xor to the sketch of half its size."""
    allowed = len(s) * (100 - percent) // percent + 1
    bits = max(SKETCH, 1 << (BITS * allowed - 1).bit_length())
    odd = np.bincount((mix(s + U(7)) & U(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def sketches(found: list[np.ndarray], percent: int) -> pa.Array:
    rows = [sketch(s, percent) for s in found]
    first = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(first), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))


def _fold(x: np.ndarray, to: int) -> np.ndarray:
    while x.shape[-1] > to:
        x = x[..., : x.shape[-1] // 2] ^ x[..., x.shape[-1] // 2 :]
    return x


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, begin, length) of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    edge = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False).view(np.uint64), edge[:-1], np.diff(edge)  # bits are counted without sign


def _differ(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Bits by which the sketches of each row differ."""
    (x, at, n), (y, to, m) = _lists(left), _lists(right)
    out = np.zeros(len(n), dtype=np.int64)
    for a, b in {*zip(n.tolist(), m.tolist(), strict=True)}:
        rows = np.flatnonzero((n == a) & (m == b))
        for some in np.array_split(rows, max(1, len(rows) * max(a, b) // CELLS)):
            p = _fold(x[at[some][:, None] + np.arange(a)], min(a, b))
            q = _fold(y[to[some][:, None] + np.arange(b)], min(a, b))
            out[some] = np.bitwise_count(p ^ q).sum(axis=1)
    return out


def _possible(percent: int) -> Mapper:
    """The pairs (a, b) of (a, b, na, nb, sa, sb) that can be links by their sketches."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            ok = _differ(batch.column("sa"), batch.column("sb")) * (100 + percent) <= both * (100 - percent)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return of


def exact(size: int, percent: int) -> Mapper:
    """(a, b, link) of (a, b, ta, tb): whether they are a link by their whole shingle sets."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray] = (None, np.zeros(0))
        for batch in slices(batches, "tb"):
            link = []
            right = sets(batch.select(["tb"]).rename_columns(["text"]), size)
            for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), right, strict=True)):
                if last[0] != a:
                    last = (a, sets(batch.slice(i, 1).select(["ta"]).rename_columns(["text"]), size)[0])
                both = len(np.intersect1d(last[1], b, assume_unique=True))
                link.append(100 * both >= percent * (len(last[1]) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(link, pa.bool_())], names=["a", "b", "link"])

    return of


def _keys(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of each key whole, from rows sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = [batch.column(c).to_numpy() for c in columns]
        fresh = np.logical_or.reduce([k[1:] != k[:-1] for k in key])
        edge = [0, *(np.flatnonzero(fresh) + 1).tolist(), batch.num_rows]
        if held and any(held[-1].column(c)[0].as_py() != k[0] for c, k in zip(columns, key, strict=True)):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
                held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _nearest(percent: int, most: int) -> Mapper:
    """(sig, a, b, more) of members (sig, i, j, block, x, cx, n, sketch, refuted), sorted by (sig, i, j): the ``most`` nearest
    possible partners of each member outside the largest component, and whether it has more."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _keys(batches, ["sig", "i", "j"]):
            x, c, n, block = (group.column(k).to_numpy(zero_copy_only=False) for k in ("x", "cx", "n", "block"))
            names, count = np.unique(c, return_counts=True)
            if len(names) < 2:
                continue
            values, at, length = _lists(group.column("sketch"))
            least = int(length.min())
            bits = np.stack([_fold(values[a : a + m], least) for a, m in zip(at, length, strict=True)])
            refuted = group.column("refuted").to_pylist()
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            odd = c != names[count.argmax()]
            out: list[tuple[int, int, bool]] = []
            for left, right in {(i, j), (j, i)}:
                rows, cols = np.flatnonzero(odd & (block == left)), np.flatnonzero(block == right)
                if not len(cols):
                    continue
                for some in np.array_split(rows, max(1, len(rows) * len(cols) * least // CELLS)):
                    far = np.bitwise_count(bits[some][:, None] ^ bits[cols]).sum(axis=2, dtype=np.int64)
                    can = (far * (100 + percent) <= (n[some][:, None] + n[cols]) * (100 - percent)) & (c[some][:, None] != c[cols])
                    for r in np.flatnonzero(can.any(axis=1)):
                        there = cols[can[r]]
                        near = far[r][can[r]]
                        if refuted[some[r]]:
                            new = ~np.isin(x[there], refuted[some[r]])
                            there, near = there[new], near[new]
                        for y in there[np.argsort(near, kind="stable")[:most]]:
                            out.append((*sorted((int(x[some[r]]), int(x[y]))), len(there) > most))
            if out:
                a, b, more = zip(*out, strict=True)
                sig = pa.array(np.full(len(out), group.column("sig")[0].as_py()))
                yield pa.RecordBatch.from_arrays([sig, pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(more)], names=["sig", "a", "b", "more"])

    return of


def _open(found: DataFrame, comps: DataFrame) -> DataFrame:
    """(sig, x, size): members of the buckets of three nodes or more that are not in one component; of buckets with the same
    nodes, one."""
    of = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}"))
    placed = found.join(of("a"), "a", "left").join(of("b"), "b", "left")
    apart = (F.coalesce("ca", "a") != F.coalesce("cb", "b")).cast("int")
    buckets = placed.groupBy("sig").agg(F.count("*").alias("n"), F.min("a").alias("root"), F.sum(F.shiftright(F.xxhash64("b"), 20)).alias("s"), F.max(apart).alias("apart"))
    buckets = buckets.where("n > 1 and apart = 1").groupBy("n", "root", "s").agg(F.min("sig").alias("sig"))
    held = found.join(buckets.select("sig"), "sig", "left_semi").select("sig", F.col("b").alias("x"))
    every = held.union(buckets.select("sig", F.col("root").alias("x")))
    return every.join(buckets.select("sig", (F.col("n") + 1).alias("size")), "sig")


def _merged(comps: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """comps (node, comp) with components joined that links (a, b) connect: the graph of components is connected, not that of nodes."""
    of = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}"))
    placed = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    placed = scratch.keep(placed)
    if placed.isEmpty():
        return comps
    top = components(placed.select(F.col("ca").alias("a"), F.col("cb").alias("b")), scratch)
    own = placed.select(F.col("a").alias("node"), F.col("ca").alias("comp")).union(placed.select("b", "cb")).distinct()
    every = comps.unionByName(own.join(comps.select("node"), "node", "left_anti"))
    moved = every.join(top.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left")
    return scratch.keep(moved.select("node", F.coalesce("top", "comp").alias("comp")))


def _profiles(size: int, percent: int) -> Mapper:
    """(node, n, sketch) of (node, text)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = sets(batch, size)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([len(s) for s in found], pa.int64()), sketches(found, percent)], names=["node", "n", "sketch"])

    return of


def classes(
    signatures: DataFrame, payload: Callable[[DataFrame], DataFrame], size: int, percent: int, scratch: Scratch, profile: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """(node, comp) for every node that has a link: 100 * common shingles >= percent * all shingles, of ``size`` words.
    ``signatures`` are local stars; of the nodes asked for, ``payload(nodes)`` gives (node, text) and ``profile(nodes)`` (node, n,
    sketch). Without ``profile``, texts are short: those of all pairs are read once, and pairs are checked without sketches."""
    found = scratch.keep(stars(signatures))
    scratch.release()
    ends = lambda pairs: pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    pairs = scratch.keep(found.select("a", "b").distinct())
    short = None if profile else scratch.keep(payload(ends(pairs)))
    known = scratch.keep(profile(ends(pairs)) if profile else short.mapInArrow(_profiles(size, percent), "node long, n long, sketch array<long>"))
    side = lambda c: known.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))

    def links(candidates: DataFrame) -> DataFrame:
        candidates = scratch.keep(candidates)
        texts = scratch.keep(payload(ends(candidates))) if short is None else short
        left, right = (texts.select(F.col("node").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
        checked = candidates.join(right, "b").join(left, "a").select("a", "b", "ta", "tb").mapInArrow(exact(size, percent), "a long, b long, link boolean")
        checked = scratch.keep(checked)
        scratch.release()
        return checked

    near = pairs
    if profile:
        near = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_possible(percent), "a long, b long")
    checked = links(near)
    comps = components(checked.where("link"), scratch)
    members = scratch.keep(_open(found, comps))
    most = MOST
    while not members.isEmpty():
        no = checked.where("not link")
        no = no.select(F.col("a").alias("x"), F.col("b").alias("y")).union(no.select("b", "a")).groupBy("x").agg(F.collect_set("y").alias("refuted"))
        rows = members.join(comps.select(F.col("node").alias("x"), "comp"), "x", "left").join(known.withColumnRenamed("node", "x"), "x").join(no, "x", "left")
        blocks = F.greatest(F.ceil(F.col("size") / BLOCK).cast("int"), F.lit(1))
        rows = rows.withColumn("block", F.pmod(F.xxhash64("x"), blocks).cast("int"))
        other = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
        rows = rows.select("sig", "block", "x", F.coalesce("comp", "x").alias("cx"), "n", "sketch", F.coalesce("refuted", F.array().cast("array<bigint>")).alias("refuted"), other)
        rows = rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")
        rows = rows.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
        named = scratch.keep(rows.mapInArrow(_nearest(percent, most), "sig long, a long, b long, more boolean"))
        fresh = named.select("a", "b").distinct()
        if fresh.isEmpty():
            break
        more = links(fresh)
        members = scratch.keep(members.join(named.where("more").select("sig").distinct(), "sig", "left_semi"))
        comps = _merged(comps, more.where("link"), scratch)
        checked, most = checked.union(more), 4 * most
    return comps
