"""The trie of conversation prefixes against plain Python, in one shard and in very many."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from calltide.llm import prefix_trie as p


def plain(rows):
    """{(members' sorted ids, depth)} would not tell nodes apart: nodes by their turns."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    made = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(own.get(c - c % 20, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in sorted(made.items()):
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        w = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = (len(members[k]) - 1) * w + sum(saved[x] for x in kids[k])
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in m if made[c] == k)
        parent = members[k[:-1]][0] if k else None
        out.append((m[0], len(k), parent, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = turns.withColumns({c: F.lit("x") for c in ("ids", "words", "shard", "key", "j", "base", "h", "t", "n")})
    got = p.prefix_trie(p.rebuilt(p.turn_ids(turns)))
    return sorted((tuple(r) for r in got.collect()), key=str)


def many(seed, n):
    """Conversations with a first turn that a third of all share, whole copies, prefixes of others, and very long ones."""
    r, rows = random.Random(seed), []
    long = [f"turn {k} of many" for k in range(70)]
    for c in range(n):
        kind = r.random()
        if kind < 0.3:
            texts = ["hello there"] + [r.choice(["a", "b c", ""]) for _ in range(r.randint(0, 4))]
        elif kind < 0.5:
            texts = ["the same", "whole conversation", "again and again", "x"]
        elif kind < 0.6:
            texts = long[: r.choice([14, 15, 16, 17, 31, 32, 33, 48, 70])]
        else:
            texts = [r.choice("abcde") * r.randint(1, 2) for _ in range(r.randint(1, 6))]
        rows += [(c, t, ("user", "assistant")[t % 2], x) for t, x in enumerate(texts)]
    return rows


@pytest.mark.parametrize("turns", [1 << 19, 40])
def test_against_plain_python(spark, turns, monkeypatch):
    monkeypatch.setattr(p, "TURNS", turns)
    rows = many(1, 220)
    assert trie(spark, rows) == plain(rows)


def test_many_shards_of_one_conversation(spark, monkeypatch):
    monkeypatch.setattr(p, "TURNS", 12)
    rows = [(c, t, "user", f"same {t}") for c in range(0, 400, 20) for t in range(3)] + [(c, 3, "user", "more") for c in (200, 380)]
    assert trie(spark, rows) == plain(rows)


def test_nulls_ties_repeats_and_empty(spark, monkeypatch):
    monkeypatch.setattr(p, "TURNS", 6)
    rows = [(1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (2, 5, "b", "z"), (2, 5, "a", "y"), (None, 0, "user", "lost"), (3, 1, "user", " \t\n"), (40, 0, None, "w " * 50_000), (-7, 0, "user", "x")]
    want = plain([r for r in rows if r[0] != -7])
    assert trie(spark, [r for r in rows if r[0] != -7]) == want
    assert len(trie(spark, rows)) >= len(want)
    assert trie(spark, []) == []
    assert trie(spark, [(5, 0, "user", "gone")]) == plain([(5, 0, "user", "gone")])
