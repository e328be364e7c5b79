"""Collocations against plain Python: counts, cuts, phrases inside longer ones, ranks; and the trie that counts them."""

import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from calltide.llm import collocations as c
from calltide.llm.double_array import DoubleArray


def plain(rows, least, top=2000):
    """{lang: [(phrase, a, l, r, n, score)]}"""
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    asked = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    out = {}
    for (lang, p), a in asked.items():
        inside = any(
            100 * b >= 100 * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            for (x, q), b in asked.items() if x == lang
        )
        if not inside:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            out.setdefault(lang, []).append((" ".join(p), a, left, right, n[lang], score))
    return {k: sorted(v, key=lambda x: (-x[5], -x[1], x[0].encode()))[:top] for k, v in out.items()}


def found(spark, rows, **more):
    docs = spark.createDataFrame(rows, "text string, lang string").withColumns({x: F.lit(1) for x in ("word", "h", "n", "phrase", "shard", "words", "rank", "part")})
    out = {}
    for r in c.collocations(docs.repartition(3), **more).orderBy("lang", "rank").collect():
        at = out.setdefault(r.lang, [])
        at.append((r.phrase, r.a, r.l, r.r, r.n, r.score))
        assert r.rank == len(at)
    return out


def prose(seed, n, words):
    r = random.Random(seed)
    out = []
    while len(out) < n:
        out += r.choice([["New", "york"], ["a", "b", "c", "d", "e", "f"], ["the"], ["é", "日本"], [r.choice(words)], [r.choice(words)], ["the", r.choice(words)]])
        if r.random() < 0.2:
            out[-1] += r.choice([".", ",", "\n", "\x0b", " \t", "!?", " x"])
    return " ".join(out)


@pytest.mark.parametrize("shard", [250_000, 7])
def test_against_plain_python(spark, shard, monkeypatch):
    monkeypatch.setattr(c, "SHARD", shard)
    words = [f"w{k}" for k in range(30)]
    rows = [(prose(k, 120, words), ("en", "de", None, "")[k % 4 if k % 3 else 0]) for k in range(60)]
    rows += [(None, "en"), ("", None), (" \t\n. ", "fr"), ("one", "es"), (prose(99, 20_000, words), "en"), *[("copy of this very text here", "en")] * 30]
    top = 2000 if shard == 7 else 5
    assert found(spark, rows, least=25, top=top) == plain(rows, 25, top)


def test_no_rows(spark):
    assert found(spark, [(None, None), ("x y", "en")], least=2) == {}
    assert found(spark, [("x y x y", "en")], least=2) == plain([("x y x y", "en")], 2)


def test_double_array(tmp_path):
    r = np.random.default_rng(1)
    size = r.integers(1, 6, 4000)
    codes = np.where(np.arange(5) < size[:, None], np.minimum(r.zipf(1.4, (4000, 5)), 300), 0)
    codes, index = np.unique(codes, axis=0, return_index=True)
    trie, size = DoubleArray.build(codes, size[index]), size[index]
    number = {tuple(x[:k]): i for i, (x, k) in enumerate(zip(codes.tolist(), size, strict=True))}
    prefixes = {p[:k] for p in number for k in range(1, len(p) + 1)}
    asked = np.concatenate([codes, r.integers(0, 302, (3000, 5))])
    state, at = np.zeros(len(asked), dtype=np.int64), np.arange(len(asked))
    for k in range(5):
        state = trie.step(state, asked[at, k])
        for i, s in zip(at.tolist(), state.tolist(), strict=True):
            p = tuple(asked[i, : k + 1].tolist())
            assert (s >= 0) == (p in prefixes) and (s < 0 or trie.leaf[s] == number.get(p, -1))
        at, state = at[state >= 0], state[state >= 0]
    assert len(trie.check) < 4 * len(prefixes) + 700


@pytest.mark.parametrize("together", [1, 40, 1_000_000])
def test_runs_are_added_up_over_stretches(together, monkeypatch):
    monkeypatch.setattr(c, "TOGETHER", together)
    r = np.random.default_rng(5)
    stretches = [np.where(r.random(400) < 0.1, 0, r.integers(1, 7, 400)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(6)] + [np.zeros(2, dtype=np.uint64)]
    want = Counter(tuple(h[i : i + 3].tolist()) for h in stretches for i in range(len(h) - 2) if h[i : i + 3].all())
    every = SimpleNamespace(value=lambda h: np.ones(len(h), dtype=bool))
    full = SimpleNamespace(value=np.ones(2 << c.BUCKETS, dtype=bool))
    batches = (pa.RecordBatch.from_pydict({"hashes": pa.array([c.tokens.signed(h)], pa.list_(pa.int64()))}) for h in stretches)
    got, rows = Counter(), 0
    for b in c._run_rows(every, full, 3)(batches):
        rows += b.num_rows
        for t1, t2, t3, n in zip(*(b.column(x).to_numpy().view(np.uint64).tolist() for x in ("t1", "t2", "t3", "n")), strict=True):
            got[t1, t2, t3] += n
    assert got == want and (together < 1_000_000 or rows == len(want))


def test_a_frequent_run_fills_both_of_its_buckets():
    h = np.arange(1, 2000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at, bucket = c._at(h, lambda x: np.ones(len(x), dtype=bool), 4)
    assert len(at) == len(h) - 3 and bucket.shape == (2, len(at))
    assert bucket[0].max() < 1 << c.BUCKETS <= bucket[1].min() and bucket[1].max() < 2 << c.BUCKETS
    assert len(np.unique(bucket[0])) > 1900 and abs(np.corrcoef(bucket)[0, 1]) < 0.1
