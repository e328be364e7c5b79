"""The score of operator 2 against plain Python, with its own parameters, where tasks hold all pairs and where most are joined."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from calltide.llm import toxicity


def _plain(learn):
    """A text's means by the word and the pair models of (text, class) pairs."""
    texts = {t: c for t, c in learn}
    n = {}
    for t in texts:
        for w in set(t.split()):
            n[w] = n.get(w, 0) + 1
    known = {w for w, k in n.items() if k >= toxicity.LEAST}
    named = lambda t: [w if w in known else "?" for w in t.split()]
    paired = lambda w: list(zip(["<s>", *w], w, strict=False))
    pairs = ({}, {})
    for t, c in texts.items():
        for p in set(paired(named(t))):
            pairs[c][p] = pairs[c].get(p, 0) + 1
    ids = [*known, "?", "<s>"]
    after = [{w: sum(x == w for _, x in pairs[c]) for w in ids} for c in (0, 1)]
    everything = sum(sum(a.values()) for a in after)

    def discount(counts):
        n1, n2 = list(counts).count(1), list(counts).count(2)
        return min(max(n1 / max(n1 + 2 * n2, 1), 0.05), 0.95)

    def word(c, w):
        d, total = discount(after[c].values()), sum(after[c].values())
        free = 1 - sum(max(k - d, 0) for k in after[c].values()) / total
        return max(after[c][w] - d, 0) / total + free * (after[0][w] + after[1][w] + 0.5) / (everything + 0.5 * len(ids))

    def pair(c, u, w):
        d = discount(pairs[c].values())
        total = sum(k for (x, _), k in pairs[c].items() if x == u)
        if not total:
            return word(c, w)
        kept = sum(max(k - d, 0) for (x, _), k in pairs[c].items() if x == u)
        return max(pairs[c].get((u, w), 0) - d, 0) / total + (1 - kept / total) * word(c, w)

    mixed = lambda p0, p1: np.log((1 - toxicity.MIX) + toxicity.MIX * p1 / p0)

    def means(text):
        w = named(text)
        by_word = [mixed(word(0, x), word(1, x)) for x in w]
        by_pair = [mixed(pair(0, u, x), pair(1, u, x)) if (u, x) in pairs[0] or (u, x) in pairs[1] else m for (u, x), m in zip(paired(w), by_word, strict=True)]
        return (np.mean(by_word), np.mean(by_pair)) if w else (0.0, 0.0)

    return means


@pytest.mark.parametrize("held", [2_000_000, 12, 0])
def test_scores_are_those_of_all_words_and_pairs(spark, monkeypatch, held):
    monkeypatch.setattr(toxicity, "BROADCAST", held)
    r = random.Random(4)
    common = [f"w{k}" for k in range(25)]
    rows = []
    for i in range(250):
        t = [r.choice(common) if r.random() < 0.9 else f"rare{r.randrange(60)}" for _ in range(r.randint(4, 14))]
        if i % 3 == 0:
            t[r.randrange(len(t))] = r.choice(["mean", "cruel"])
        rows.append((i, " ".join(t), int(i % 3 == 0)))
    rows += [(300, rows[1][1], 0), (301, "w1 never seen w2", 0), (302, "", 0)]  # a copy, unseen pairs, no word
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, c) for i, _, c in rows[:250]], "doc_id long, toxic long")
    got = {x.doc_id: x.score for x in toxicity.toxicity(docs, labels).collect()}
    learn = [(t, c) for i, t, c in rows[:250] if zlib.crc32(str(i).encode()) % 5]
    use = labels.where(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"))
    beta, model = toxicity._learn(docs, use, {k: sum(c == k for _, c in learn) for k in (0, 1)})
    assert (model.rest is not None) == (held < 2_000_000)
    means = _plain(learn)
    for i, t, _ in rows:
        x = toxicity._features(*(np.array([m]) for m in means(t))) @ beta[:-1] + beta[-1]
        assert abs(got[i] - 1 / (1 + np.exp(-x[0]))) < 1e-9
    assert got[300] == pytest.approx(got[1], abs=1e-12)
