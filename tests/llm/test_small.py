"""Each operator against plain Python on small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from calltide.llm import chat_format, decontaminate, html_text, ngram_join, paragraphs, pieces, pii, quality, secrets, simjoin, toxicity
from calltide.llm import queries as q
from tests.llm import brute

RANDOM = random.Random(5)
VOCABULARY = ["".join(RANDOM.choice("abcdefghij") for _ in range(RANDOM.randint(2, 7))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def edited(text, share, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) if r.random() < share else w for w in text.split(" "))


@pytest.fixture(scope="module")
def texts():
    base = [prose(n, n) for n in (1, 2, 3, 9, 12, 40, 120, 300)]
    out = [None, "", "  \n\t ", "One two", "one  TWO", *base, *base[3:]]
    out += [edited(base[k], s, 7 * k + i) for k in (5, 6, 7) for i, s in enumerate((0.01, 0.02, 0.03, 0.05, 0.1, 0.3))]
    out += [base[6] + "\n" + base[5] + "\n" + prose(15, 77), prose(30, 78) + "\n" + base[5], "é " + base[5] + "\n" + base[5], prose(20_000, 3)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), 1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node long, sig string").cache()


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_ngram_join(docs, texts):
    got = rows_of(ngram_join.ngram_groups(docs))
    sets = [brute.shingle_set(t, 3) for t in texts]
    want = brute.components(list(range(len(texts))), lambda a, b: brute.link(sets[a], sets[b], 90))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), want[i]) for i in range(len(texts))}


def test_ngram_join_of_near_copies(spark):
    """A group whose links form chains: every link counts, also those away from the least member."""
    base = prose(200, 1)
    texts = [edited(base, s, k) for k, s in enumerate([0.02, 0.03, 0.01, 0.04, 0.015] * 12)] + [prose(200, 2)] * 5
    got = rows_of(ngram_join.ngram_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    sets = [brute.shingle_set(t, 3) for t in texts]
    want = brute.components(list(range(len(texts))), lambda a, b: brute.link(sets[a], sets[b], 90))
    assert {i: r.component_id for i, r in got.items()} == want


def test_ngram_join_edges(spark, docs):
    assert ngram_join.ngram_groups(docs.limit(0)).count() == 0
    t = prose(50, 4)
    rows = spark.createDataFrame([(None, t), (7, t), (7, t), (None, None)], "doc_id long, text string")
    assert sorted((r.component_id or -1) for r in ngram_join.ngram_groups(rows).collect()) == [-1, 7, 7, 7]
    kept = ngram_join.deduplicated(spark.createDataFrame([(7, t), (7, t), (9, t), (3, None), (None, t)], "doc_id long, text string"))
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 7]


@pytest.mark.parametrize("percent", [70, 80, 90])
def test_signatures_lose_no_link(percent):
    r = np.random.default_rng(1)
    share = (100 - percent) / percent
    for n in (1, 2, 3, 5, 9, 10, 19, 20, 33, 60, 400):
        for _ in range(60):
            a = np.unique(r.integers(0, 2**63, n).astype(np.uint64) << np.uint64(1))
            gone = r.integers(0, int(n * share) + 2)
            b = np.unique(np.concatenate([a[gone // 2 :], r.integers(0, 2**63, r.integers(0, int(n * share) + 2)).astype(np.uint64) << np.uint64(1)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * len(np.union1d(a, b)):
                shared = np.isin(ngram_join._signatures(a, percent), ngram_join._signatures(b, percent)).any()
                assert shared or both == len(a) == len(b)
            x, y = simjoin.sketch(a, percent), simjoin.sketch(b, percent)
            least = min(len(x), len(y))
            differ = np.bitwise_count((simjoin._fold(x, least) ^ simjoin._fold(y, least)).view(np.uint64)).sum()
            assert differ <= len(a) + len(b) - 2 * both


def test_short_sets_make_no_signature():
    """A set linked only with its equals needs none, so unrelated short texts meet nowhere."""
    r = np.random.default_rng(2)
    assert not sum(len(ngram_join._signatures(r.integers(0, 2**63, 1).astype(np.uint64), 90)) for _ in range(300))
    shared = [set(ngram_join._signatures(np.unique(r.integers(0, 2**63, n).astype(np.uint64)), 80).tolist()) for n in range(2, 30) for _ in range(20)]
    assert sum(map(len, shared)) == len(set().union(*shared))


def test_large_group_under_the_threshold(spark):
    """Rows of the join across components stay linear: 600 near copies, most pairs of which are just under 0.9."""
    base = prose(150, 1)
    texts = [edited(base, 0.02 + 0.0001 * k, k) for k in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = []
    plain = simjoin.Scratch.keep

    def keep(self, df):
        out = plain(self, df)
        made.append((sorted(df.columns), out.count()))
        return out

    simjoin.Scratch.keep = keep
    try:
        got = {r.doc_id: r.component_id for r in ngram_join.ngram_groups(docs).collect()}
    finally:
        simjoin.Scratch.keep = plain
    sets = [brute.shingle_set(t, 3) for t in texts]
    assert got == brute.components(list(range(len(texts))), lambda a, b: brute.link(sets[a], sets[b], 90))
    assert max(n for c, n in made if c == ["a", "b"]) <= 20 * len(texts)
    assert max(n for c, n in made if "more" in c) <= 60 * len(texts)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.comp for r in simjoin.components(edges, simjoin.Scratch(spark)).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_substring_dedup(docs, texts):
    got = rows_of(paragraphs.substring_dedup(docs))
    places, sets = [], {}
    for i, t in enumerate(texts):
        found = list(brute.WORD.finditer(t or ""))
        for begin, end in brute.paragraphs(t or "", paragraphs.LEAST):
            key = tuple(brute.words(t[found[begin].start() : found[end - 1].end()]))
            sets[key] = brute.shingle_set(" ".join(key), 5)
            places.append((i, found[begin].start(), found[end - 1].end(), begin, end, key))
    keys = list(sets)
    index = {k: n for n, k in enumerate(keys)}
    classes = brute.components(list(range(len(keys))), lambda a, b: brute.link(sets[keys[a]], sets[keys[b]], 80))
    seen, want = set(), {i: [] for i in range(len(texts))}
    for i, a, b, wa, wb, key in places:
        c = classes[index[key]]
        if c in seen:
            runs = want[i]
            if runs and wa <= runs[-1][3]:
                runs[-1] = (runs[-1][0], b, runs[-1][2], wb)
            else:
                runs.append((a, b, wa, wb))
        seen.add(c)
    want = {i: [(a, b) for a, b, wa, wb in runs if wb - wa >= paragraphs.RUN] for i, runs in want.items()}
    assert any(want.values())
    assert {i: [tuple(map(int, s.split(":"))) for s in r.removed.split(",") if s] for i, r in got.items()} == want
    assert all(r.repeated == bool(want[i]) == bool(r.kept_in) for i, r in got.items())
    cut = rows_of(paragraphs.deduplicated(docs))
    for i, t in enumerate(texts):
        left = t
        for a, b in reversed(want[i]):
            left = left[:a] + left[b:]
        assert cut[i].text == left
    assert cut[0].lang == "en" and paragraphs.substring_dedup(docs.limit(0)).count() == 0
    assert paragraphs.tuned() == (6, 2)


def test_only_repeats_are_removed(spark):
    """What stands between two repeated sentences stays, however short it is."""
    one, two = prose(30, 1) + ".", prose(30, 2) + "!"
    new = "Patient Anna Smith died."
    rows = [(1, f"{one} {two}"), (2, f"{one}\n{new}\n{two}"), (3, f"{one} {prose(7, 3)}. {two}"), (4, f"{prose(9, 4)}. {one}\n{two}\n{new}"), (2, None)]
    frame = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, __id long, __th string, spans string")
    kept = sorted((r.doc_id, r.text) for r in paragraphs.deduplicated(frame).collect() if r.text is not None)
    assert kept == [(1, rows[0][1]), (2, f"\n{new}\n"), (3, f" {prose(7, 3)}. "), (4, f"{prose(9, 4)}. \n{new}")]


def test_passage_inside_other_text(spark):
    """A passage of over 50 words in the middle of lines is found; documents without it are left alone."""
    sentence = lambda k: prose(13, k).capitalize() + ". "
    passage = "".join(sentence(900 + k) for k in range(5))
    rows = [(k, sentence(3 * k) + prose(6, 500 + k) + " " + passage + prose(9, 600 + k) + ". " + sentence(3 * k + 1)) for k in range(6)]
    rows += [(100 + k, sentence(700 + k) + sentence(720 + k)) for k in range(6)]
    got = rows_of(paragraphs.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [i for i, r in sorted(got.items()) if r.repeated] == [1, 2, 3, 4, 5] and got[3].kept_in == [0]


SECRET_TEXTS = [
    None, "", 'token = "abc12"', "secret=token :abcdefgh", "API_KEY: xYz123456, passwd='q1w2e3r4'", "é token=" + "a" * 30, "AKIA" + "A1" * 8 + " AKIA123", "0123456789abcdef01234567 0123456789abcdef0123456",
    "PaSsWoRd = hunter22 password=", "token=0123456789abcdef0123456789abcdef", "日本 secret : zzzzzz\ntoken=\nabcdef", "0" * 5000,
]


def test_secret_base_spans(spark):
    docs = spark.createDataFrame(list(enumerate(SECRET_TEXTS)), "doc_id long, text string")
    for i, r in rows_of(secrets.find_secrets(docs)).items():
        assert ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.base) == brute.spans(SECRET_TEXTS[i], brute.SECRETS, brute.secret_ok)
        assert all(s.found == SECRET_TEXTS[i][s.start : s.end] for s in r.spans)
    assert secrets.find_secrets(docs.limit(0)).count() == 0


def test_secret_battery_finds_random_runs(spark):
    """Random keys without a name are added; long ordinary words are not."""
    r = random.Random(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(r.choice(letters) for _ in range(40)) for _ in range(30)]
    plain = ["".join(r.choice(["ther", "tion", "ing", "and", "ou", "re"]) for _ in range(9)) for _ in range(400)]
    rows = [(i, f"see {k} now") for i, k in enumerate(plain)] + [(1000 + i, f"é {k}") for i, k in enumerate(keys)]
    got = rows_of(secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")))
    hit = [i for i, x in got.items() if any(s.kind == "random" for s in x.spans)]
    assert sum(i >= 1000 for i in hit) >= 24 and not [i for i in hit if i < 1000]
    assert all(s.found == dict(rows)[i][s.start : s.end] for i in hit for s in got[i].spans)


PII_TEXTS = [
    None, "", "a@b.c.d@e.f", "a@b.c_x@d.e @x a@b", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4", "4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111", "+1 (234) 567-8901 +12 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7",
    "é mail é.x@y.zz!", "+49 30 1234567.", "x" * 3000 + "@" + "y" * 3000, "1 " * 3000, "4111 1111 1111 1111 5", "@" * 50,
]


def test_pii_base_spans(spark):
    docs = spark.createDataFrame([(i, t, "b", 1) for i, t in enumerate(PII_TEXTS)], "doc_id long, text string, base string, spans int")
    for i, r in rows_of(pii.find_pii(docs)).items():
        assert ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.base) == brute.spans(PII_TEXTS[i], brute.PII, brute.pii_ok)
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_pii_crf_adds_looser_forms(spark):
    r = random.Random(9)
    number = lambda: f"+{r.randint(1, 9)} ({r.randint(200, 999)}) {r.randint(200, 999)}-{r.randint(1000, 9999)}"
    rows = [f"{prose(8, k)} {number() if k % 2 else f'{VOCABULARY[k]}{k}@{VOCABULARY[k + 1]}.example.org'} {prose(8, k + 1)}" for k in range(120)]
    loose = ["call 1 (345) 678-9012 today please now", "write to abcde42 @ bcdef.example.org at once please"]
    docs = spark.createDataFrame(list(enumerate(rows + loose + [prose(60, 5)])), "doc_id long, text string")
    got = rows_of(pii.find_pii(docs))
    assert got[120].base == [] and [s.kind for s in got[120].spans] == ["phone"]
    assert got[121].base == [] and [s.kind for s in got[121].spans] == ["email"]
    assert got[122].spans == []
    masked = rows_of(pii.mask_pii(docs))
    assert "[phone]" in masked[120].text and masked[122].text == prose(60, 5)


def test_quality(spark, docs, texts):
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    got = rows_of(quality.quality_rules(docs, labels))
    assert {i: tuple(r)[1:7] for i, r in got.items()} == {i: brute.quality(t) for i, t in enumerate(texts)}
    assert not any(r.kept and r.base_failed for r in got.values())
    junk = spark.createDataFrame([(100, " ".join(["a b"] * 30)), (101, prose(30, 8) + " " + prose(30, 8) + "\nx\nx\n\n \nx")], "doc_id long, text string")
    assert {i: tuple(r)[1:7] for i, r in rows_of(quality.quality_rules(junk, labels.limit(0))).items()} == {r.doc_id: brute.quality(r.text) for r in junk.collect()}
    kept = quality.good_documents(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert quality.quality_rules(docs.limit(0), labels).count() == 0


def test_trees_are_monotone():
    from calltide.llm import trees

    r = np.random.default_rng(2)
    x = r.random((600, 3))
    y = ((x[:, 0] < 0.5) ^ (r.random(600) < 0.1)).astype(float)
    forest = trees.fit(x, y, np.array([-1, 0, 1]))
    assert ((forest.score(x) >= 0.5) == (y == 1)).mean() > 0.85
    grid = np.column_stack([np.linspace(0, 1, 50), np.full(50, 0.3), np.full(50, 0.6)])
    assert (np.diff(forest.score(grid)) <= 1e-12).all()
    assert (np.diff(forest.score(grid[:, [2, 1, 0]])) >= -1e-12).all()


def test_chats(spark):
    rows = [(1, 0, "user", "a <|end|>\n b\\b"), (1, 1, "user", None), (1, 2, "assistant", "[INST]</s>"), (2, 1, "b|x", ""), (2, 0, None, "x"), (2, 1, "b|x", ""), (None, None, "assistant", "é\n"), (3, 0, "assistant", "<|+|>"), (3, 1, "assistant", "y")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat_format.format_chats(turns).cache()
    for r in formatted.select("conv_id", "formatted", "loss_mask", chat_format.parse(F.col("formatted")).alias("turns")).collect():
        own = sorted(((t if t is not None else -1), role or "", text or "") for c, t, role, text in rows if c == r.conv_id)
        assert [tuple(t) for t in r.turns] == [(role, text) for _, role, text in own]
        assert sum(m.chars for m in r.loss_mask) == len(r.formatted)
        at, loss = 0, []
        for m in r.loss_mask:
            loss += [r.formatted[at : at + m.chars]] * m.loss
            at += m.chars
        plain = [x.replace("\\s", "[").replace("\\l", "<").replace("\\b", "\\") for x in loss]
        assert plain == [text for _, role, text in own if role == "assistant"]
        assert "[INST]" not in r.formatted and "</s>" not in r.formatted
    assert formatted.where("conv_id = 1").first().formatted.count("<|user|>") == 1
    assert chat_format.format_chats(turns.limit(0)).count() == 0


def test_leaks(spark):
    items = [(0, prose(30, 50)), (1, prose(15, 51)), (2, prose(3, 52)), (3, None), (4, prose(40, 53))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [None, "", prose(200, 60), prose(50, 61) + "\n" + items[0][1].upper() + " " + prose(20, 62), items[1][1], edited(items[4][1], 0.02, 4) + " " + prose(30, 63), prose(9, 64) + " " + items[4][1][:60], items[2][1] + " " + prose(50, 65)]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(3, texts[3], "k"), (None, texts[4], "k")], "doc_id long, text string, k string").cache()
    got = decontaminate.contamination(docs, bench).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        t = texts[4] if r.doc_id is None else texts[r.doc_id]
        assert r["items"] == ",".join(map(str, brute.leaks(t, items))) and r.contaminated == bool(r["items"])
    clean = decontaminate.decontaminated(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, t in enumerate(texts) if not brute.leaks(t, items)}
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_hamming_blocks_reach_the_radius():
    """Any fingerprint within RADIUS bits shares a listed block."""
    r = random.Random(1)
    mask = (1 << decontaminate.BITS) - 1
    for _ in range(300):
        a, flips = r.getrandbits(64), r.sample(range(64), decontaminate.RADIUS)
        b = a
        for f in flips:
            b ^= 1 << f
        assert any(bin((a >> decontaminate.BITS * k & mask) ^ (b >> decontaminate.BITS * k & mask)).count("1") <= decontaminate.RADIUS // decontaminate.BLOCKS for k in range(decontaminate.BLOCKS))


def test_simhash(spark):
    grams = [[5, -7, 123456789123, -(1 << 63)], [1], []]
    df = spark.createDataFrame([(g,) for g in grams], "g array<long>")
    for g, r in zip(grams, df.select(decontaminate.simhash("g").alias("p")).collect(), strict=True):
        want = sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in g) > len(g))
        assert r.p & ((1 << 64) - 1) == want


def test_pieces_round_trip(docs, texts, spark):
    v = pieces.Vocabulary.load()
    got = rows_of(pieces.encode(docs, v))
    assert all(r.exact for r in got.values()) and got[0].n_pieces == 0 and got[6].source == "s"
    back = rows_of(pieces.decode(pieces.encode(docs, v).drop("text"), v))
    assert all(back[i].text == (t or "") for i, t in enumerate(texts))
    coder = pieces.Coder(v)
    for t in ("▁", " ▁x", "  a  b ", "\t\n\r", "日本語 🎉", "</s><s>", "", "a" * 5000):
        assert coder.decode(coder.encode(t)) == t


def test_pieces_are_the_best_path():
    """Against dynamic programming over all pieces, with every score tried."""
    v = pieces.Vocabulary.load()
    score = {p: s for p, s, u in zip(v.pieces, v.scores, v.usable, strict=True) if u}
    coder = pieces.Coder(v)
    r = random.Random(4)
    for _ in range(200):
        t = "".join(r.choice("theraionsl é") for _ in range(r.randint(1, 14)))
        s = pieces.MARK + t.replace(" ", pieces.MARK)
        best = [0.0] + [-1e300] * len(s)
        for e in range(1, len(s) + 1):
            for b in range(max(0, e - 16), e):
                if s[b:e] in score:
                    best[e] = max(best[e], best[b] + score[s[b:e]])
        assert abs(sum(v.scores[i] for i in coder.encode(t)) - best[-1]) < 1e-9


def test_pieces_equal_the_library(texts):
    """The library's own best path under the same scores: the same ids, or others of the same score at ties."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    v = pieces.Vocabulary.load()
    with open(pieces.MODEL, "rb") as f:
        model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    model.trainer_spec.model_type = 1  # best path instead of merges
    for i, piece in enumerate(model.pieces):
        if v.usable[i]:
            piece.score = v.scores[i]
    library, coder = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString()), pieces.Coder(v)
    total = lambda ids: sum(v.scores[i] for i in ids)
    for t in [*filter(None, texts), "日本語 🎉 x", "a  b \t\n"]:
        ours, theirs = list(coder.encode(t)), library.encode(t)
        assert ours == theirs or abs(total(ours) - total(theirs)) < 1e-6 * len(ours) + 1e-3


def test_toxicity(spark):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        t = prose(r.randint(20, 60), 1000 + i).split(" ")
        if toxic:
            for _ in range(r.randint(2, 4)):
                t.insert(r.randrange(len(t)), r.choice(["Nastyword,", "vileword", "UGLYWORD!!"]))
        rows.append((i, " ".join(t)))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame([*rows, (9999, None), (9998, "")], "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = rows_of(toxicity.toxicity(docs, marks))
    held = [i for i, _, _ in labels if got[i].held_out]
    assert 60 < len(held) < 180
    assert sum(got[i].predicted == labels[i][2] for i in held) / len(held) > 0.95
    assert got[9999].score == got[9998].score and 0 <= got[9999].score < 0.5
    import zlib

    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert {x.predicted for x in toxicity.toxicity(docs, marks.where("toxic = 0")).collect()} == {0}
    assert toxicity.toxicity(docs.limit(0), marks).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu one</a></li><li><a href="/b">Two</a></li></ul></nav>
<!-- no --><div class="ad">Buy this now.</div><article><h1>Head {k} &amp; co</h1><p><b>First  para {k}.<br><p>Second&nbsp;one &lt;here&gt; a < b.</p></article><footer>&copy; x &middot; Foot.</footer></body></html>"""


def test_html(spark):
    pages = [(k, f"u{k}", PAGE.format(k=k)) for k in range(40)] + [(40, "u", None), (41, "u", ""), (42, "u", "plain"), (43, "u", "<p" * 2000)]
    df = spark.createDataFrame([(*p, "old") for p in pages], "page_id long, url string, html string, text string")
    got = rows_of(html_text.main_text(df), "page_id")
    assert all(got[k].text == f"Head {k} & co\nFirst para {k}.\nSecond one <here> a < b." for k in range(40))
    assert got[40].text == "" and got[41].text == "" and len(got) == len(pages)
    assert html_text.main_text(df.limit(0)).count() == 0


def test_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in q.queries()) == list(range(1, 11))


@pytest.mark.parametrize("good, bad", [(100, 20), (20, 100)])
def test_quality_verdict_at_two_table_sizes(spark, monkeypatch, good, bad):
    """Texts that tell nothing get their class's share, whether the sample of a class is cut or not."""
    monkeypatch.setattr(quality, "SAMPLE", 25)
    found = []
    for part in (5, 1):
        marks = [1] * (good // part) + [0] * (bad // part)
        docs = spark.createDataFrame([(i, prose(60, 1)) for i in range(len(marks))], "doc_id long, text string")
        labels = spark.createDataFrame([(i, m, 0) for i, m in enumerate(marks)], "doc_id long, quality int, toxic int")
        found.append({(round(r.score, 1), r.kept) for r in quality.quality_rules(docs, labels).collect()})
    assert found[0] == found[1] == {(round(good / (good + bad), 1), good > bad)}


def test_verbatim_passages_of_any_sentences(spark):
    """Repeated runs of 50 words and more are cut out whole: of short sentences, inside one line, and with a gap of short ones."""
    short = ". ".join(prose(5, 5000 + k) for k in range(11)) + "."
    line = prose(50, 5100)
    gap = " ".join(prose(n, 5200 + k) + "." for k, n in enumerate((8, 8, 1, 5, 3, 8, 8, 7, 7)))
    rows, want = [], {}
    for p, passage in enumerate((short, line, gap)):
        for k in range(3):
            before = f"é{p}{k} " + prose(40 + 7 * k, 6000 + 10 * p + k) + f" a{p}{k} "
            rows.append((10 * p + k, before + passage + f" z{p}{k} " + prose(30, 7000 + 10 * p + k)))
            want[10 * p + k] = [f"{len(before)}:{len(before) + len(passage)}"] if k else []
    rows += [(100, line.upper() + " " + prose(60, 8000)), (101, prose(60, 8001) + "\n\n" + line), (102, "again and again " * 30), (103, prose(49, 8002)), (104, "x " + prose(49, 8002)), (105, None)]
    rows += [(100, rows[-6][1])]
    want |= {100: [f"0:{len(line)}"], 101: [f"{len(prose(60, 8001)) + 2}:{len(prose(60, 8001)) + 2 + len(line)}"]}
    got = rows_of(paragraphs.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), verbatim=True))
    assert {i: [s for s in got[i].removed.split(",") if s] for i in want} == want
    assert got[101].kept_in == [10] and not got[105].repeated
    kept = rows_of(paragraphs.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), verbatim=True))
    assert len(kept[102].text.split()) >= paragraphs.RUN and kept[10].text == dict(rows)[10]


def test_kneser_ney_against_plain_python(spark, monkeypatch):
    """Discounts, continuation counts, shared backoff and the length-normalised difference, by class, of a toy corpus."""
    monkeypatch.setattr(toxicity, "LEAST", 1)
    monkeypatch.setattr(toxicity, "G2", -1.0)
    monkeypatch.setattr(toxicity, "MARGIN", 0.0)
    monkeypatch.setattr(toxicity, "tells", lambda c0, c1, n0, n1: (c0 + c1) > 0)
    r = random.Random(3)
    texts = [" ".join(r.choice(("you", "are", "a", "fine", "day", "bad" if k % 3 else "good", "fool" if k % 2 else "friend")) for _ in range(r.randint(3, 12))) for k in range(200)]
    toxic = {t: int("fool" in t and "bad" in t) for t in texts}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, toxic[t]) for i, t in enumerate(texts)], "doc_id long, toxic int")
    beta, model = toxicity._learn(docs, labels.withColumn("toxic", F.col("toxic").cast("long")), {k: list(toxic.values()).count(k) for k in (0, 1)})
    pairs, seen = ({0: {}, 1: {}}, {})
    for t, c in toxic.items():
        w = t.split()
        for p in set(zip(["<s>", *w[:-1]], w, strict=True)):
            pairs[c][p] = pairs[c].get(p, 0) + 1
    vocabulary = {w for t in toxic for w in t.split()}
    size = len(vocabulary) + 2

    def discount(counts):
        n1, n2 = list(counts).count(1), list(counts).count(2)
        return min(max(n1 / max(n1 + 2 * n2, 1), 0.05), 0.95)

    after = {c: {w: sum(x == w for _, x in pairs[c]) for w in vocabulary} for c in (0, 1)}
    everything = sum(sum(a.values()) for a in after.values())
    shared = {w: (after[0][w] + after[1][w] + 0.5) / (everything + 0.5 * size) for w in vocabulary}

    def word(c, w):
        d, total = discount(after[c].values()), sum(after[c].values())
        free = 1 - sum(max(n - d, 0) for n in after[c].values()) / total
        return max(after[c][w] - d, 0) / total + free * shared[w]

    def pair(c, u, w):
        d = discount(pairs[c].values())
        total = sum(n for (x, _), n in pairs[c].items() if x == u)
        if not total:
            return word(c, w)
        kept = sum(max(n - d, 0) for (x, _), n in pairs[c].items() if x == u)
        return max(pairs[c].get((u, w), 0) - d, 0) / total + (1 - kept / total) * word(c, w)

    def ratio(u, w):
        if (u, w) in pairs[0] or (u, w) in pairs[1]:
            return np.log(pair(1, u, w) / pair(0, u, w))
        return np.log(word(1, w) / word(0, w))

    for t in [*texts[:40], "fool friend fool good day day bad"]:
        w = t.split()
        want = np.mean([ratio(u, x) for u, x in zip(["<s>", *w[:-1]], w, strict=True)])
        assert abs(model.mean(pa.record_batch([pa.array([t])], names=["text"]))[0] - want) < 1e-9
    assert beta[0] > 0


def _site(k, style):
    """(html, main text) of a page: article, menu, advert, comments and footer in one of several mark-ups."""
    body = [prose(25, 9000 + 20 * k + j) + "." for j in range(3)]
    title, menu, talk = prose(6, 9500 + k), [prose(1, 9600 + 9 * k + j) for j in range(5)], prose(12, 9700 + k) + "."
    links = "".join(f"<li><a href='/{m}'>{m}</a>" for m in menu)
    if style == "plain":
        page = f"<html><head><title>{title}</title></head><body><nav><ul>{links}</ul></nav><article><h1>{title}</h1>" + "".join(f"<p>{b}</p>" for b in body)
        page += f"</article><div class='comments'><p>{talk}</p></div><footer>&copy; {menu[0]}</footer></body></html>"
    elif style == "omitted":  # no end tags where HTML lets one omit them
        page = f"<!DOCTYPE html><title>{title}</title><meta charset=utf-8><nav><ul>{links}</ul></nav><main><h1>{title}</h1>" + "".join(f"<p>{b}" for b in body)
        page += f"</main><aside class=sidebar><p>{talk}</aside><footer><p>&copy; {menu[0]}"
    elif style == "unclosed head":
        page = f"<html><head><title>{title}</title><style>p{{}}</style><body><nav>{links}</nav><article><h1>{title}</h1>" + "".join(f"<p>{b}" for b in body)
        page += f"</article><footer>&copy; {menu[0]}</footer>"
    else:  # deep: menu and main text nine levels and more inside
        wrap = lambda inner: "<div>" * 12 + inner + "</div>" * 12
        page = f"<html><body><nav>{wrap(f'<p>{talk}</p>')}</nav><article>{wrap(f'<h1>{title}</h1>' + ''.join(f'<p>{b}</p>' for b in body))}</article></body></html>"
    return page, "\n".join([title, *body])


def test_main_text_of_several_markups(spark):
    styles = ("plain", "omitted", "unclosed head", "deep")
    sites = [_site(k, styles[k % 4]) for k in range(60)]
    long = "<article><h1>x</h1>" + "".join(f"<p>{prose(30, k)}." for k in range(400)) + "</article><footer>y</footer>"
    rows = [(k, "u", page) for k, (page, _) in enumerate(sites)] + [(0, "u", sites[0][0]), (100, None, long), (101, "u", ""), (102, "u", None)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    found = {}
    for r in got:
        found.setdefault(r.page_id, []).append(r.text)
    right = [found[k][0] == want for k, (_, want) in enumerate(sites)]
    assert all(right), [styles[k % 4] for k, ok in enumerate(right) if not ok]
    assert len(found[0]) == 2 and len(set(found[0])) == 1 and found[101] == found[102] == [""]
    assert found[100][0] == "\n".join(["x", *(prose(30, k) + "." for k in range(400))])


def test_main_text_of_held_out_pages(spark):
    """Share of blocks labelled as built, on pages of mark-ups that were in the training sample and on one that was not."""
    train = [_site(k, ("plain", "omitted")[k % 2])[0] for k in range(60)]
    model = html_text.train(train)
    right = total = 0
    for k in range(100, 140):
        page, want = _site(k, ("plain", "omitted", "unclosed head", "deep")[k % 4])
        found = html_text.blocks(page)
        keep = model.decode(html_text.padded(html_text.features(found)), np.array([0, len(found)]))
        right += sum((b[0] in want.split("\n")) == bool(x) for b, x in zip(found, keep, strict=True))
        total += len(found)
    assert right / total >= 0.97, right / total


@pytest.mark.parametrize("copies", [1, 20])
def test_secret_battery_recall_and_false_discoveries(spark, copies):
    """Random tokens of three encodings against long ordinary words, names, paths and numbers, on a small and a larger table."""
    r = random.Random(17)
    sixty_four = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    word = lambda: r.choice(("configuration", "repository", "management", "international", "description", "understanding", "application"))
    plain = [
        lambda: "".join(word().capitalize() for _ in range(3)), lambda: "/".join(word() for _ in range(3)), lambda: "_".join([word(), word(), str(r.randint(1, 99))]),
        lambda: word() + word(), lambda: (word() + word()).upper(), lambda: str(r.randint(0, 9)) * 24, lambda: "2024-01-" + "-".join(str(r.randint(10, 28)) for _ in range(6)),
    ]
    secret = [lambda: "".join(r.choice(sixty_four) for _ in range(40)), lambda: "".join(r.choice(sixty_four[:52]) for _ in range(40)), lambda: "".join(r.choice(sixty_four[26:]) for _ in range(36))]
    rows, truth = [], {}
    for i in range(30 * copies):
        made = [(secret if (i + k) % 3 == 0 else plain)[(i // 3 + k) % (3 if (i + k) % 3 == 0 else 7)]() for k in range(4)]
        text, spans = "", set()
        for k, token in enumerate(made):
            if (i + k) % 3 == 0:
                spans.add((len(text), len(text) + len(token)))
            text += token + " and "
        rows.append((i, text))
        truth[i] = spans
    got = rows_of(secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")))
    found = {i: {(s.start, s.end) for s in g.spans if s.kind == "random"} for i, g in got.items()}
    hit, added, wanted = (sum(map(len, x)) for x in ([found[i] & truth[i] for i in truth], found.values(), truth.values()))
    assert hit / wanted >= 0.7 and hit / added >= 0.95, (hit, added, wanted)


def test_leak_with_words_inserted_in_its_middle(spark):
    """No window that lines up a shared shingle is similar enough, but one between two of them is."""
    item = [f"w{k}" for k in range(59)]
    leak = ["x", *item[1:29], "y", "z", *item[29:58], "q"]
    docs = spark.createDataFrame([(1, " ".join([f"a{k}" for k in range(20)] + leak + [f"b{k}" for k in range(20)])), (2, None)], "doc_id long, text string").withColumns({"__k": F.lit(1), "__th": F.lit(2)})
    bench = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    want = brute.leaks(docs.first().text, [(5, " ".join(item))])
    assert [(r.doc_id, r.contaminated) for r in decontaminate.contamination(docs, bench).orderBy("doc_id").collect()] == [(1, bool(want)), (2, False)]
    assert {r.doc_id for r in decontaminate.decontaminated(docs, bench).collect()} == ({2} if want else {1, 2})


def test_pii_added_spans_against_planted_ones(spark):
    """Recall and precision of the looser forms that the field adds, among dates, versions, prices and measures."""
    r = random.Random(23)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    name = lambda: prose(1, r.randint(0, 999))
    strict = [lambda: f"{name()}@{name()}.example.org", lambda: f"+49 {digits(3)} {digits(4)} {digits(3)}", lambda: f"+1 ({digits(3)}) {digits(3)}-{digits(4)}"]
    loose = [lambda: f"{name()} @ {name()}.example.org", lambda: f"{name()} (at) {name()}.example.org", lambda: f"1 ({digits(3)}) {digits(3)}-{digits(4)}"]
    plain = [lambda: f"on 2024-0{r.randint(1, 9)}-1{r.randint(0, 9)}", lambda: f"version {r.randint(1, 9)}.{r.randint(0, 9)}", lambda: f"price {digits(3)}.{digits(2)}", lambda: f"{digits(2)} x {digits(2)} cm", lambda: f"see {name()} at {name()}", lambda: f"room {digits(3)}"]
    rows, truth = [], {}
    for i in range(300):
        text, spans = prose(6, i) + " ", set()
        kind = (strict, loose, plain)[i % 3]
        for k in range(2):
            found = kind[(i // 3 + k) % len(kind)]()
            if kind is loose:
                spans.add((len(text), len(text) + len(found)))
            text += found + " " + prose(5, 1000 + 2 * i + k) + " "
        rows.append((i, text))
        truth[i] = spans
    got = rows_of(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")))
    added = {i: {(s.start, s.end) for s in g.spans} - {(s.start, s.end) for s in g.base} for i, g in got.items()}
    hit, made, wanted = (sum(map(len, x)) for x in ([added[i] & truth[i] for i in truth], added.values(), truth.values()))
    assert hit / wanted >= 0.8 and hit / max(made, 1) >= 0.9, (hit, made, wanted)
