"""The pipeline's stages in order, each against plain Python on what the stage before it kept."""


import pytest

import corpus_pipeline
from calltide.llm import pieces, quality
from tests.llm import brute
from tests.llm.test_small import edited, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sf"))
    items = [(0, prose(30, 50)), (1, prose(20, 51))]
    texts = [prose(60 + k, 2000 + k) for k in range(40)]
    texts += [edited(texts[0], 0.01, 1), texts[1], texts[1]]  # near and exact copies
    texts += [prose(40, 3000) + " " + items[0][1], items[1][1] + "\n" + prose(60, 3001)]  # leaks
    texts += [prose(30, 3100) + " mail ab12@example.org or +1 (234) 567-8901 " + prose(20, 3101)]
    texts += ["*** ".join(prose(50, 4000 + k).split(" ")) for k in range(15)] + ["again and again " * 30, "short", "", None]
    good = [1] * 46 + [0] * 15 + [0, 0, 0, 0]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, g, 0) for i, g in enumerate(good)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, texts, items


def test_stages(spark, folder, tmp_path):
    root, texts, items = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    names, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, root)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r.doc_id: r for r in docs.collect()})
    verdict = quality.quality_rules(spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet"))
    assert set(kept[0]) == {r.doc_id for r in verdict.where("kept").collect()}
    assert set(range(46)) <= set(kept[0]) and not set(kept[0]) & set(range(46, 65))
    ids = sorted(kept[0])
    sets = {i: brute.shingle_set(texts[i], 5) for i in ids}
    classes = brute.components(ids, lambda a, b: brute.link(sets[a], sets[b], 80))
    assert set(kept[1]) == set(classes.values()) and not {41, 42} & set(kept[1])
    assert set(kept[2]) == {i for i in kept[1] if not brute.leaks(texts[i], items)} and not {43, 44} & set(kept[2])
    assert set(kept[3]) == set(kept[2])
    for i, r in kept[3].items():
        assert r.n_chars == len(r.text)
        assert r.text == texts[i] or i == 45
    assert "[email]" in kept[3][45].text and "[phone]" in kept[3][45].text and "@" not in kept[3][45].text
    coder = pieces.Coder(pieces.Vocabulary.load())
    assert set(kept[4]) == set(kept[3]) and all(r.exact and coder.decode(r.ids) == kept[3][i].text for i, r in kept[4].items())
    assert {r.doc_id for r in corpus_pipeline.run(spark, root).collect()} == set(kept[4])


def test_near_copies_by_five_words_at_eighty(spark):
    """100 words, two of them replaced: 0.81 by five words, 0.885 by three."""
    text = [f"w{k}" for k in range(100)]
    near = [*text[:30], "x", *text[31:70], "y", *text[71:]]
    far = [w if k % 20 else f"z{k}" for k, w in enumerate(text)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate((text, near, far))], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.ngram_join(spark, docs, "").collect()} == {0, 2}
