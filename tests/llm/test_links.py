"""Substring dedup: a run that repeats several texts is linked with each of them."""

from calltide.llm import paragraphs
from tests.llm.test_small import prose


def test_a_run_of_two_sources_keeps_both_links(spark):
    one, two = prose(110, 901).split(" "), prose(200, 902).split(" ")
    two[:50] = one[60:]  # the second text begins with what the first ends with
    rows = [(1, " ".join(one)), (2, " ".join(two)), (3, " ".join(one + two[50:])), (4, prose(90, 903)), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in paragraphs.substring_dedup(docs, verbatim=True).collect()}
    assert got[3].repeated and got[3].removed == f"0:{len(rows[2][1])}"
    assert sorted(got[3].kept_in) == [1, 2]
    assert got[2].kept_in == [1] and not any(got[k].repeated for k in (1, 4, 5))
