"""URL verdicts against plain Python: rules, canonical forms, the Bloom filter and the exact join behind it."""

import random
import re

import pytest
from pyspark.sql import functions as F

from calltide.llm import queries as q
from calltide.llm import url_filter as u

URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/a?b#c", "http://example.com/en", "http://example.com/en/", "https://a.www.example.com/en/x",
    "http://notexample.com/en/x", "http://x.net/es/1", "http://x.net/fr/1.html", "http://net/fr/", "http://x.com", "http://x.com?q=/y", "http://x.org#/fr/", "a://b://c/d",
    "http://m.x.org:80/p/index.html?utm_source=a&b=2&a=1", "https://x.org/p?a=1&ref=z&b=2#top", "http://x.org/p/?a=1&b=2", "http://x.org/q\nr?a", "http://Ünï.org/ä",
]


def plain(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fit = [(len(h + p), v == "block", v, h + p) for v, h, p in q.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[2:] if fit else (None, None))


def rows(spark, urls):
    clash = {c: F.lit("x") for c in ("key", "block", "w0", "hit", "host", "path", "listed", "ruled")}
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns(clash)


def test_rules_hosts_and_paths(spark):
    got = {r.page_id: r for r in u.url_verdicts(rows(spark, URLS), rows(spark, []), q.RULES).collect()}
    for i, url in enumerate(URLS):
        host, path, verdict, rule = plain(url)
        assert tuple(got[i])[1:5] == (host, path, rule, verdict or "allow"), url
        assert not got[i].listed


def test_canonical_forms_meet(spark):
    same = [17, 18, 19]
    for i in same:
        got = u.url_verdicts(rows(spark, URLS), rows(spark, [URLS[i], None, URLS[i]])).collect()
        assert sorted(r.page_id for r in got if r.listed) == same
        assert all((r.verdict == "block") == r.listed and r.rule is None for r in got)


@pytest.mark.parametrize("shuffled", [False, True])
def test_filter_has_no_false_negatives_and_the_join_no_false_positives(spark, shuffled, monkeypatch):
    monkeypatch.setattr(u, "BLOCKS", 0 if shuffled else 900_000)
    r = random.Random(3)
    every = [f"https://h{r.randint(0, 50)}.org/{r.randint(0, 3000)}" for _ in range(6000)]
    listed = set(r.sample(sorted(set(every)), 900))
    got = u.url_verdicts(rows(spark, every), rows(spark, sorted(listed)))
    assert [x.listed for x in got.orderBy("page_id").collect()] == [e in listed for e in every]
    keys = rows(spark, sorted(listed)).select(u.canonical(F.col("url")).alias("key"))
    asked = u.possible(rows(spark, every).select("url", u.canonical(F.col("url")).alias("key")), u.bloom(keys, 29), 29)
    met = {x.url for x in asked.where("hit").collect()}
    assert listed <= met and len(met - listed) < 0.02 * len(set(every))


def test_repeated_rows_and_empty_tables(spark):
    pages = rows(spark, URLS[16:18] * 3)
    assert u.url_verdicts(pages, pages).where("listed").count() == 6
    assert u.url_verdicts(pages.limit(0), pages).count() == 0
    assert u.url_verdicts(pages, pages.limit(0)).where("listed").count() == 0
