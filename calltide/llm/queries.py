"""Registered queries of the subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calltide.llm import chat_format, pieces
from calltide.llm.collocations import collocations
from calltide.llm.decontaminate import contamination
from calltide.llm.html_text import main_text
from calltide.llm.ngram_join import ngram_groups
from calltide.llm.paragraphs import substring_dedup
from calltide.llm.pii import KINDS, find_pii
from calltide.llm.prefix_trie import prefix_trie, rebuilt, turn_ids
from calltide.llm.quality import quality_rules
from calltide.llm.secrets import find_secrets
from calltide.llm.toxicity import toxicity
from calltide.llm.url_filter import host, url_verdicts
from calltide.session import read_table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans, and all spans."""
    found = find_secrets(read_table(spark, sf_dir, "documents"))
    found = found.select("doc_id", "base", _joined("base").alias("joined"), _joined("spans").alias("spans"))
    return found.select("doc_id", *(_counted("base", k) for k in ("assign", "access", "hex")), F.sha2("joined", 256).alias("base_sha256"), "spans")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of each text's pieces, and whether they decode to the text."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, pieces.Vocabulary.load()).select("doc_id", "n_pieces", "ids_sha256", "exact")


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _counted(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans, and all spans."""
    found = find_pii(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *(_counted("base", k) for k in KINDS), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_table(spark, sf_dir, "documents"), verbatim=True)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests read back from the formatted text; conversation -1 holds another template's control strings."""
    added = spark.sql("SELECT -1L AS conv_id, t AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    made = chat_format.format_chats(turns)
    read = made.select("conv_id", "formatted", chat_format.parse(F.col("formatted")).alias("turns"), chat_format.under_loss(F.col("formatted"), F.col("loss_mask")).alias("masked"))
    loss = F.array_join("masked", "")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digests = read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), whole.alias("whole"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return digests.select(
        "conv_id", "n_turns", F.sha2("whole", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"
    )


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_groups(read_table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


# The query's rules, and the sites whose pages its list names.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
LISTED_SITES = r"(^|\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\."


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list holds the URLs of all pages of the listed sites."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(host(F.col("url")).rlike(LISTED_SITES)).select("url")
    return url_verdicts(pages, listed, RULES)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations rebuilt with the first turns of another one."""
    return prefix_trie(rebuilt(turn_ids(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


OP8_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after FROM t
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
c AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '[\\\\<\\[]'))
    + CASE WHEN before IS DISTINCT FROM role THEN 5 + length(role) + len(regexp_extract_all(role, '[\\\\<\\[|]')) ELSE 5 END
    + CASE WHEN after IS DISTINCT FROM role THEN 8 ELSE 0 END AS chars FROM n)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, doc_id, unnest(string_split(translate(t, '.,;:!?' || chr(9) || chr(11) || chr(12) || chr(13), repeat(chr(10), 6) || ' ' || repeat(chr(10), 3)), chr(10))) AS piece FROM d),
w AS (SELECT lang, row_number() OVER () AS id, list_filter(string_split(piece, ' '), lambda x: x <> '') AS ws FROM p),
one AS (SELECT lang, id, unnest(ws) AS phrase, generate_subscripts(ws, 1) AS i FROM w),
run AS (
  SELECT lang, phrase AS w1, lead(phrase, 1) OVER v AS w2, lead(phrase, 2) OVER v AS w3, lead(phrase, 3) OVER v AS w4, lead(phrase, 4) OVER v AS w5
  FROM one WINDOW v AS (PARTITION BY id ORDER BY i)),
total AS (SELECT lang, count(*) AS n FROM one GROUP BY lang),
f1 AS (SELECT lang, phrase, count(*) AS f FROM one GROUP BY lang, phrase HAVING count(*) >= 100),
g AS (
  SELECT lang, 2 AS k, concat_ws(' ', w1, w2) AS phrase FROM run WHERE w2 IS NOT NULL UNION ALL SELECT lang, 3, concat_ws(' ', w1, w2, w3) FROM run WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, 4, concat_ws(' ', w1, w2, w3, w4) FROM run WHERE w4 IS NOT NULL UNION ALL SELECT lang, 5, concat_ws(' ', w1, w2, w3, w4, w5) FROM run WHERE w5 IS NOT NULL),
c AS (SELECT lang, k, phrase, count(*) AS a, string_split(phrase, ' ') AS ws FROM g GROUP BY lang, k, phrase HAVING count(*) >= 100),
f AS (SELECT lang, phrase, f FROM f1 UNION ALL SELECT lang, phrase, a FROM c),
cut AS (
  SELECT c.lang, c.phrase, c.a, j, x.f AS l, y.f AS r, n, CAST((1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM c CROSS JOIN unnest([1, 2, 3, 4]) AS u(j) JOIN total USING (lang)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[j + 1:k], ' ') WHERE j < k),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM c, unnest([2, 3, 4]) AS u(m), unnest(range(1, len(ws) - m + 2)) AS v(i) WHERE m < k GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""

OP12_SQL = r"""
WITH p AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
q AS (
  SELECT *, list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1, 's'), '&'),
    lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS asked FROM p),
k AS (
  SELECT *, CASE WHEN regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^(www|m)\.', '') <> '' THEN
    regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^(www|m)\.', '')
    || regexp_replace(regexp_replace(path, '(/index)?\.html?$', ''), '/+$', '')
    || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END END AS key FROM q),
listed AS (SELECT DISTINCT key FROM k WHERE regexp_matches(host, '(^|\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.')),
r(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
hosts AS (SELECT DISTINCT host, path FROM k),
best AS (
  SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM hosts JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, k.host, k.path, rule, coalesce(verdict, CASE WHEN listed.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, listed.key IS NOT NULL AS listed
FROM k LEFT JOIN best ON k.host = best.host AND k.path = best.path LEFT JOIN listed ON k.key = listed.key
"""


OP13_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
bytes AS (SELECT DISTINCT conv_id, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT) AS b FROM t),
c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b), lambda crc, x:
    list_reduce(list_prepend(xor(crc, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))) % 4 AS h FROM bytes),
r AS (
  SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND pos <= h
  UNION ALL SELECT c.conv_id, pos + h, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
seq AS (
  SELECT c.conv_id, coalesce(list(sha256(role || chr(0) || text) ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS ids,
    coalesce(list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS words
  FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
pre AS (SELECT conv_id, ids[1:d] AS k, d, CASE WHEN d = 0 THEN 0 ELSE words[d] END AS w, len(ids) = d AS ends FROM seq, unnest(range(0, len(ids) + 1)) AS u(d)),
node AS (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n, max(w) AS w, coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ends
  FROM pre GROUP BY k, d),
kids AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids ON node.k = kids.k AND node.d = kids.d),
below AS (
  SELECT k[1:a] AS k, a AS d, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n - 1) * w) AS saved FROM full_node, unnest(range(0, d + 1)) AS u(a) GROUP BY ALL)
SELECT x.conv_id, x.d AS depth, p.conv_id AS parent_conv_id, x.n AS n_convs, x.n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM full_node x JOIN below ON x.k = below.k AND x.d = below.d LEFT JOIN node p ON x.d > 0 AND p.d = x.d - 1 AND p.k = x.k[1:x.d - 1]
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_chat_format": OP8_SQL, "op11_collocations": OP11_SQL, "op12_url_filters": OP12_SQL, "op13_prefix_trie": OP13_SQL}
