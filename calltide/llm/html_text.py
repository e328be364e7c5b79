"""Operator 9: main text of web pages by a linear-chain CRF over DOM leaf blocks.

A page is cut into leaf blocks (text between block-level tags). Each has the tags and class names of all its ancestors, its
own tag, length, link share and punctuation as features; the CRF labels the blocks of a page in order and Viterbi
decoding finds the main ones. It is trained on ``SAMPLE`` pages at most (least hash of page_id), labelled by their own
sectioning markup (inside article or main, outside navigation, asides, forms, adverts, comments and the like), each
also in a copy whose sectioning tags are hidden, so that class names, text and order count where markup is poor.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined in page
order by one line feed; nothing else is dropped. Scripts, styles, comments, titles and text areas are no text. End tags that
HTML lets one omit are supplied: the head ends where a tag or text stands that it cannot hold, a paragraph at the next block,
list items, cells and options at the next one, and any element with its parent.

Defined results: null and empty html give the empty text; malformed tags are text if they are no tags at all; a script or style
that is never closed runs to the end, as in browsers, other elements do not; repeated rows are each extracted; a column ``text``
of the input gives way to the result; without pages there are no rows; without a page that marks its main text, all is kept.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltide.llm import crf
from calltide.llm.batches import bound
from calltide.llm.tokens import slices, strings

#: Pages that the CRF is trained on, at most.
SAMPLE = 200
#: Feature ids are hashes below this; 0 is no feature.
FEATURES = 1 << 12

_PART = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(title|textarea|iframe|template)\b[^>]*>(?:.*?</\2\s*>|[^<]*)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*)>|<[!?][^>]*>",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z0-9]+")
# HTML element kinds.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_CLOSED_BY_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}}
_HEAD = frozenset("base basefont bgsound link meta noscript template head html".split())
_MAIN = frozenset(("article", "main"))
_ASIDE = frozenset("nav header footer aside form menu dialog button".split())
_ASIDE_NAMES = frozenset("ad ads advert advertisement banner breadcrumb comment comments cookie disqus footer header menu nav navbar newsletter notice popup promo related share sidebar social sponsor widget".split())

Block = tuple[str, str, tuple[str, ...], tuple[str, ...], float]  # text, tag, ancestors' tags, their names, share of link text


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    tags: list[str] = []
    names: list[tuple[str, ...]] = []
    text: list[str] = []
    linked = in_link = 0

    def flush() -> None:
        nonlocal linked
        if text:
            clean = " ".join(html.unescape("".join(text)).split())
            if clean:
                out.append((clean, tags[-1] if tags else "", tuple(tags), tuple(n for x in names for n in x), min(1.0, linked / len(clean))))
            text.clear()
        linked = 0

    def close(k: int) -> None:
        del tags[k:], names[k:]

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            if "head" in tags and piece.strip():
                close(tags.index("head"))
            text.append(piece)
            if in_link:
                linked += len(piece.strip())

    done = 0
    for m in _PART.finditer(page):
        add(page[done : m.start()])
        done = m.end()
        tag = (m[4] or "").lower()
        if not tag:
            if m[1] or m[2]:
                text.append(" ")
            continue
        if tag in _INLINE:
            if tag == "a":
                in_link = 0 if m[3] else 1
            continue
        if tag == "br":
            text.append(" ")
            continue
        flush()
        if "head" in tags and not m[3] and tag not in _HEAD:
            close(tags.index("head"))
        if m[3]:
            if tag in tags:
                close(len(tags) - 1 - tags[::-1].index(tag))
            continue
        if tag in _CLOSES_P and "p" in tags:
            close(len(tags) - 1 - tags[::-1].index("p"))
        while tags and tags[-1] in _CLOSED_BY_LIKE.get(tag, ()):
            close(len(tags) - 1)
        if tag not in _VOID and not (m[5] or "").endswith("/"):
            tags.append(tag)
            names.append(tuple(_WORD.findall(" ".join(filter(None, (x for y in _NAMES.findall(m[5]) for x in y))).lower())) if m[5] and "=" in m[5] else ())
    add(page[done:])
    flush()
    return out


def _id(feature: str) -> int:
    return zlib.crc32(feature.encode()) % (FEATURES - 1) + 1


_ids: dict[str, int] = {}


def _known(feature: str) -> int:
    found = _ids.get(feature)
    if found is None:
        if len(_ids) > 100_000:
            _ids.clear()
        found = _ids[feature] = _id(feature)
    return found


def features(found: list[Block], hidden: bool = False) -> list[list[int]]:
    """Feature ids of the blocks of one page. ``hidden``: as if every ancestor were a div."""
    out = []
    for k, (text, tag, tags, names, link) in enumerate(found):
        own = [f"self {tag}"] if not (hidden and tag in _MAIN | _ASIDE) else []
        if not hidden:
            own += [f"in {t}" for t in dict.fromkeys(tags)]
        own += [f"name {n}" for n in dict.fromkeys(names)]
        own += [f"long {min(len(text).bit_length(), 10)}", f"link {int(link * 4)}", f"ends {text[-1] if not text[-1].isalnum() else 'a'}", f"stops {min(text.count('. '), 3)}", f"place {min(k, 3)}"]
        if text[0] in "©®":
            own.append("sign")
        out.append([_known(f) for f in own])
    return out


def padded(rows: list[list[int]]) -> np.ndarray:
    """The feature ids as one array; 0 is no feature."""
    wide = max(map(len, rows), default=1)
    return np.array([r + [0] * (wide - len(r)) for r in rows], dtype=np.int64).reshape(-1, wide)


def marked(block: Block) -> bool:
    """Whether the page's own markup makes the block main text."""
    return bool(_MAIN.intersection(block[2])) and not _ASIDE.intersection(block[2]) and not _ASIDE_NAMES.intersection(block[3])


def train(pages: list[str]) -> crf.Crf | None:
    ids: list[list[int]] = []
    labels: list[bool] = []
    first = [0]
    for page in pages:
        found = blocks(page)
        truth = [marked(b) for b in found]
        if any(truth):
            for hidden in (False, True):
                ids += features(found, hidden)
                labels += truth
                first.append(len(ids))
    if not ids:
        return None
    return crf.fit(padded(ids), np.array(labels, dtype=np.int64), np.array(first), FEATURES, 2, rounds=60)


def main_text(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """pages with ``text`` in place of the html."""
    spark = pages.sparkSession
    bound(spark)
    ids = pages.where(F.col(html_column).isNotNull() & F.col("page_id").isNotNull()).select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE)
    sample = pages.join(F.broadcast(ids), "page_id").select(F.col(html_column).alias("html")).distinct().orderBy(F.xxhash64("html")).limit(SAMPLE)
    model = spark.sparkContext.broadcast(train([r.html for r in sample.collect()]))  # SAMPLE pages at most

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, html_column):
            found = [blocks(p) for p in strings(batch.column(html_column)).to_pylist()]
            first = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
            rows = [x for page in found for x in features(page)]
            keep = model.value.decode(padded(rows), first) if model.value and rows else np.ones(first[-1], np.int64)
            texts = ["\n".join(b[0] for b, k in zip(page, keep[a:], strict=False) if k) for page, a in zip(found, first, strict=False)]
            at = batch.schema.get_field_index(html_column)
            rest = [c for k, c in enumerate(batch.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.string())], names=[*(n for n in batch.schema.names if n != html_column), "text"])

    others = [f for f in pages.schema if f.name not in ("text", html_column)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return pages.select(*(f.name for f in others), html_column).mapInArrow(extract, f"{schema}, text string")
