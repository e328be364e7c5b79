"""Operator 4: personal data by base patterns and a linear-chain CRF over word-shape features.

Base spans are the leftmost non-overlapping matches of each kind that pass its check (contract of the query). The CRF
tags the tokens of windows around digits, ``@``, ``(at)`` and `` dot `` (every form, base or looser, has one of them), and
its spans are added where they, or what is left without two tokens at their ends, pass the kind's looser check and touch
no base span: mail addresses with spaces around their marks, ``(at)``, or at and dot in words, telephone numbers without
``+``, cards parted by full stops.

The labelled table is small: windows of at most ``SAMPLE`` documents that have such a mark (those with the least
hash of doc_id), ``PARTS`` of these at most, labelled by their base spans, together with rewritten copies in the looser
forms. A window with a looser form of its own is no label and is left out.

Defined results: null and empty texts have no spans; repeated rows are each searched; offsets are code points, end
exclusive; columns named base and spans give way to the results, others are kept; an empty table gives no rows; without any
labelled window only base spans are returned.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltide.llm import crf
from calltide.llm.batches import bound
from calltide.llm.tokens import slices, strings

KINDS = ("email", "ip", "card", "phone")
#: Documents that give labelled windows, at most.
SAMPLE = 400
#: Windows in the labelled table, at most.
PARTS = 4 * SAMPLE
#: Code points around a mark that a window takes in, besides what is left of the words there; around a dot in words, which may
#: stand far from the name before it, FAR.
REACH, FAR = 24, 60

# The contract's patterns, in a form that takes linear time on long runs.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){13,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]|\(at\)| dot ")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S")
_NO_DIGIT = re.compile(r"[^0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _valid(kind: str, text: str) -> bool:
    digits = _NO_DIGIT.sub("", text)
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def base_spans(text: str) -> list[Span]:
    """Base spans by start, then kind as listed."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", begin, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        out += [(kind, *m.span()) for m in pattern.finditer(text) if _valid(kind, m[0])]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches around the marks of all forms, grown to white space, merged where they meet."""
    out: list[list[int]] = []
    at = _TRIGGER.search(text)
    while at:
        reach = FAR if at[0] == " dot " else REACH
        begin, end = max(0, at.start() - reach), min(len(text), at.end() + reach)
        while begin and not text[begin - 1].isspace():
            begin -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        if out and begin <= out[-1][1]:
            out[-1][1] = end
        else:
            out.append([begin, end])
        at = _TRIGGER.search(text, end)
    return [(a, b) for a, b in out]


# Word shapes: digits by length, letters by case and length, each ASCII mark by itself, other characters.
_DIGITS, _LETTERS, _MARKS = 0, 24, 48
SHAPES = _MARKS + 130
#: Features of a token: the shapes two before to two after, with whether a space comes before it and after it.
FEATURES = 5 * SHAPES + 4 * SHAPES + 2 * 256
LABELS = 1 + 2 * len(KINDS)  # outside; first and further tokens of each kind


def _shape(token: str) -> int:
    if "0" <= token[0] <= "9":
        return _DIGITS + (min(len(token), 20) if len(token) > 3 or int(token) <= 255 else 21)
    if token[0].isalpha():
        case = 0 if token.islower() else 8 if token.isupper() else 16
        return _LETTERS + case + (7 if token in ("at", "dot") else min(len(token), 6))
    return _MARKS + (ord(token) if ord(token) < 128 else 129)


def features(tokens: list[tuple[int, int]], texts: list[str], first: list[int]) -> np.ndarray:
    """(tokens, 7) feature ids. Sequence i is texts[i] with the tokens first[i] to first[i + 1]."""
    n = len(tokens)
    code, gap, seq = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, text in enumerate(texts):
        before = -1
        for k in range(first[i], first[i + 1]):
            a, b = tokens[k]
            code[k], gap[k], seq[k], before = _shape(text[a:b]), int(a != before), i, b
    out = [code]
    for j, shift in enumerate((-2, -1, 1, 2), start=1):
        there = np.arange(n) + shift
        ok = (there >= 0) & (there < n)
        there = np.clip(there, 0, max(n - 1, 0))
        ok &= seq[there] == seq if n else ok
        out.append(j * SHAPES + np.where(ok, code[there], SHAPES - 1))
    after = np.ones(n, np.int64)
    after[:-1] = np.where(seq[1:] == seq[:-1], gap[1:], 1)
    out.append(5 * SHAPES + (2 * gap + after) * SHAPES + code)
    out.append(9 * SHAPES + np.minimum(code, 255) + 256 * gap)
    return np.stack(out, axis=1)


_ADDED = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|\(at\)|at) ?[A-Za-z0-9-]+(?: ?(?:\.|dot) ?[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(?:\.[0-9]+){3}"),
    "card": re.compile(r"[0-9]+(?:[ .-][0-9]+)*"),
    "phone": re.compile(r"\+?\(?[0-9][0-9]*(?:[ ().-]+[0-9]+){2,}"),
}


def _unlabelled(part: str, held: list[Span]) -> bool:
    """Whether a window has a looser form that base spans do not label: it tells neither what to find nor what to leave."""
    for kind, rx in _ADDED.items():
        for m in rx.finditer(part):
            if _valid(kind, m[0]) and not any(s < m.end() and m.start() < e for _, s, e in held):
                return True
    return False


def _table(texts: list[str]) -> tuple[list[str], list[list[Span]]]:
    """Labelled windows and their rewritten copies."""
    rows: list[tuple[str, list[Span]]] = []
    loose = {
        "email": [lambda s: s.replace("@", " @ "), lambda s: s.replace("@", " (at) "), lambda s: s.replace("@", " at ").replace(".", " dot ")],
        "phone": [lambda s: s.lstrip("+"), lambda s: re.sub(r"^\+[0-9]+ ", "", s), lambda s: re.sub(r"[ ()-]+", "-", s.lstrip("+"))],
        "card": [lambda s: ".".join(re.findall("....?", _NO_DIGIT.sub("", s)))],
    }
    for text in texts:
        spans = base_spans(text)
        for a, b in windows(text):
            held = [(k, s - a, e - a) for k, s, e in spans if a <= s and e <= b]
            part = text[a:b]
            if _unlabelled(part, held):
                continue
            rows.append((part, held))
            for i, (kind, s, e) in enumerate(held):
                if any(j != i and x < e and s < y for j, (_, x, y) in enumerate(held)):
                    continue
                made = [(new, len(new)) for f in loose.get(kind, []) if (new := f(part[s:e]))]
                if kind == "email":  # a word that is a mark inside an address is none behind it
                    made += [(f"{new} at", len(new)) for new in (part[s:e], *(new for new, _ in made))]
                for new, size in made:
                    moved = [(k, x + (len(new) - e + s) * (x >= e), y + (len(new) - e + s) * (x >= e)) for j, (k, x, y) in enumerate(held) if j != i]
                    rows.append((part[:s] + new + part[e:], [*moved, (kind, s, s + size)]))
    return [r[0] for r in rows], [r[1] for r in rows]


def _tokenised(texts: list[str]) -> tuple[list[tuple[int, int]], list[int]]:
    tokens, first = [], [0]
    for text in texts:
        tokens += [m.span() for m in _TOKEN.finditer(text)]
        first.append(len(tokens))
    return tokens, first


def train(texts: list[str]) -> crf.Crf | None:
    """The CRF of the labelled table made from ``texts``; none if the table has no span."""
    parts, spans = _table(texts)
    if not any(spans):
        return None
    tokens, first = _tokenised(parts)
    labels = np.zeros(len(tokens), dtype=np.int64)
    for i, held in enumerate(spans):
        for kind, s, e in held:
            inside = [k for k in range(first[i], first[i + 1]) if s <= tokens[k][0] and tokens[k][1] <= e]
            for k in inside:
                labels[k] = 2 + 2 * KINDS.index(kind)
            if inside:
                labels[inside[0]] -= 1
    return crf.fit(features(tokens, parts, first), labels, np.array(first), FEATURES, LABELS)


def _longest(kind: str, part: str, tokens: list[tuple[int, int]]) -> tuple[int, int] | None:
    """The tagged tokens' stretch that passes the looser check, without two of the tokens at most."""
    for less in range(min(3, len(tokens))):
        for front in range(less + 1):
            s, e = tokens[front][0], tokens[len(tokens) - 1 - less + front][1]
            if _ADDED[kind].fullmatch(part, s, e) and _valid(kind, part[s:e]):
                return s, e
    return None


def _added(model: crf.Crf, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """Spans that the CRF adds to each text."""
    owner = [(i, a, b) for i, text in enumerate(texts) for a, b in windows(text)]
    parts = [texts[i][a:b] for i, a, b in owner]
    out: list[list[Span]] = [[] for _ in texts]
    if not parts:
        return out
    tokens, first = _tokenised(parts)
    labels = model.decode(features(tokens, parts, first), np.array(first))
    for w, (i, begin, _) in enumerate(owner):
        k, end = first[w], first[w + 1]
        while k < end:
            if not labels[k]:
                k += 1
                continue
            kind, start = KINDS[(labels[k] - 1) // 2], k
            k += 1
            while k < end and labels[k] and labels[k] % 2 == 0 and (labels[k] - 1) // 2 == (labels[start] - 1) // 2:
                k += 1
            if (found := _longest(kind, parts[w], tokens[start:k])) is None:
                continue
            s, e = begin + found[0], begin + found[1]
            clear = not any(a < e and s < b for _, a, b in base[i][max(0, bisect_left(base[i], s, key=lambda x: x[1]) - 8) : bisect_right(base[i], e, key=lambda x: x[1])])
            if clear:
                out[i].append((kind, s, e))
    return out


def find_pii(docs: DataFrame) -> DataFrame:
    """docs with ``base`` and ``spans``, arrays of (kind, start, end), by start, then kind."""
    spark = docs.sparkSession
    bound(spark)
    ids = docs.where(F.col("text").rlike(_TRIGGER.pattern) & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parts = [t[a:b] for t in strings(batch.column("text")).to_pylist() for a, b in windows(t)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string())], names=["part"])

    sample = docs.join(F.broadcast(ids), "doc_id").select("text").distinct().mapInArrow(label, "part string")  # SAMPLE ids at most
    model = spark.sparkContext.broadcast(train(sorted(r.part for r in sample.distinct().orderBy(F.xxhash64("part")).limit(PARTS).collect())))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches):
            texts = strings(batch.column("text")).to_pylist()
            base = [base_spans(t) if _TRIGGER.search(t) else [] for t in texts]
            more = _added(model.value, texts, base) if model.value else [[] for _ in texts]
            every = [sorted(b + m, key=lambda s: (s[1], KINDS.index(s[0]))) if m else b for b, m in zip(base, more, strict=True)]
            rows = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans] for spans in x], kind) for x in (base, every)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *rows], names=[*batch.schema.names, "base", "spans"])

    array = "array<struct<kind: string, start: bigint, end: bigint>>"
    clean = docs.drop("base", "spans")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in clean.schema)
    return clean.mapInArrow(search, f"{schema}, base {array}, spans {array}")


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind, overlapping spans as one."""
    out, done = [], 0
    for kind, a, b in spans:
        if a >= done:
            out += [text[done:a], f"[{kind}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def mask_pii(docs: DataFrame) -> DataFrame:
    """docs with every span of ``text`` replaced by its kind in brackets and ``n_chars``, if there is one, counted anew."""
    clean = find_pii(docs).drop("base")

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            spans = [[(s["kind"], s["start"], s["end"]) for s in x] for x in batch.column("spans").to_pylist()]
            texts = [t if t is None or not s else masked(t, s) for t, s in zip(batch.column("text").to_pylist(), spans, strict=True)]
            yield batch.set_column(at, "text", pa.array(texts, pa.string())).drop_columns(["spans"])

    out = clean.mapInArrow(mask, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
