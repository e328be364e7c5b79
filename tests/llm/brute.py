"""Plain Python versions of the operators' contracts, for small tables."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def words(text, lower=True):
    text = text or ""
    return WORD.findall(text.translate(ASCII_LOWER) if lower else text)


def shingle_set(text, size):
    w = words(text)
    return frozenset(tuple(w[j : j + size]) for j in range(max(len(w) - size + 1, 1))) if w else frozenset()


def paragraphs(text, least):
    """(begin, end) words of sentences; short ones are part of the one before them, or of the next at the head of a line."""
    found, out = list(WORD.finditer(text)), []
    marks = tuple(".?!\u3002\uff01\uff1f\u0964")
    begin = 0
    for k, m in enumerate(found):
        last = k + 1 == len(found)
        line = last or "\n" in text[m.end() : found[k + 1].start()]
        if line or m[0].endswith(marks):
            out.append((begin, k + 1, not out or out[-1][3], line))
            begin = k + 1
    units = []
    for k, (a, b, head, _) in enumerate(out):
        joins = not head and (b - a < least or (out[k - 1][2] and out[k - 1][1] - out[k - 1][0] < least))
        units[-1:] = [(units[-1][0], b)] if joins else [*units[-1:], (a, b)]
    return [(a, b) for a, b in units if b - a >= least]


def components(ids, linked):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if linked(a, b):
                a1, b1 = sorted((top(a), top(b)))
                up[b1] = a1
    return {i: top(i) for i in ids}


def link(a, b, percent):
    return bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)


def spans(text, patterns, ok):
    out = []
    for rank, (kind, rx) in enumerate(patterns.items()):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(rx, text or "") if ok(kind, m)]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


SECRETS = {"assign": r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}


def secret_ok(kind, m):
    return len(m[2]) >= 6 if kind == "assign" else len(m[0]) >= (20 if kind == "access" else 24)


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def pii_ok(kind, m):
    digits = re.sub("[^0-9]", "", m[0])
    if kind == "ip":
        return all(int(x) <= 255 for x in m[0].split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def quality(text):
    w = words(text, lower=False)
    n = len(w)
    times = Counter(tuple(w[j : j + 8]) for j in range(n - 7))
    inside = {k for j in range(n - 7) if times[tuple(w[j : j + 8])] > 1 for k in range(j, j + 8)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(inside), n < 20 or 100 * len(inside) > 30 * n


def leaks(text, items, percent=80):
    w = words((text or "").lower(), lower=False)
    out = set()
    for item, t in items:
        v = words((t or "").lower(), lower=False)
        if len(v) < 5:
            continue
        grams = lambda x: Counter(tuple(x[j : j + 5]) for j in range(len(x) - 4))
        want = grams(v)
        for start in range(max(len(w) - len(v), 0) + 1):
            got = grams(w[start : start + len(v)])
            if got and 100 * sum((got & want).values()) >= percent * sum((got | want).values()):
                out.add(item)
    return sorted(out)
