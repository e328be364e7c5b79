"""The looser forms that the field adds, each by itself: recall on planted ones, and nothing else added."""

import random
from collections import Counter

from calltide.llm import pii
from tests.llm.test_small import prose


def test_every_looser_form_is_found():
    r = random.Random(31)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    name = lambda: prose(1, r.randint(0, 999))
    strict = [lambda: f"{name()}@{name()}.example.org", lambda: f"+49 {digits(3)} {digits(4)} {digits(3)}", lambda: f"+1 ({digits(3)}) {digits(3)}-{digits(4)}"]
    loose = [
        lambda: f"{name()} @ {name()}.example.org", lambda: f"{name()} (at) {name()}.example.org", lambda: f"{name()} at {name()} dot example dot org",
        lambda: f"1 ({digits(3)}) {digits(3)}-{digits(4)}",
    ]
    plain = [lambda: f"on 2024-0{r.randint(1, 9)}-1{r.randint(0, 9)}", lambda: f"price {digits(3)}.{digits(2)}", lambda: f"see {name()} at {name()}", lambda: f"room {digits(3)}", lambda: f"the dot {name()} dot {name()}"]
    texts, planted = [], []
    for i in range(480):
        kind = (strict, loose, plain)[i % 3]
        text, spans = prose(6, i) + " ", {}
        for k in range(2):
            form = (i // 3 + k) % len(kind)
            made = kind[form]()
            if kind is loose:
                spans[len(text), len(text) + len(made)] = form
            text += made + (" at once " if r.random() < 0.2 else " ") + prose(5, 1000 + 2 * i + k) + " "
        texts.append(text)
        planted.append(spans)
    model = pii.train(sorted({t[a:b] for t in texts[:240] for a, b in pii.windows(t)}))
    found = pii._added(model, texts, [pii.base_spans(t) for t in texts])
    hit, there, wrong = Counter(), Counter(), 0
    for spans, got in zip(planted[240:], found[240:], strict=True):  # texts that the model was not trained on
        there.update(spans.values())
        places = {(a, b) for _, a, b in got}
        hit.update(form for span, form in spans.items() if span in places)
        wrong += len(places - set(spans))
    assert all(hit[form] >= 0.9 * n for form, n in there.items()), (hit, there)
    assert wrong <= 0.03 * sum(there.values()), (wrong, there)


def test_spans_are_trimmed_not_dropped():
    text = "write to abcde42 @ bcdef.example.org at once"
    tokens = [m.span() for m in pii._TOKEN.finditer(text)]
    first = next(k for k, (a, _) in enumerate(tokens) if text[a:].startswith("abcde"))
    assert text[slice(*pii._longest("email", text, tokens[first:-1]))] == "abcde42 @ bcdef.example.org"
    assert pii._longest("phone", text, tokens[first:-1]) is None
