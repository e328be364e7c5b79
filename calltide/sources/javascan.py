"""Facts of one Java text: a tokenizer and one walk along its brackets, in time linear in the text but for deep chains of calls."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

# Words that stand before a parenthesis without being calls, or begin no declaration.
KEYWORDS = frozenset(("if", "for", "while", "switch", "catch", "return", "synchronized", "super", "this", "new", "else", "try", "throw", "assert", "do", "case"))
NO_TYPE = frozenset(("return", "throw", "new", "else", "case", "package", "import", "goto", "yield", "assert", "break", "continue", "do", "default", "instanceof"))
MODIFIERS = frozenset(("public", "protected", "private", "static", "final", "abstract", "synchronized", "default", "native", "strictfp", "sealed", "transient", "volatile"))
TYPES = frozenset(("class", "interface", "enum", "record"))
# Annotations that mark request handlers.
HANDLER_CLASS = frozenset(("RestController", "Controller"))
HANDLER_METHOD = frozenset(("GetMapping", "PostMapping", "PutMapping", "DeleteMapping", "PatchMapping", "RequestMapping"))

#: A token with the white space and comments before it; the last one is the end of the text.
_TOKEN = re.compile(
    r"(?:\s+|//[^\n]*|/\*.*?\*/)*+(?:(?P<bad>/\*)"
    r"|(?P<text>\"\"\"(?:\\.|[^\\])*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+')"
    r"|(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<number>\d[\w.]*)|(?P<mark>->|::|\.\.\.|.)|(?P<end>\Z))",
    re.S,
)
_KINDS = ("", *_TOKEN.groupindex)
#: Tokens at which the walk stops, and those behind which a statement may begin.
_BRACKETS = frozenset("()[]{}")
_STOPS = frozenset(("(", ")", "{", "}", ";", ":", "->", "instanceof"))
_ENDS = frozenset(("{", "}", ";", ":", "->"))


@dataclass(slots=True)
class Fact:
    kind: str
    seq: int
    line: int
    class_name: str | None = None
    method_name: str | None = None
    method_line: int | None = None
    is_handler: bool = False
    name: str = ""
    type: str = ""
    value: str = ""
    receiver: str = ""
    modifiers: str = ""
    text: str = ""
    end: int | None = None
    params: list[dict[str, str]] = field(default_factory=list)


@dataclass(slots=True)
class _Frame:
    kind: str  # class, method or block
    name: str
    start: int  # token where the present statement begins
    parens: int = 0
    fact: Fact | None = None
    handler: bool = False
    params: list[dict[str, str]] | None = None  # a record's


class _Scan:
    def __init__(self, text: str):
        self.source, self.lines = text, text.split("\n")
        self.out: list[Fact] = []
        self.error = ""
        found = [(m.lastindex, m) for m in _TOKEN.finditer(text)]
        bad = next((k for k, (what, _) in enumerate(found) if what == 1), len(found))
        if bad < len(found):
            self.error = f"comment without end at line {text.count(chr(10), 0, found[bad][1].start(1)) + 1}"
        found = [f for f in found[:bad] if f[0] != len(_KINDS) - 1]
        self.kind = [_KINDS[what] for what, _ in found]
        self.word: list[str] = [m[what] for what, m in found]
        self.at: list[tuple[int, int]] = [m.span(what) for what, m in found]
        self.begins = [0]  # of each line
        for w in self.lines:
            self.begins.append(self.begins[-1] + len(w) + 1)
        self.close = self._pairs()

    def _pairs(self) -> dict[int, int]:
        """The closing bracket of each opening one, and the other way round; angles are no brackets here."""
        out, stack = {}, []
        for k, w in enumerate(self.word):
            if w not in _BRACKETS:
                continue
            if w in "([{":
                stack.append(k)
            else:
                if stack and self.word[stack[-1]] + w in ("()", "[]", "{}"):
                    out[k] = stack[-1]
                    out[stack.pop()] = k
                else:
                    self.error = self.error or f"bracket without partner at line {self.line(k)}"
        if stack:
            self.error = self.error or f"bracket without end at line {self.line(stack[-1])}"
        return out

    def line(self, k: int) -> int:
        """The line of a token, from 1."""
        return bisect_right(self.begins, self.at[k][0])

    def raw(self, a: int, b: int) -> str:
        """The source of the tokens a to b, b exclusive, white space as one space."""
        if b == a + 1 and self.kind[a] != "text":
            return self.word[a]
        return " ".join(self.source[self.at[a][0] : self.at[b - 1][1]].split()) if a < b else ""

    def angle(self, k: int) -> int:
        """Behind the type arguments that open at k; k if there are none."""
        depth, j = 0, k
        while j < len(self.word):
            w = self.word[j]
            depth += (w == "<") - (w == ">")
            if self.kind[j] == "mark" and w not in "<>,.?&[]@":
                return k
            j += 1
            if not depth:
                return j
        return k

    def type_end(self, k: int) -> int:
        """Behind the type that begins at k; k if none does."""
        word, kind, n = self.word, self.kind, len(self.word)
        j = k
        while j < n and kind[j] == "word" and word[j] not in NO_TYPE:
            j += 1
            if j == n:
                return j
            if word[j] == "<":
                behind = self.angle(j)
                if behind == j:
                    return k
                j = behind
            if j + 1 < n and word[j] == "." and kind[j + 1] == "word":
                j += 1
                continue
            while j + 1 < n and word[j] == "[" and word[j + 1] == "]":
                j += 2
            if j < n and word[j] == "...":
                j += 1
            return j
        return k

    def marks(self, k: int) -> tuple[int, list[str], list[str]]:
        """(behind them, annotations, modifiers) of what begins at k."""
        notes, words = [], []
        while k < len(self.word) and (self.kind[k] == "word" or self.word[k] == "@"):
            if self.word[k] == "@" and k + 1 < len(self.word) and self.word[k + 1] != "interface":
                k += 1
                while k + 2 < len(self.word) and self.word[k + 1] == ".":
                    k += 2
                notes.append(self.word[k])
                k += 1
                if k < len(self.word) and self.word[k] == "(":
                    k = self.close.get(k, k) + 1
            elif self.word[k] in MODIFIERS and not (self.word[k] == "default" and k + 1 < len(self.word) and self.word[k + 1] in (":", "->")):
                words.append(self.word[k])
                k += 1
            elif self.word[k] == "non" and self.word[k + 1 : k + 3] == ["-", "sealed"]:
                k += 3
            else:
                break
        return k, notes, words

    def parameters(self, a: int, b: int) -> list[dict[str, str]]:
        """The parameters between the brackets a and b."""
        out, k = [], a + 1
        while k < b:
            k, _, _ = self.marks(k)
            behind = self.type_end(k)
            if behind == k:
                break
            name = self.word[behind] if behind < b and self.kind[behind] == "word" else ""
            out.append({"type": self.raw(k, behind), "name": name})
            while behind < b and self.word[behind] != ",":
                behind = self.close.get(behind, behind) + 1
            k = behind + 1
        return out

    def add(self, kind: str, k: int, frames: list[_Frame], **more) -> Fact:
        owner = method = None
        for f in reversed(frames):
            if f.kind == "class":
                owner = owner or f
            elif f.kind == "method":
                method = method or f
        fact = Fact(kind, len(self.out), self.line(k), owner and owner.name, method and method.name, method.fact.line if method and method.fact else None, **more)
        fact.is_handler = fact.is_handler or bool(method and method.handler)
        self.out.append(fact)
        return fact

    def declaration(self, k: int, frames: list[_Frame]) -> None:
        """Variables declared, or a name given a value, by the statement that begins at k."""
        k, _, words = self.marks(k)
        behind = self.type_end(k)
        if behind == k or behind >= len(self.word):
            return
        if self.word[behind] == "=" and behind == k + 1 or self.word[k : k + 2] == ["this", "."] and self.word[behind] == "=":
            self.add("assignment", k, frames, name=self.word[behind - 1], value=self.raw(behind + 1, self.value_end(behind + 1)))
            return
        while self.word[behind] == "|":  # a catch of several types: the first one counts
            more = self.type_end(behind + 1)
            if more == behind + 1 or more >= len(self.word):
                return
            first, behind = self.raw(k, behind) if "|" not in self.raw(k, behind) else self.raw(k, behind).split("|")[0].strip(), more
        else:
            first = self.raw(k, behind).split("|")[0].strip()
        while behind + 1 < len(self.word) and self.kind[behind] == "word" and self.word[behind + 1] in ("=", ";", ":", ",", ")", "["):
            name, after = behind, behind + 1
            while self.word[after : after + 2] == ["[", "]"]:
                after += 2
            stop = self.value_end(after + 1) if after < len(self.word) and self.word[after] == "=" else after
            value = self.raw(after + 1, stop) if stop > after else ""
            self.add("variable", name, frames, name=self.word[name], type=first, value=value, modifiers=" ".join(words))
            if stop >= len(self.word) or self.word[stop] != ",":
                break
            behind = stop + 1

    def value_end(self, k: int) -> int:
        """Where the expression that begins at k ends: at a comma, semicolon or closing bracket of its own level."""
        angles = 0
        while k < len(self.word) and not (self.kind[k] == "mark" and (self.word[k] in ";)]}" or (self.word[k] == "," and not angles))):
            if self.word[k] == "<" and (behind := self.angle(k)) > k:
                k = behind
                continue
            k = self.close.get(k, k) + 1
        return k

    def receiver_start(self, k: int) -> int:
        """Where the expression begins that stands before the dot at k."""
        k -= 1
        while k >= 0:
            if self.word[k] in (")", "]") and k in self.close:
                k = self.close[k]
                if k and (self.kind[k - 1] == "word" and self.word[k - 1] not in KEYWORDS - {"this", "super"} or self.word[k - 1] in (")", "]", ">")):
                    k -= 1
                    if self.word[k] == ">":
                        while k and self.word[k] != "<":
                            k -= 1
                        k -= 1
                    continue
            if k and self.kind[k] == "word" and self.word[k - 1] == "new":
                return k - 1
            if k and self.word[k - 1] == ".":
                k -= 2
                continue
            return k
        return 0

    def call(self, k: int, frames: list[_Frame]) -> tuple[int, int, Fact] | None:
        """The call whose bracket opens at k, with where its expression begins and ends."""
        j = k - 1
        if self.word[j] == ">":  # new T<...>(, or a type argument before a name
            while j and self.word[j] != "<":
                j -= 1
            j -= 1
        if j < 0 or self.kind[j] != "word" or k not in self.close:
            return None
        first = j
        while first > 1 and self.word[first - 1] == "." and self.kind[first - 2] == "word":
            first -= 2
        end = self.close[k]
        text = lambda at: self.lines[self.line(at) - 1].strip()
        if first and self.word[first - 1] == "@":
            return None
        if first and self.word[first - 1] == "new":
            return first - 1, end, self.add("call", first - 1, frames, name="<init>", receiver=self.raw(first, j + 1).replace(" ", ""), value=self.raw(k + 1, end), text=text(first - 1))
        if self.word[j] in KEYWORDS or self.word[k - 1] == ">":
            return None
        start = j
        receiver = ""
        if j and self.word[j - 1] == ".":
            start = self.receiver_start(j - 1)
            receiver = self.raw(start, j - 1)
        return start, end, self.add("call", start, frames, name=self.word[j], receiver=re.sub(r"\s*\.\s*", ".", receiver), value=self.raw(k + 1, end), text=text(start))

    def walk(self) -> list[Fact]:
        frames = [_Frame("block", "", 0)]
        pending: _Frame | None = None
        places: dict[int, tuple[int, int]] = {}
        stops = [k for k, w in enumerate(self.word) if w in _STOPS]
        begins = [0, *(k + 1 for k in stops if self.word[k] in _ENDS and k + 1 < len(self.word))] if self.word else []
        for k in sorted({*stops, *begins}):
            w, top = self.word[k], frames[-1]
            if k == top.start and not top.parens:
                self.begin(k, frames)
            if w == "(":
                if top.kind == "class" and not top.parens and pending is None and "=" not in self.word[self.marks(top.start)[0] : k]:
                    pending = self.method(k, frames)
                elif (found := self.call(k, frames)) is not None:
                    places[found[2].seq] = (found[0], -found[1])
                if k and self.word[k - 1] in ("for", "try", "catch"):
                    self.declaration(k + 1, frames)
                top.parens += 1
            elif w == ")":
                top.parens -= top.parens > 0
            elif w == "instanceof" and k + 2 < len(self.word):
                behind = self.type_end(k + 1)
                if k + 1 < behind < len(self.word) and self.kind[behind] == "word":
                    self.add("variable", behind, frames, name=self.word[behind], type=self.raw(k + 1, behind))
            elif w == ";":
                if top.parens and self.word[self.opener(k)] == "try":
                    self.declaration(k + 1, frames)
                if not top.parens:
                    if pending:
                        pending.fact.end, pending = self.line(k), None
                    top.start = k + 1
            elif w == "{":
                frames.append(self.opened(k, frames, pending))
                if frames[-1] is pending:
                    pending = None
            elif w == "}" and len(frames) > 1:
                closed = frames.pop()
                if closed.fact:
                    closed.fact.end = self.line(k)
                if not frames[-1].parens and not (k + 1 < len(self.word) and self.word[k + 1] in (".", ",", ")", ";", "]")):
                    frames[-1].start = k + 1
            elif w in (":", "->") and not top.parens and self.word[top.start] in ("case", "default"):
                top.start = k + 1
        order = sorted((f.seq for f in self.out if f.kind == "call"), key=lambda s: places[s])
        slots = sorted(order)  # calls take the places of calls, outer ones first
        for slot, seq in zip(slots, [self.out[s] for s in order], strict=True):
            seq.seq = slot
        self.out.sort(key=lambda f: f.seq)
        if self.error:
            self.out.append(Fact("error", len(self.out), 0, value=self.error))
        return self.out

    def opener(self, k: int) -> int:
        """The word before the bracket that holds the token k."""
        depth = 0
        for j in range(k - 1, -1, -1):
            depth += (self.word[j] == ")") - (self.word[j] == "(")
            if depth < 0:
                return max(j - 1, 0)
        return 0

    def begin(self, k: int, frames: list[_Frame]) -> None:
        """What a statement that begins at k tells by its first words."""
        w = self.word[k]
        if w in ("import", "package") and frames[-1].kind == "block" and len(frames) == 1:
            j = k + 1 + (self.word[k + 1 : k + 2] == ["static"])
            stop = j
            while stop < len(self.word) and self.word[stop] != ";":
                stop += 1
            if stop > j:
                self.add(w, k, frames, type=self.raw(j, stop).replace(" ", ""), name=self.word[stop - 1])
        else:
            after, _, _ = self.marks(k)
            behind = self.type_end(after)
            declares = frames[-1].kind == "class" and behind + 1 < len(self.word) and self.word[behind + 1] == "("
            if not declares and not TYPES.intersection(self.word[after : after + 1]):
                self.declaration(k, frames)

    def method(self, k: int, frames: list[_Frame]) -> _Frame | None:
        """The declaration whose parameters open at k, directly inside a class."""
        top = frames[-1]
        j, notes, words = self.marks(top.start)
        if j < len(self.word) and self.word[j] == "<":
            j = self.angle(j)
        name = k - 1
        built = name == j and self.word[name] == top.name
        if self.kind[name] != "word" or k not in self.close or TYPES.intersection(self.word[j:name]) or not (built or self.type_end(j) == name):
            return None
        handles = top.handler or bool(HANDLER_METHOD.intersection(notes))
        kind = "" if built else self.raw(j, name)
        fact = self.add("method", name, frames, name=self.word[name], type=kind, modifiers=" ".join(words), params=self.parameters(k, self.close[k]), is_handler=handles)
        return _Frame("method", fact.name, 0, fact=fact, handler=handles)

    def opened(self, k: int, frames: list[_Frame], pending: _Frame | None) -> _Frame:
        """The frame that the brace at k opens."""
        top = frames[-1]
        if pending is not None and not top.parens:
            pending.start = k + 1
            return pending
        j, notes, _ = self.marks(top.start)
        if not top.parens and j + 1 < k and (self.word[j] in TYPES or self.word[j : j + 2] == ["@", "interface"]):
            name = self.word[j + 1 + (self.word[j] == "@")]
            handles = name.endswith("Controller") or bool(HANDLER_CLASS.intersection(notes))
            fact = self.add("class", j, frames, name=name, type=self.word[j], is_handler=handles)
            fact.is_handler = handles
            frame = _Frame("class", name, k + 1, fact=fact, handler=handles)
            if self.word[j] == "record" and self.word[j + 2] == "(":
                frame.params = self.parameters(j + 2, self.close.get(j + 2, j + 2))
                for p in frame.params:
                    self.add("variable", j, [*frames, frame], **p)
            return frame
        if top.kind == "class" and not top.parens and top.params is not None and j == k - 1 and self.word[j] == top.name:  # a record's compact constructor
            fact = self.add("method", j, frames, name=top.name, params=top.params, is_handler=top.handler)
            return _Frame("method", top.name, k + 1, fact=fact, handler=top.handler)
        if top.kind == "class" and not top.parens and k and self.word[k - 1] == ")":  # the body of an enum constant
            return _Frame("class", top.name, k + 1)
        if k and self.word[k - 1] == ")" and k - 1 in self.close:  # new T(...) { ... }: a class without a name of its own
            before = self.receiver_start(self.close[k - 1])
            if self.word[before] == "new":
                owner = next((f for f in reversed(frames) if f.kind == "class"), None)
                return _Frame("class", owner.name if owner else "", k + 1)
        return _Frame("block", "", k + 1)


def scan_text(text: str) -> list[Fact]:
    """The facts of one file; of a file that cannot be understood, an ``error`` with what went wrong."""
    try:
        return _Scan(text).walk()
    except Exception as why:  # one bad file must not end the scan of the others
        return [Fact("error", 0, 0, value=f"{type(why).__name__}: {why}")]
