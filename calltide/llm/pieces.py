"""Operator 3: SentencePiece encoding and decoding by an Aho-Corasick automaton and a single-pass Viterbi.

The automaton over all pieces reports, at each position, every piece that ends there (its output links); each report
relaxes the best score at its end. A character that no piece covers costs ``UNKNOWN`` below the least score, as in the
library, and is written as its byte pieces. A space becomes the mark U+2581 and a mark is put before the text; pieces
have the mark at their front only, so a text's best path is the best paths of its stretches from mark to mark, and a
stretch met again in a task is taken from a bounded table.

Scores: a unigram model's are used as they are (``scores="model"``). A merge vocabulary stores merge order instead of
log-probabilities; ``scores="rank"`` gives piece r the log-probability of Zipf's law, -log(r + 1). Ids under "rank"
are the best path under these scores, not the merge result. Decoding needs no scores.

Decoding gives back every text exactly: a literal U+2581 is written in byte pieces, and control pieces never occur.
Defined results: null and empty texts have no pieces and decode to the empty text; repeated rows are each encoded;
other columns are kept, but those named as a result column (ids, n_pieces, ids_sha256, exact; the text of ``decode``) give way
to it; an empty table gives no rows.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from hashlib import sha256
from math import inf

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from calltide.llm.batches import bound
from calltide.llm.tokens import slices, strings

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN = 10.0
#: Stretches that a task remembers, at most, and the longest one it remembers.
MEMORY, STRETCH = 100_000, 64


class Vocabulary:
    """Pieces and scores by id. ``byte[b]`` is the id of byte b's piece."""

    def __init__(self, pieces: list[str], scores: list[float], usable: list[bool], byte: list[int]):
        self.pieces, self.scores, self.usable, self.byte = pieces, scores, usable, byte

    @classmethod
    def load(cls, model: str = MODEL, scores: str = "rank") -> Vocabulary:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=model)
        ids = range(p.get_piece_size())
        pieces = [p.id_to_piece(i) for i in ids]
        usable = [not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i)) for i in ids]
        value = [p.get_score(i) for i in ids]
        if scores == "rank":
            place = {i: r for r, i in enumerate(sorted((i for i in ids if usable[i]), key=lambda i: (-value[i], i)))}
            value = [-float(np.log(place[i] + 1)) if i in place else 0.0 for i in ids]
        return cls(pieces, value, usable, [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)])


class Coder:
    """Encodes and decodes in one task."""

    def __init__(self, vocabulary: Vocabulary):
        self.machine = ahocorasick.Automaton()
        singles, covered, least = set(), set(), 0.0
        for i, (piece, score) in enumerate(zip(vocabulary.pieces, vocabulary.scores, strict=True)):
            if vocabulary.usable[i]:
                self.machine.add_word(piece, (len(piece), score, i))
                least = min(least, score)
                covered.update(piece)
                if len(piece) == 1:
                    singles.add(piece)
        for c in covered - singles:  # else a path could end before it
            self.machine.add_word(c, (1, least - UNKNOWN, -1))
        self.machine.make_automaton()
        self.covered, self.byte = covered, vocabulary.byte
        self.known: dict[str, array] = {}
        self.plain = [p.replace(MARK, " ").encode() for p in vocabulary.pieces]
        for b, i in enumerate(vocabulary.byte):
            self.plain[i] = bytes((b,))

    def _path(self, part: str) -> list[int]:
        """The best path over covered characters, in one pass over the automaton's reports."""
        n = len(part)
        best, cut, piece = [0.0] + [-inf] * n, [0] * (n + 1), [-1] * (n + 1)
        for end, (size, score, i) in self.machine.iter(part):
            begin = end + 1 - size
            reach = best[begin] + score
            if reach > best[end + 1]:
                best[end + 1], cut[end + 1], piece[end + 1] = reach, begin, i
        out: list[int] = []
        while n:
            out += [piece[n]] if piece[n] >= 0 else [self.byte[b] for b in reversed(part[n - 1].encode())]
            n = cut[n]
        return out[::-1]

    def _best(self, part: str, literal: str = "") -> array:
        """Characters that no piece covers, and the stand-in for a literal mark, are written in bytes."""
        if self.covered.issuperset(part) and not literal:
            return array("i", self._path(part))
        out, begin = array("i"), 0
        for k, c in enumerate(part):
            if c == literal or c not in self.covered:
                out.extend(self._path(part[begin:k]))
                out.extend([self.byte[b] for b in (MARK if c == literal else c).encode()])
                begin = k + 1
        out.extend(self._path(part[begin:]))
        return out

    def encode(self, text: str) -> array:
        out = array("i")
        if not text:
            return out
        literal = ""
        if MARK in text:
            literal = next(c for c in map(chr, range(0xE000, 0x10FFFF)) if c not in text)
            text = text.replace(MARK, literal)
        known, get, part = self.known, self.known.get, ""
        for word in text.split(" "):
            part += MARK + word
            if not word:  # a run of marks belongs to the word after it
                continue
            ids = get(part) if not literal else None
            if ids is None:
                ids = self._best(part, literal)
                if len(part) <= STRETCH and not literal:
                    if len(known) >= MEMORY:
                        known.clear()
                    known[part] = ids
            out.extend(ids)
            part = ""
        if part:
            out.extend(self._best(part))
        return out

    def decode(self, ids: array) -> str:
        """Without the mark put before the text."""
        return b"".join(map(self.plain.__getitem__, ids)).decode()[1:]


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """docs with ``ids``, the piece ids of each text, ``n_pieces``, their number, ``ids_sha256``, the digest of the ids as
    little-endian 32-bit numbers, and ``exact``, whether they decode to the text."""
    bound(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by the vocabulary
    clean = docs.drop("ids", "n_pieces", "ids_sha256", "exact")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in slices(batches, text):
            texts = strings(batch.column(text)).to_pylist()
            ids = [coder.encode(t) for t in texts]
            flat = pa.array(np.concatenate([np.frombuffer(x, np.int32) for x in ids]))
            size = np.array([len(x) for x in ids])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), flat)
            more = [lists, pa.array(size), pa.array([sha256(x.tobytes()).hexdigest() for x in ids]), pa.array([coder.decode(x) == t for x, t in zip(ids, texts, strict=True)])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "ids", "n_pieces", "ids_sha256", "exact"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in clean.schema)
    return clean.mapInArrow(run, f"{schema}, ids array<int>, n_pieces long, ids_sha256 string, exact boolean")


def decode(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids", into: str = "text") -> DataFrame:
    """rows with ``into``, the text of each id list; null or empty lists give the empty text."""
    bound(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    clean = rows.drop(into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            texts = [coder.decode(x or []) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, into])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in clean.schema)
    return clean.mapInArrow(run, f"{schema}, `{into}` string")
