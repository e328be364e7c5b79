"""A trie of code sequences as two arrays, built and walked with numpy.

The child of state s by code c is the place base[s] + c, if check at that place is s. The root is place 0 with base 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_WINDOW = 4096


@dataclass
class DoubleArray:
    base: np.ndarray
    check: np.ndarray
    leaf: np.ndarray  # at a state that ends a sequence, the sequence's number, else -1

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The states behind these ones by these codes (0: none), -1 where there is none."""
        to = self.base[state] + code
        to[(to < 0) | (to >= len(self.check)) | (code == 0)] = 0
        return np.where(self.check[to] == state, to, -1)

    @classmethod
    def build(cls, codes: np.ndarray, size: np.ndarray) -> DoubleArray:
        """Of different sequences, one a row of codes (1 and up), padded with 0."""
        by = np.lexsort(codes.T[::-1])
        codes, size = codes[by], size[by]
        taken = _Places(int(codes.max(initial=0)))
        node = np.zeros(len(codes), dtype=np.int64)  # the place of each row's prefix
        edges, ended, new = [], [], np.zeros(max(len(codes) - 1, 0), dtype=bool)
        for d in range(codes.shape[1]):
            ended.append((node[size == d], by[size == d]))
            new = new | (codes[1:, d] != codes[:-1, d])
            there = np.flatnonzero(size > d)
            if not len(there):
                break
            own = _first(np.concatenate([[True], new]), there)
            parent, code = node[there[own]], codes[there[own], d]
            place = taken.put(parent, code, root=d == 0)
            edges.append((parent, place))
            node[there] = place[np.cumsum(own) - 1]
        ended.append((node[size == codes.shape[1]], by[size == codes.shape[1]]))
        n = taken.top + 1
        check, leaf = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
        base = np.zeros(n, dtype=np.int64)
        for parent, place in edges:
            check[place] = parent
        for place, number in ended:
            leaf[place] = number
        for parent, b in taken.bases:
            base[parent] = b
        return cls(base, check, leaf)


def _first(changed: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Of the rows ``there``, those before which, since the one before them in the list, a prefix has changed."""
    total = np.cumsum(changed)
    out = np.ones(len(there), dtype=bool)
    out[1:] = total[there[1:]] != total[there[:-1]]
    return out


class _Places:
    """Free and taken places of the arrays while they are filled."""

    def __init__(self, codes: int):
        self.most, self.top, self.low, self.sparse = codes, 0, 1, 1
        self.used = np.zeros(2 * codes + 4 * _WINDOW, dtype=bool)
        self.used[0] = True
        self.bases: list[tuple[np.ndarray, np.ndarray]] = []

    def _room(self, upto: int) -> None:
        if upto + self.most + 2 * _WINDOW > len(self.used):
            self.used = np.concatenate([self.used, np.zeros(upto + self.most + 2 * _WINDOW, dtype=bool)])

    def put(self, parent: np.ndarray, code: np.ndarray, root: bool) -> np.ndarray:
        """Places for children, which come sorted by parent: those with sisters first, then single ones in what is left."""
        first = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
        n, out = np.diff(np.append(first, len(parent))), np.zeros(len(parent), dtype=np.int64)
        base = np.zeros(len(first), dtype=np.int64)
        if root:
            out[:] = code
            self.used[code] = True
            self.top = max(self.top, int(code.max()))
        else:
            for i in np.flatnonzero(n > 1)[np.argsort(-n[n > 1], kind="stable")]:
                c = code[first[i] : first[i] + n[i]]
                base[i] = self._fit(c)
                out[first[i] : first[i] + n[i]] = base[i] + c
            one = np.flatnonzero(n == 1)
            free = np.flatnonzero(~self.used[: self.top + 1])[: len(one)]
            free = np.concatenate([free, np.arange(self.top + 1, self.top + 1 + len(one) - len(free))])
            out[first[one]], base[one] = free, free - code[first[one]]
            self.top = max(self.top, int(free.max(initial=0)))
            self._room(self.top)
            self.used[free] = True
        self.bases.append((parent[first], base))
        return out

    def _fit(self, c: np.ndarray) -> int:
        """A base at which all codes fall on free places: near the lowest free ones, else where the last one was put behind all
        others, else behind all others."""
        for begin in (self.low, self.sparse):
            free = np.flatnonzero(~self.used[begin : begin + _WINDOW]) + begin
            if begin == self.low and len(free) < _WINDOW // 8 and self.low + _WINDOW <= self.top:
                self.low += _WINDOW
            bases = free[: max(1, 1_000_000 // len(c))] - c[0]
            if len(bases):
                self._room(int(bases[-1] + c[-1]))
            fits = np.flatnonzero(~self.used[bases[:, None] + c].any(axis=1)) if len(bases) else []
            if len(fits):
                return self._taken(int(bases[fits[0]]), c)
        self.sparse = self.top + 1
        return self._taken(self.top + 1 - int(c[0]), c)

    def _taken(self, base: int, c: np.ndarray) -> int:
        self.top = max(self.top, base + int(c[-1]))
        self._room(self.top)
        self.used[base + c] = True
        return base
