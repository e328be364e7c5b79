"""A linear-chain conditional random field in numpy: fitting, and Viterbi decoding of many sequences at a time.

A token has the same number of feature ids as any other of its call; the id 0 is no feature and has no weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Cells (sequences x steps) of one padded batch.
CELLS = 1 << 15


@dataclass
class Crf:
    """``weight`` (features, labels), ``step`` (labels, labels), ``begin`` (labels)."""

    weight: np.ndarray
    step: np.ndarray
    begin: np.ndarray

    def decode(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Best labels. ids (tokens, features of a token); sequence i has the tokens first[i] to first[i + 1]."""
        out = np.zeros(len(ids), dtype=np.int64)
        for place, real in _padded(first):
            score = self.weight[ids[place]].sum(axis=2)
            n, most, _ = score.shape
            best = score[:, 0] + self.begin
            back = np.zeros((n, most, len(self.begin)), dtype=np.int8)
            for t in range(1, most):
                reach = best[:, :, None] + self.step
                back[:, t] = reach.argmax(axis=1)
                best = np.where(real[:, t, None], reach.max(axis=1) + score[:, t], best)
            label = best.argmax(axis=1)
            for t in range(most - 1, -1, -1):
                at = real[:, t]
                out[place[at, t]] = label[at]
                label = np.where(at, back[np.arange(n), t, label], label) if t else label
        return out


def _padded(first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(token places, which are real) of sequences of like length, about CELLS cells at a time."""
    length = np.diff(first)
    order = np.argsort(length, kind="stable")
    order = order[length[order] > 0]
    begin = 0
    while begin < len(order):
        end = begin + 1
        while end < len(order) and length[order[end]] * (end + 1 - begin) <= CELLS:
            end += 1
        some = order[begin:end]
        most = length[some].max()
        steps = np.arange(most)
        real = steps < length[some][:, None]
        yield np.where(real, first[some][:, None] + steps, first[some][:, None]), real
        begin = end


def fit(ids: np.ndarray, labels: np.ndarray, first: np.ndarray, features: int, classes: int, rounds: int = 80, rate: float = 0.2, l2: float = 1e-3) -> Crf:
    """Maximum penalised likelihood by Adam over all sequences; exact gradients from forward and backward sums."""
    weight, step, begin = np.zeros((features, classes)), np.zeros((classes, classes)), np.zeros(classes)
    params = [weight, step, begin]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    batches = list(_padded(first))
    total = max(len(first) - 1, 1)
    for k in range(1, rounds + 1 if len(ids) else 1):
        grads = [l2 * p * total for p in params]
        for place, real in batches:
            score = weight[ids[place]].sum(axis=2)
            n, most, _ = score.shape
            alpha, beta = np.zeros_like(score), np.zeros_like(score)
            alpha[:, 0] = begin + score[:, 0]
            for t in range(1, most):
                alpha[:, t] = np.where(real[:, t, None], _logsum(alpha[:, t - 1, :, None] + step, 1) + score[:, t], alpha[:, t - 1])
            for t in range(most - 2, -1, -1):
                beta[:, t] = np.where(real[:, t + 1, None], _logsum(step + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
            whole = _logsum(alpha[:, -1], 1)
            mark = np.exp(alpha + beta - whole[:, None, None])
            truth = labels[place]
            delta = (mark - np.eye(classes)[truth]) * real[:, :, None]
            for f in range(ids.shape[1]):
                for c in range(classes):
                    grads[0][:, c] += np.bincount(ids[place, f].ravel(), delta[:, :, c].ravel(), features)
            grads[2] += delta[:, 0].sum(axis=0)
            for t in range(1, most):
                pair = np.exp(alpha[:, t - 1, :, None] + step + (score[:, t] + beta[:, t])[:, None, :] - whole[:, None, None])
                grads[1] += (pair * real[:, t, None, None]).sum(axis=0)
                np.add.at(grads[1], (truth[real[:, t], t - 1], truth[real[:, t], t]), -1)
        grads[0][0] = 0  # id 0 is no feature
        for p, g, (m, v) in zip(params, grads, moments, strict=True):
            g /= total
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Crf(weight, step, begin)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)
