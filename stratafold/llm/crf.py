"""Linear-chain conditional random fields over padded batches, in numpy."""

from __future__ import annotations

import numpy as np


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def gradient(scores: np.ndarray, tags: np.ndarray, mask: np.ndarray, moves: np.ndarray):
    """Mean loss, and its gradients by emission scores (N, T, K) and transitions (K, K).

    ``mask`` (N, T) is 1 from the first place to a sequence's last one.
    """
    n, length, k = scores.shape
    forward = np.zeros_like(scores)
    backward = np.zeros_like(scores)
    forward[:, 0] = scores[:, 0]
    for t in range(1, length):
        step = _lse(forward[:, t - 1, :, None] + moves, 1) + scores[:, t]
        forward[:, t] = np.where(mask[:, t, None] > 0, step, forward[:, t - 1])
    total = _lse(forward[:, -1], 1)
    d_moves = np.zeros_like(moves)
    rows = np.arange(n)
    for t in range(length - 2, -1, -1):
        later = moves + (scores[:, t + 1] + backward[:, t + 1])[:, None, :]
        going = mask[:, t + 1, None, None] > 0
        backward[:, t] = np.where(going[:, 0], _lse(later, 2), 0.0)
        pair = forward[:, t, :, None] + later - total[:, None, None]
        d_moves += np.where(going, np.exp(np.minimum(pair, 0.0)), 0.0).sum(0)
    d_scores = np.exp(np.minimum(forward + backward - total[:, None, None], 0.0)) * mask[:, :, None]
    gold = scores[rows, 0, tags[:, 0]]
    for t in range(length):
        d_scores[rows, t, tags[:, t]] -= mask[:, t]
        if t:
            gold = gold + mask[:, t] * (scores[rows, t, tags[:, t]] + moves[tags[:, t - 1], tags[:, t]])
            np.add.at(d_moves, (tags[:, t - 1], tags[:, t]), -mask[:, t])
    return float((total - gold).mean()), d_scores / n, d_moves / n


def viterbi(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best tags of one sequence (T, K); ties go to the smaller tag."""
    best = np.empty(scores.shape, np.int64)
    reach = scores[0]
    for t in range(1, len(scores)):
        steps = reach[:, None] + moves
        best[t] = steps.argmax(0)
        reach = steps.max(0) + scores[t]
    tags = np.empty(len(scores), np.int64)
    tags[-1] = reach.argmax()
    for t in range(len(scores) - 1, 0, -1):
        tags[t - 1] = best[t, tags[t]]
    return tags


class Adam:
    """Adam over a list of arrays, changed in place."""

    def __init__(self, arrays: list[np.ndarray], rate: float):
        self.arrays, self.rate, self.t = arrays, rate, 0
        self.first = [np.zeros_like(a) for a in arrays]
        self.second = [np.zeros_like(a) for a in arrays]

    def step(self, gradients: list[np.ndarray]) -> None:
        self.t += 1
        size = np.sqrt(sum(float((g * g).sum()) for g in gradients))
        scale = min(1.0, 5.0 / (size + 1e-9))
        for a, g, m, v in zip(self.arrays, gradients, self.first, self.second):
            g = g * scale
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)
