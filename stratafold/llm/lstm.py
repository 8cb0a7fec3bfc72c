"""A bidirectional LSTM with a linear layer on top, over padded batches, in numpy."""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class BiLstm:
    """Input (T, N, D) to scores (T, N, K). Padding counts as the end of a sequence's input."""

    def __init__(self, inputs: int, hidden: int, outputs: int, seed: int):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.arrays: list[np.ndarray] = []
        for _ in range(2):
            wide = inputs + hidden
            self.arrays.append(rng.normal(0, 1 / np.sqrt(wide), (wide, 4 * hidden)))
            bias = np.zeros(4 * hidden)
            bias[hidden : 2 * hidden] = 1.0  # remember at first
            self.arrays.append(bias)
        self.arrays.append(rng.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, outputs)))
        self.arrays.append(np.zeros(outputs))

    def _pass(self, x: np.ndarray, mask: np.ndarray, w: np.ndarray, b: np.ndarray, keep: bool):
        length, n, _ = x.shape
        h, size = np.zeros((n, self.hidden)), self.hidden
        c = np.zeros((n, size))
        out, kept = np.empty((length, n, size)), []
        fed = x @ w[: x.shape[2]] + b
        rest = w[x.shape[2] :]
        for t in range(length):
            gates = fed[t] + h @ rest
            ifo = _sigmoid(gates[:, : 3 * size])
            i, f, o = ifo[:, :size], ifo[:, size : 2 * size], ifo[:, 2 * size :]
            g = np.tanh(gates[:, 3 * size :])
            m = mask[t][:, None]
            before, h0 = c, h
            c = m * (f * c + i * g) + (1 - m) * c
            z = np.tanh(c)
            h = m * o * z + (1 - m) * h
            out[t] = h
            if keep:
                kept.append((i, f, o, g, before, h0, z))
        return out, kept

    def _back(self, x, mask, w, kept, d_out):
        length, n, inputs = x.shape
        size = self.hidden
        dw, db = np.zeros_like(w), np.zeros(4 * size)
        dx = np.empty_like(x)
        dh, dc = np.zeros((n, size)), np.zeros((n, size))
        for t in range(length - 1, -1, -1):
            i, f, o, g, before, h0, z = kept[t]
            m = mask[t][:, None]
            d = dh + d_out[t]
            live = m * d
            dcell = m * dc + live * o * (1 - z * z)
            gates = np.hstack(
                [
                    dcell * g * i * (1 - i),
                    dcell * before * f * (1 - f),
                    live * z * o * (1 - o),
                    dcell * i * (1 - g * g),
                ]
            )
            dw[:inputs] += x[t].T @ gates
            dw[inputs:] += h0.T @ gates
            db += gates.sum(0)
            dx[t] = gates @ w[:inputs].T
            dh = gates @ w[inputs:].T + (1 - m) * d
            dc = dcell * f + (1 - m) * dc
        return dx, dw, db

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return self.run(x, mask, keep=False)[0]

    def run(self, x: np.ndarray, mask: np.ndarray, keep: bool = True):
        w1, b1, w2, b2, wo, bo = self.arrays
        ahead, kept1 = self._pass(x, mask, w1, b1, keep)
        back, kept2 = self._pass(x[::-1], mask[::-1], w2, b2, keep)
        both = np.concatenate([ahead, back[::-1]], axis=2)
        return both @ wo + bo, (x, mask, kept1, kept2, both)

    def gradients(self, state, d_scores: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Gradients in the order of ``arrays``, and by the input."""
        x, mask, kept1, kept2, both = state
        w1, _, w2, _, wo, _ = self.arrays
        flat = d_scores.reshape(-1, d_scores.shape[2])
        d_wo = both.reshape(-1, both.shape[2]).T @ flat
        d_both = d_scores @ wo.T
        size = self.hidden
        dx1, dw1, db1 = self._back(x, mask, w1, kept1, d_both[:, :, :size])
        dx2, dw2, db2 = self._back(x[::-1], mask[::-1], w2, kept2, d_both[::-1, :, size:])
        return [dw1, db1, dw2, db2, d_wo, flat.sum(0)], dx1 + dx2[::-1]
