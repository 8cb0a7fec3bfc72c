"""Marginal log probabilities of words over all their segmentations into weighted pieces."""

from __future__ import annotations

import numpy as np

WORD_START = "▁"
#: Words of one length that go through the recursion together.
TOGETHER = 4096
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SLOT_BITS = 21


def _codes(texts: list[str], length: int) -> np.ndarray:
    raw = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, np.uint32).reshape(len(texts), length)


def _prefixes(codes: np.ndarray) -> np.ndarray:
    """Rolling hashes of all prefixes; differences of them give every substring's hash."""
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * _MIX
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for i in range(codes.shape[1]):
        out[:, i + 1] = out[:, i] * _BASE + mixed[:, i] ** np.uint64(2) + mixed[:, i]
    return out


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]))


class Lattice:
    """Pieces with natural log weights. Any character can also be spelled by its bytes."""

    def __init__(self, pieces: dict[str, float]):
        arcs = {p: w for p, w in pieces.items() if not (len(p) == 6 and p.startswith("<0x"))}
        self.byte = np.array([pieces.get(f"<0x{b:02X}>", -20.0) for b in range(256)])
        self.longest = max(map(len, arcs), default=1)
        hashes, weights = [], []
        for length in range(1, self.longest + 1):
            group = [p for p in arcs if len(p) == length]
            if group:
                hashes.append(_prefixes(_codes(group, length))[:, -1])
                weights += [arcs[p] for p in group]
        # the last entry stands for substrings that are no piece
        self.hashes = np.concatenate([*hashes, [np.uint64(0)]])
        self.weights = np.array([*weights, -np.inf])
        n = len(weights)
        self.slots = np.full((2, 1 << _SLOT_BITS), n, np.int32)
        first = (self.hashes[:n] >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        self.slots[0, first] = np.arange(n)
        beaten = np.flatnonzero(self.slots[0, first] != np.arange(n))
        second = (self.hashes[beaten] & np.uint64((1 << _SLOT_BITS) - 1)).astype(np.int64)
        self.slots[1, second] = beaten
        lost = beaten[self.slots[1, second] != beaten]
        self.rest = {int(self.hashes[i]): float(self.weights[i]) for i in lost}
        self.order = np.sort(self.hashes[lost])

    def _arcs(self, hashes: np.ndarray) -> np.ndarray:
        a = self.slots[0, (hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)]
        out = np.where(self.hashes[a] == hashes, self.weights[a], -np.inf)
        b = self.slots[1, (hashes & np.uint64((1 << _SLOT_BITS) - 1)).astype(np.int64)]
        out = np.where(self.hashes[b] == hashes, self.weights[b], out)
        if self.rest:
            for at in zip(*np.nonzero(np.isin(hashes, self.order))):
                out[at] = self.rest[int(hashes[at])]
        return out

    def _spelled(self, codes: np.ndarray) -> np.ndarray:
        found, back = np.unique(codes, return_inverse=True)
        costs = [
            self.byte[list(chr(c).encode("utf-8", "surrogatepass"))].sum() for c in found.tolist()
        ]
        return np.array(costs)[back].reshape(codes.shape)

    def _forward(self, words: list[str], length: int) -> np.ndarray:
        codes = _codes([WORD_START + w for w in words], length)
        prefix, spelled = _prefixes(codes), self._spelled(codes)
        powers = _powers(self.longest)
        reach = np.full((len(words), length + 1), -np.inf)
        reach[:, 0] = 0.0
        for end in range(1, length + 1):
            start = max(0, end - self.longest)
            power = powers[end - start : 0 : -1]
            arcs = self._arcs(prefix[:, end, None] - prefix[:, start:end] * power)
            terms = reach[:, start:end] + arcs
            terms[:, -1] = np.logaddexp(terms[:, -1], reach[:, end - 1] + spelled[:, end - 1])
            top = terms.max(1)
            reach[:, end] = top + np.log(np.exp(terms - top[:, None]).sum(1))
        return reach[:, -1]

    def log_marginals(self, words: list[str]) -> np.ndarray:
        """Log-space forward recursion, for words of one length at once."""
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        out = np.empty(len(words))
        for length in np.unique(sizes):
            at = np.flatnonzero(sizes == length)
            for some in np.array_split(at, max(1, -(-len(at) // TOGETHER))):
                out[some] = self._forward([words[i] for i in some], int(length))
        return out
