"""Forward and backward recursions over many chains at once, all chains that are still running in one step."""

from __future__ import annotations

import numpy as np


class Chains:
    """Chains of the given lengths, whose elements stand one after the other."""

    def __init__(self, lengths: np.ndarray):
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        self.order, self.lengths, self.starts = order, lengths[order], starts[order]
        self.n = int(lengths.sum())
        longest = int(self.lengths[0]) if len(lengths) else 0
        #: Chains that have an element at each step; they are the first ones.
        self.running = np.searchsorted(-self.lengths, -np.arange(longest), side="left")

    def forward(self, first: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled state weights of every element, and its scale; the logarithm of a chain's weight is the sum of theirs."""
        weights, scales = np.empty((self.n, len(first))), np.empty(self.n)
        now = None
        for t, k in enumerate(self.running):
            at = self.starts[:k] + t
            now = emit[at] * (first if t == 0 else now[:k] @ move)
            scale = now.sum(axis=1)
            now /= scale[:, None]
            weights[at], scales[at] = now, scale
        return weights, scales

    def backward(self, move: np.ndarray, emit: np.ndarray, scales: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward weights, and emit * backward / scale of every element, which pairs with the element before."""
        back, ahead = np.ones((self.n, move.shape[0])), np.empty((self.n, move.shape[0]))
        turned = np.ascontiguousarray(move.T)
        before = 0
        now = np.ones((0, move.shape[0]))
        for t in range(len(self.running) - 1, -1, -1):
            k = self.running[t]
            at = self.starts[:k] + t
            here = np.ones((k, move.shape[0]))
            here[:before] = now @ turned
            back[at] = here
            now = emit[at] * here / scales[at][:, None]
            ahead[at] = now
            before = k
        return back, ahead

    def later(self) -> np.ndarray:
        """Whether an element has one before it in its chain."""
        out = np.ones(self.n, bool)
        out[self.starts[self.lengths > 0]] = False
        return out

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum of each chain's values, in the order the lengths were given in."""
        total = np.concatenate([[0.0], np.cumsum(values)])
        out = np.empty(len(self.lengths))
        out[self.order] = total[self.starts + self.lengths] - total[self.starts]
        return out
