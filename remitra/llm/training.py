"""Fitting parameters whose gradients are summed over partitions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Arrays = dict[str, np.ndarray]


def adam(start: Arrays, gradient: Callable[[Arrays], Arrays], steps: int, rate: float, fade: float = 0.97, whole: bool = False) -> Arrays:
    """Follow the gradient of a sum; each step is one pass over the data.

    Steps are scaled per parameter, or with ``whole`` per array by its largest
    one, so that parameters with little support move little.
    """
    now = {k: v.astype(np.float64).copy() for k, v in start.items()}
    first = {k: np.zeros_like(v) for k, v in now.items()}
    second = {k: np.zeros_like(v) for k, v in now.items()}
    for t in range(1, steps + 1):
        for k, g in gradient(now).items():
            first[k] = 0.8 * first[k] + 0.2 * g
            second[k] = 0.95 * second[k] + 0.05 * g * g
            size = np.sqrt(second[k] / (1 - 0.95**t))
            scaled = first[k] / (1 - 0.8**t) / ((size.max(initial=0.0) if whole else size) + 1e-9)
            now[k] = now[k] - rate * fade ** (t - 1) * scaled
    return now
