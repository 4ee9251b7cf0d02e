"""Exact binomial probabilities."""

from __future__ import annotations

import math


def at_most(k: int, n: int, p: float) -> float:
    """Probability of at most ``k`` of ``n`` at chance ``p``: the exact sum of the tail that does
    not hold the mean, from its largest term on."""

    def tail(i: int, step: int) -> float:
        term = math.exp(
            math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
        )
        total = 0.0
        while 0 <= i <= n and term > total * 1e-18:
            total += term
            term *= (n - i) / (i + 1) * p / (1 - p) if step > 0 else i / (n - i + 1) * (1 - p) / p
            i += step
        return min(total, 1.0)

    if k >= n:
        return 1.0
    return tail(k, -1) if k < n * p else 1.0 - tail(k + 1, 1)


def largest_threshold(n: int, p: float, loss: float) -> int:
    """The largest count that fewer than ``loss`` of all draws of ``n`` at chance ``p`` stay below."""
    return max(t for t in range(n + 1) if t == 0 or at_most(t - 1, n, p) <= loss)
