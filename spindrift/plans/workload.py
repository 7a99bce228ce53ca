"""Generated workloads for cache experiments: uniform, skewed, recurring and hot queries over partitions."""

from __future__ import annotations

import random
from collections.abc import Sequence


def zipf(n: int, theta: float) -> list[float]:
    weights = [1 / (i + 1) ** theta for i in range(n)]
    return [w / sum(weights) for w in weights]


def uniform(partitions: Sequence[str], queries: int, width: int = 1, seed: int = 0) -> list[list[str]]:
    return skewed(partitions, queries, 0.0, width, seed)


def skewed(partitions: Sequence[str], queries: int, theta: float, width: int = 1, seed: int = 0) -> list[list[str]]:
    """Each query reads ``width`` neighbouring partitions; where it starts follows a Zipf law (0: uniform)."""
    r, starts = random.Random(seed), list(range(max(len(partitions) - width + 1, 1)))
    weights = zipf(len(starts), theta)
    return [list(partitions[s : s + width]) for s in r.choices(starts, weights, k=queries)]


def recurring(partitions: Sequence[str], queries: int, period: int, width: int = 1, seed: int = 0) -> list[list[str]]:
    """The same ``period`` queries again and again."""
    first = skewed(partitions, period, 0.0, width, seed)
    return [first[i % period] for i in range(queries)]


def hot(partitions: Sequence[str], queries: int, share: float, width: int = 1, seed: int = 0) -> list[list[str]]:
    """One query makes up a share of all; the others are uniform."""
    r, rest = random.Random(seed), skewed(partitions, queries, 0.0, width, seed + 1)
    return [list(partitions[:width]) if r.random() < share else q for q in rest]
