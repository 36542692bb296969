"""Sequential packing: bins of a target weight, and balanced splits."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence
from typing import TypeVar

from millrace.errors import ConfigError

T = TypeVar("T")


class ListPacker:
    """Packs items, heaviest first, each into the newest of the last `lookback` bins that has room.

    A target of 0 is no limit. An item heavier than the target has a bin of its own.
    """

    def __init__(self, target_weight: int, lookback: int = 1) -> None:
        if lookback < 1:
            raise ConfigError("lookback must be at least 1")
        self.target_weight, self.lookback = target_weight, lookback

    def assign(self, weights: Sequence[int]) -> list[int]:
        """The bin number of each item, in the items' order."""
        bins: list[int] = []  # weight so far
        out = [0] * len(weights)
        for i in sorted(range(len(weights)), key=lambda i: -weights[i]):  # stable: ties keep their order
            for b in range(len(bins) - 1, max(-1, len(bins) - 1 - self.lookback), -1):
                if not self.target_weight or bins[b] + weights[i] <= self.target_weight:
                    break
            else:
                bins.append(0)
                b = len(bins) - 1
            bins[b] += weights[i]
            out[i] = b
        return out

    def pack(self, items: Sequence[T], weight: Callable[[T], int]) -> list[list[T]]:
        weights = [weight(x) for x in items]
        bins: dict[int, list[tuple[int, int]]] = {}
        for i, b in enumerate(self.assign(weights)):
            bins.setdefault(b, []).append((-weights[i], i))
        return [[items[i] for _, i in sorted(bins[b])] for b in sorted(bins)]


def split_balanced(lengths: Sequence[int], n: int) -> list[list[int]]:
    """Indices in n splits: each, in order, goes to the lightest split so far (ties: the first). Splits may be empty."""
    if n < 1:
        raise ConfigError("at least one split is needed")
    heap = [(0, k) for k in range(n)]
    out: list[list[int]] = [[] for _ in range(n)]
    for i, length in enumerate(lengths):
        total, k = heapq.heappop(heap)
        out[k].append(i)
        heapq.heappush(heap, (total + length, k))
    return out
