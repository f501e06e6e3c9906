"""Best one-to-one choice of weighted pairs, by augmenting paths over the pairs that there are."""

from __future__ import annotations

import heapq
from collections.abc import Sequence


def heaviest(left: Sequence[int], right: Sequence[int], weight: Sequence[int]) -> list[int]:
    """Numbers of the pairs (left, right) of a choice, each end at most once, of greatest total weight; ends
    are 0..n-1, weights whole numbers over 0.

    The Hungarian method on sparse rows: each left end in turn takes the cheapest augmenting path, by
    Dijkstra's search over costs that prices of the right ends keep from being negative. Staying
    alone is a right end of one's own, at no weight.
    """
    n = max(left, default=-1) + 1
    m = max(right, default=-1) + 1
    near: list[list[tuple[int, int, int]]] = [[(m + i, 0, -1)] for i in range(n)]  # (right end, cost, pair)
    for k, (i, j, w) in enumerate(zip(left, right, weight)):
        near[i].append((j, -w, k))
    price_l = [min(c for _, c, _ in row) for row in near]
    price_r = [0] * (m + n)
    held_by: list[int] = [-1] * (m + n)
    taken: list[int] = [-1] * n  # place in near[i]
    for root in range(n):
        best: dict[int, int] = {}
        came: dict[int, tuple[int, int]] = {}
        done: dict[int, int] = {}
        heap: list[tuple[int, int]] = []
        i, base = root, 0
        while True:
            for at, (j, c, _) in enumerate(near[i]):
                d = base + c - price_l[i] - price_r[j]
                if j not in done and (j not in best or d < best[j]):
                    best[j], came[j] = d, (i, at)
                    heapq.heappush(heap, (d, j))
            while True:
                d, j = heapq.heappop(heap)
                if j not in done and best[j] == d:
                    break
            done[j] = d
            if held_by[j] < 0:
                break
            i, base = held_by[j], d
        end = d
        price_l[root] += end
        for k, dk in done.items():
            if k != j:
                price_l[held_by[k]] += end - dk
                price_r[k] -= end - dk
        while True:
            i, at = came[j]
            back = near[i][taken[i]][0] if taken[i] >= 0 else -1
            held_by[j], taken[i] = i, at
            if i == root:
                break
            j = back
    return sorted(near[i][taken[i]][2] for i in range(n) if near[i][taken[i]][2] >= 0)
