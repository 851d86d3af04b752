"""Orders and groupings of one brand's zones or clusters in numpy: at most one a grid cell of the gamut, whatever the number of products."""

from __future__ import annotations

import numpy as np

from .cluster import de00


def chain(x: np.ndarray) -> list[int]:
    """From the darkest, always the nearest one that is left under CIEDE2000; ties take the first."""
    far = de00(x, x)
    at = int(x[:, 0].argmin())
    out, left = [at], np.ones(len(x), bool)
    left[at] = False
    while left.any():
        at = int(np.where(left, far[at], np.inf).argmin())
        left[at] = False
        out.append(at)
    return out


def farthest(distance: np.ndarray, first: int, k: int) -> list[int]:
    """Greedy farthest-point order by a distance matrix; ties take the first."""
    near, out = distance[first].astype(float).copy(), [first]
    near[first] = -1
    while len(out) < min(k, len(distance)):
        at = int(near.argmax())
        out.append(at)
        near = np.minimum(near, distance[at])
        near[out] = -1
    return out


def average_linkage(distance: np.ndarray) -> list[tuple[int, int]]:
    """The pairs of nodes that are joined in turn; node n + i is the i-th join. Ties take the pair of the smallest nodes."""
    n = len(distance)
    d = np.full((2 * n - 1, 2 * n - 1), np.inf)
    d[:n, :n] = distance
    np.fill_diagonal(d, np.inf)
    size, out = np.ones(2 * n - 1), []
    for new in range(n, 2 * n - 1):
        i, j = np.unravel_index(int(d.argmin()), d.shape)
        i, j = int(min(i, j)), int(max(i, j))
        out.append((i, j))
        size[new] = size[i] + size[j]
        row = (size[i] * d[i] + size[j] * d[j]) / size[new]
        d[new], d[:, new] = row, row
        d[[i, j, new], new] = d[new, [i, j]] = np.inf
        d[[i, j]] = d[:, [i, j]] = np.inf
    return out


def leaf_order(distance: np.ndarray) -> list[int]:
    """The order of leaves of the average-linkage tree whose neighbours' distances sum to least (Bar-Joseph et al., 2001)."""
    n = len(distance)
    if n < 3:
        return list(range(n))
    leaves, cost, kids = {i: [i] for i in range(n)}, {i: np.zeros((1, 1)) for i in range(n)}, {}
    for new, (a, b) in enumerate(average_linkage(distance), n):
        between = distance[np.ix_(leaves[a], leaves[b])]
        half = np.stack([(cost[a][i][:, None] + between).min(axis=0) for i in range(len(leaves[a]))])  # from a leaf of a over a's other end to a leaf of b
        whole = np.stack([(half[:, :, None] + cost[b][None, :, j, None]).min(axis=1)[:, 0] for j in range(len(leaves[b]))], axis=1)
        m = np.full((len(leaves[a]) + len(leaves[b]),) * 2, np.inf)
        m[: len(leaves[a]), len(leaves[a]) :] = whole
        m[len(leaves[a]) :, : len(leaves[a])] = whole.T
        leaves[new], cost[new], kids[new] = leaves[a] + leaves[b], m, (a, b)

    def walk(v: int, first: int, last: int) -> list[int]:
        """The leaves of a node, from its ``first`` to its ``last``."""
        if v < n:
            return [v]
        a, b = kids[v]
        if first not in leaves[a]:
            return walk(v, last, first)[::-1]
        i, j = leaves[a].index(first), leaves[b].index(last)
        total = cost[a][i][:, None] + distance[np.ix_(leaves[a], leaves[b])] + cost[b][:, j][None]
        x, y = np.unravel_index(int(total.argmin()), total.shape)
        return walk(a, first, leaves[a][x]) + walk(b, leaves[b][y], last)

    top = 2 * n - 2
    i, j = np.unravel_index(int(cost[top].argmin()), cost[top].shape)
    return walk(top, leaves[top][i], leaves[top][j])


def nearest_chain_linkage(distance: np.ndarray, cut: float, weight: np.ndarray | None = None) -> np.ndarray:
    """Labels of complete linkage cut at ``cut``, by nearest-neighbour chains, which need one pass over the matrix for each join instead
    of one search of it all. Numbers follow the first member of each group."""
    d = distance.astype(np.float32, copy=True)
    np.fill_diagonal(d, np.inf)
    n = len(d)
    alive, label, stack, joined = np.ones(n, bool), np.arange(n), [], []
    for _ in range(n - 1):
        if not stack:
            stack = [int(np.flatnonzero(alive)[0])]
        while True:
            a = stack[-1]
            row = d[a]
            b = int(row.argmin())
            if len(stack) > 1 and row[stack[-2]] <= row[b]:
                b = stack[-2]
            if len(stack) > 1 and b == stack[-2]:
                break
            stack.append(b)
        a, b = stack.pop(), stack.pop()
        joined.append((float(d[a, b]), min(a, b), max(a, b)))
        a, b = min(a, b), max(a, b)
        d[a] = d[:, a] = np.maximum(d[a], d[b])
        d[a, a] = np.inf
        d[b] = d[:, b] = np.inf
        alive[b] = False
    for height, a, b in joined:  # a join within the cut has only joins within the cut below it
        if height <= cut:
            label[label == label[b]] = label[a]
    _, first, back = np.unique(label, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[back]
