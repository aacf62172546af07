"""Plain single-process versions of the iterative jobs, for small fixtures."""

from __future__ import annotations

import numpy as np


def distances(x: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    if metric == "cosine":
        length = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
        x = np.hstack([x, (length == 0).astype(float)])
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    return d * d / 2 if metric == "cosine" else d


def neighbours(x: np.ndarray, k: int, metric: str = "euclidean") -> tuple[np.ndarray, np.ndarray]:
    d = distances(x, metric)
    np.fill_diagonal(d, np.inf)
    order = np.array([np.lexsort((np.arange(len(x)), row))[:k] for row in d])
    return order, np.take_along_axis(d, order, 1)


def reach_matrix(x: np.ndarray, min_samples: int) -> np.ndarray:
    d = distances(x)
    core = np.sort(d, axis=1)[:, min(min_samples, len(x) - 1)]
    return np.maximum(np.maximum(core[:, None], core[None, :]), d)


def spanning_tree(w: np.ndarray, d: np.ndarray) -> list[tuple[float, int, int]]:
    """Kruskal over the full matrix, equal weights by distance, then by ids."""
    n = len(w)
    i, j = np.triu_indices(n, 1)
    group = list(range(n))

    def top(a):
        while group[a] != a:
            group[a] = group[group[a]]
            a = group[a]
        return a

    out = []
    for e in np.lexsort((j, i, d[i, j], w[i, j])):
        a, b = top(i[e]), top(j[e])
        if a != b:
            group[a] = b
            out.append((w[i[e], j[e]], int(i[e]), int(j[e])))
    return sorted(out)


def density_labels(x: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, dict[int, float]]:
    """Labels, confidences and normalised stability by recursive cutting."""
    n = len(x)
    edges = spanning_tree(reach_matrix(x, m), distances(x))
    parts = {i: [i] for i in range(n)}
    where = list(range(n))
    kids: dict[int, tuple[int, int, float]] = {}
    for e, (w, a, b) in enumerate(edges):
        left, right = where[a], where[b]
        kids[n + e] = (left, right, w)
        parts[n + e] = parts[left] + parts[right]
        for p in parts[n + e]:
            where[p] = n + e
    root = n + len(edges) - 1
    birth, exits, tree, order = {root: 0.0}, {root: []}, {root: []}, [root]
    if n < m:
        return np.full(n, -1), np.zeros(n), {}
    stack = [(root, root)]
    while stack:
        node, cluster = stack.pop()
        if node not in kids:
            exits[cluster].append((node, np.inf))
            continue
        left, right, w = kids[node]
        lam = 1 / w if w > 0 else np.inf
        big = [c for c in (left, right) if len(parts[c]) >= m]
        for c in (left, right):
            if c not in big:
                exits[cluster] += [(p, lam) for p in parts[c]]
        for c in big:
            if len(big) == 2:
                birth[c], exits[c], tree[c] = lam, [], []
                tree[cluster].append(c)
                order.append(c)
                stack.append((c, c))
            else:
                stack.append((c, cluster))
    stability = {
        c: sum(lam for _, lam in exits[c])
        + sum(len(parts[k]) * birth[k] for k in tree[c])
        - len(parts[c]) * birth[c]
        for c in order
    }
    worth, chosen = {}, set()

    def below(c):
        for k in tree[c]:
            yield k
            yield from below(k)

    for c in sorted(order, key=lambda c: len(parts[c])):
        children = sum(worth[k] for k in tree[c])
        if c != root and stability[c] >= children:
            worth[c] = stability[c]
            chosen -= set(below(c))
            chosen.add(c)
        else:
            worth[c] = max(children, stability[c])
    labels, confidence, normal = np.full(n, -1), np.zeros(n), {}
    peak = {
        c: max([lam for _, lam in exits[c]] + [birth[k] for k in tree[c]], default=0.0) for c in order
    }
    highest = max(peak.values())
    for number, c in enumerate(sorted(chosen, key=lambda c: min(parts[c]))):
        labels[parts[c]] = number
        for k in [c, *below(c)]:
            for p, lam in exits[k]:
                endless = not np.isfinite(lam) or peak[c] == 0
                confidence[p] = 1.0 if endless else min(lam, peak[c]) / peak[c]
        normal[number] = (
            stability[c] / (len(parts[c]) * highest) if np.isfinite(highest) and highest else 1.0
        )
    return labels, confidence, normal
