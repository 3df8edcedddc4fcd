"""Exact path-dependent feature contributions, vectorised over rows.

For each leaf the path's features meet as products of "the row goes on" (0 or 1) and "the share
of the cover that goes on"; the Shapley weights of all subsets are summed by polynomials.
"""

from __future__ import annotations

from math import factorial

import numpy as np


def _paths(tree, x: np.ndarray):
    """(value, cover share, features, ones, zeros) of each leaf: ones (d, rows), zeros (d,)."""
    n = len(x)
    out = []

    def go_left(node: int) -> np.ndarray:
        v = x[:, tree.feature[node]]
        if tree.categories[node] is not None:
            go = np.isin(v, np.array(tree.categories[node], dtype=np.float32))
        else:
            go = v < np.float32(tree.threshold[node])
        return np.where(np.isnan(v), tree.default_left[node], go)

    def walk(node: int, path: dict) -> None:
        if tree.left[node] < 0:
            out.append((tree.value[node] * tree.weight, list(path), [path[f][0] for f in path], [path[f][1] for f in path]))
            return
        go = go_left(node)
        cover = tree.cover[node] or 1.0
        for child, side in ((tree.left[node], go), (tree.right[node], ~go)):
            share = tree.cover[child] / cover
            one, zero = path.get(tree.feature[node], (np.ones(n), 1.0))
            walk(child, {**path, tree.feature[node]: (one * side, zero * share)})

    walk(0, {})
    return out


def _weights(ones: list, zeros: list, leave: set[int], size: int) -> np.ndarray:
    """Sum over subsets S of the path without ``leave`` of |S|!(size - |S| - 1)!/size! times its products."""
    poly = [np.ones_like(ones[0])]
    for k, (o, z) in enumerate(zip(ones, zeros, strict=True)):
        if k not in leave:
            grown = [z * p for p in poly] + [np.zeros_like(ones[0])]
            for i, p in enumerate(poly):
                grown[i + 1] = grown[i + 1] + o * p
            poly = grown
    return sum(p * (factorial(i) * factorial(size - i - 1) / factorial(size)) for i, p in enumerate(poly))


def _expected(zeros: list) -> float:
    return float(np.prod(zeros)) if zeros else 1.0


def contributions(model, x: np.ndarray, trees) -> np.ndarray:
    """(rows, outputs, features + 1); the last is the bias."""
    f = len(model.features)
    phi = np.zeros((len(x), model.outputs, f + 1))
    phi[:, :, f] = model.base
    for t in trees:
        for value, features, ones, zeros in _paths(t, x):
            phi[:, t.output, f] += value * _expected(zeros)
            for i, feature in enumerate(features):
                phi[:, t.output, feature] += value * (ones[i] - zeros[i]) * _weights(ones, zeros, {i}, len(features))
    return phi


def interactions(model, x: np.ndarray, trees) -> np.ndarray:
    """(rows, outputs, features + 1, features + 1); rows of the matrix add up to the contributions."""
    f = len(model.features)
    out = np.zeros((len(x), model.outputs, f + 1, f + 1))
    phi = contributions(model, x, trees)
    for t in trees:
        for value, features, ones, zeros in _paths(t, x):
            for i in range(len(features)):
                for j in range(i):
                    w = 0.5 * value * (ones[i] - zeros[i]) * (ones[j] - zeros[j]) * _weights(ones, zeros, {i, j}, len(features) - 1)
                    out[:, t.output, features[i], features[j]] += w
                    out[:, t.output, features[j], features[i]] += w
    for i in range(f + 1):
        out[:, :, i, i] = phi[:, :, i] - out[:, :, i].sum(axis=2)
    return out
