"""Split search on gradient histograms: one vectorised search for all kinds of features and nodes.

The sums of a histogram are whole numbers (gradients in fixed point), so that prefix sums are exact
and a node's splits don't depend on what else is searched beside it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.rng import draw

#: Least loss change of a split; categories below which each is tried alone; longest set of categories, from either end of their order.
MIN_LOSS, ONE_HOT, MAX_SET = 1e-6, 4, 64


@dataclass(frozen=True)
class Regularisation:
    """lambda_ and alpha shrink leaves; max_delta_step bounds them; children need min_child_weight.

    path_smooth pulls a child's output towards its parent's; extra_trees scores one drawn
    threshold of each feature; new_feature and new_threshold are taken off the loss change of splits
    that the model doesn't use yet; min_groups: split groups that both children must hold.
    """

    lambda_: float = 1.0
    alpha: float = 0.0
    gamma: float = 0.0
    min_child_weight: float = 1.0
    max_delta_step: float = 0.0
    monotone: Mapping[int, int] = field(default_factory=dict)
    path_smooth: float = 0.0
    extra_trees: bool = False
    extra_seed: int = 0
    new_feature: float = 0.0
    new_threshold: float = 0.0
    min_groups: int = 1

    def weight(self, g: Column, h: Column) -> Column:
        """A leaf's value as a column."""
        soft = F.when(g > self.alpha, g - self.alpha).when(g < -self.alpha, g + self.alpha).otherwise(0.0) if self.alpha else g
        w = F.when(h > 0, -soft / (h + self.lambda_)).otherwise(0.0)
        return F.greatest(F.least(w, F.lit(self.max_delta_step)), F.lit(-self.max_delta_step)) if self.max_delta_step > 0 else w

    def soft(self, g: np.ndarray) -> np.ndarray:
        return np.sign(g) * np.maximum(np.abs(g) - self.alpha, 0) if self.alpha else g

    def weights(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            w = np.where(h > 0, -self.soft(g) / (h + self.lambda_), 0.0)
        return np.clip(w, -self.max_delta_step, self.max_delta_step) if self.max_delta_step > 0 else w

    def number(self, g: float, h: float) -> float:
        return float(self.weights(np.array(g), np.array(h)))

    def score(self, g: np.ndarray, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What a node gains by the output w."""
        return np.where(h > 0, -(2 * g * w + (h + self.lambda_) * w * w + 2 * self.alpha * np.abs(w)), 0.0)

    def gains(self, g: np.ndarray, h: np.ndarray, w: np.ndarray | None) -> np.ndarray:
        """What a node gains at its best output, or at w."""
        if w is not None:
            return self.score(g, h, w)
        t = self.soft(g)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(h > 0, t * t / (h + self.lambda_), 0.0)


@dataclass
class Node:
    """What the search needs to know about a node: bounds and output by output number, allowed features."""

    low: np.ndarray
    high: np.ndarray
    value: np.ndarray | None = None
    allowed: frozenset[int] | None = None
    key: tuple[int, ...] = ()


@dataclass
class Chunk:
    """Features whose histograms lie side by side: of each the missing values' cell, then one for each bin."""

    features: list[int]
    sizes: list[int]
    categorical: list[bool]

    def __post_init__(self) -> None:
        self.starts = np.concatenate([[0], np.cumsum([s + 1 for s in self.sizes])]).astype(np.int64)
        self.cells = int(self.starts[-1])
        self.of = np.repeat(np.arange(len(self.sizes)), [s + 1 for s in self.sizes])
        self.bin = np.arange(self.cells) - self.starts[self.of] - 1


def chunks(features: Sequence[int], sizes: Sequence[int], categorical: Sequence[bool], cells: int) -> list[Chunk]:
    """The features in chunks of at most so many cells, or of one feature."""
    out, held, total = [], [], 0
    for f in features:
        if held and total + sizes[f] + 1 > cells:
            out.append(Chunk(held, [sizes[x] for x in held], [categorical[x] for x in held]))
            held, total = [], 0
        held.append(f)
        total += sizes[f] + 1
    return [*out, Chunk(held, [sizes[x] for x in held], [categorical[x] for x in held])] if held else out


class Search:
    """Finds the best splits of nodes from their histograms of one chunk: (2 * outputs + 1, cells) whole numbers g, h, n."""

    def __init__(self, chunk: Chunk, reg: Regularisation, scale: tuple[float, float], outputs: int = 1, used: tuple[set[int], set[tuple]] | None = None, cuts: Sequence[np.ndarray] | None = None) -> None:
        self.chunk, self.reg, self.scale, self.k = chunk, reg, scale, outputs
        self.used, self.cuts = used, cuts
        self.groups: dict[int, np.ndarray] = {}  # by node: counts of split groups, see histogram.group_counts
        self.at = 0

    def _outputs(self, g, h, n, node: Node, whole) -> np.ndarray | None:
        """Outputs of children (outputs, ...) where they aren't the free optimum: clamped, bounded or smoothed."""
        reg = self.reg
        bounded = np.isfinite(node.low).any() or np.isfinite(node.high).any()
        if not (reg.max_delta_step > 0 or bounded or reg.monotone or reg.path_smooth > 0):
            return None
        w = reg.weights(g, h)
        if reg.path_smooth > 0 and node.value is not None:
            total = n + reg.path_smooth
            w = w * (n / total) + np.expand_dims(node.value, tuple(range(1, w.ndim))) * (reg.path_smooth / total)
        low, high = (np.expand_dims(x, tuple(range(1, w.ndim))) for x in (node.low, node.high))
        return np.clip(w, low, high)

    def _scored(self, left: np.ndarray, total: np.ndarray, node: Node, feature: np.ndarray):
        """(loss, valid) of candidates whose left sums are (2 * outputs + 1, candidates)."""
        reg, k = self.reg, self.k
        right = total[:, None] - left
        gl, hl, nl = left[:k] * self.scale[0], left[k : 2 * k] * self.scale[1], left[-1]
        gr, hr, nr = right[:k] * self.scale[0], right[k : 2 * k] * self.scale[1], right[-1]
        tg, th, tn = total[:k] * self.scale[0], total[k : 2 * k] * self.scale[1], int(total[-1])
        if reg.path_smooth > 0:  # row counts from the share of the Hessian
            share = hl.sum(axis=0) / max(float(th.sum()), 1e-300)
            ml, mr = np.rint(tn * share), np.rint(tn * (1 - share))
        else:
            ml, mr = nl, nr
        wl, wr = self._outputs(gl, hl, ml, node, tn), self._outputs(gr, hr, mr, node, tn)
        own = self._outputs(tg, th, np.float64(tn), node, tn)
        loss = (reg.gains(gl, hl, wl) + reg.gains(gr, hr, wr)).sum(axis=0) - reg.gains(tg, th, own).sum()
        ml, mr = hl.mean(axis=0), hr.mean(axis=0)
        ok = (ml > 0) & (mr > 0) & (ml >= reg.min_child_weight) & (mr >= reg.min_child_weight) & (nl > 0) & (nr > 0)
        if reg.monotone:
            way = np.array([reg.monotone.get(f, 0) for f in self.chunk.features])[feature]
            rise = (wl <= wr).all(axis=0) if wl is not None else True
            fall = (wl >= wr).all(axis=0) if wl is not None else True
            ok &= ((way <= 0) | rise) & ((way >= 0) | fall)
        return loss, ok

    def _penalty(self, feature: int, cut) -> float:
        if self.used is None:
            return 0.0
        features, thresholds = self.used
        if feature not in features:
            return self.reg.new_feature + self.reg.new_threshold
        return 0.0 if (feature, cut) in thresholds else self.reg.new_threshold

    def numeric(self, hist: np.ndarray, total: np.ndarray, node: Node):
        """(local feature, bin, missing left, loss, valid, left sums) of all numeric candidates, in scan order of each feature."""
        c = self.chunk
        run = np.cumsum(hist, axis=1)
        gone = hist[:, c.starts[:-1]]
        before = run[:, c.starts[:-1]]  # of cells up to and with the missing values' cell of the feature
        present = run - before[:, c.of]
        cell = np.flatnonzero((c.bin >= 0) & (hist[-1] > 0) & ~np.array(c.categorical)[c.of])
        if self.reg.extra_trees and len(cell):
            first = np.flatnonzero(np.concatenate([[True], c.of[cell][1:] != c.of[cell][:-1]]))
            stop = np.append(first[1:], len(cell))
            pick = []
            for a, b in zip(first, stop, strict=True):
                low, high = int(cell[a]), int(cell[b - 1])
                if high > low:
                    u = draw(self.reg.extra_seed, *node.key, c.features[c.of[low]], 5)
                    at = low + int(u * (high - low))
                    pick.append(cell[a:b][np.searchsorted(cell[a:b], at, side="right") - 1])
                elif gone[-1, c.of[low]] > 0:
                    pick.append(low)
            cell = np.array(pick, dtype=np.int64)
        back = cell[gone[-1, c.of[cell]] > 0]
        at = np.concatenate([cell, back[::-1]])
        missing_left = np.concatenate([np.zeros(len(cell), bool), np.ones(len(back), bool)])
        left = present[:, at] + np.where(missing_left, gone[:, c.of[at]], 0)
        loss, ok = self._scored(left, total, node, c.of[at])
        if self.reg.min_groups > 1:
            ok = ok & self._held(at, missing_left)
        if self.used is not None:
            loss = loss - np.array([self._penalty(c.features[c.of[x]], float(self.cuts[c.features[c.of[x]]][c.bin[x]])) for x in at])
        return c.of[at], c.bin[at], missing_left, loss.astype(np.float32), ok, left

    def _held(self, at: np.ndarray, missing_left: np.ndarray) -> np.ndarray:
        """Whether both children of numeric candidates hold enough split groups."""
        c, counts = self.chunk, self.groups.get(self.at)
        if counts is None:
            return np.zeros(len(at), dtype=bool)
        run = np.cumsum(counts[:4], axis=1)
        start, stop = c.starts[:-1], c.starts[1:] - 1
        before = run[:, start] - counts[:4, start]
        up = (run - before[:, c.of])[:, at]
        total = (run[:, stop] - before)[:, c.of[at]]
        gone = counts[4, start][c.of[at]]
        left = np.where(missing_left, gone + up[2], up[0])
        right = np.where(missing_left, total[1] - up[1], gone + total[3] - up[3])
        return (left >= self.reg.min_groups) & (right >= self.reg.min_groups)

    def categories(self, f: int, hist: np.ndarray, total: np.ndarray, node: Node):
        """Candidates of one categorical feature, with their sets of bins, in scan order."""
        c, k = self.chunk, self.k
        own = hist[:, c.starts[f] + 1 : c.starts[f + 1]]
        gone = hist[:, c.starts[f]]
        bins = np.flatnonzero(own[-1] > 0)
        if not len(bins):
            return None
        if len(bins) < ONE_HOT:
            order, lefts, sets = np.arange(len(bins)), own[:, bins], [[int(b)] for b in bins]
        else:
            w = self.reg.weights(own[:k, bins] * self.scale[0], own[k : 2 * k, bins] * self.scale[1])
            place = w[0] if k == 1 else (w * self.reg.weights(total[:k] * self.scale[0], total[k : 2 * k] * self.scale[1])[:, None]).sum(axis=0)
            bins = bins[np.lexsort((bins, place))]
            lefts = np.cumsum(own[:, bins], axis=1)
            sets = [bins[: j + 1] for j in range(len(bins))]
            rank = np.arange(len(bins))
            order = np.flatnonzero((rank < MAX_SET) | (rank >= len(bins) - MAX_SET))
            if self.reg.extra_trees:
                order = order[[int(draw(self.reg.extra_seed, *node.key, c.features[f], 5) * len(order))]]
        at = np.concatenate([order, order[::-1]]) if gone[-1] > 0 else order
        missing_left = np.arange(len(at)) >= len(order)
        left = lefts[:, at] + np.where(missing_left, gone[:, None], 0)
        loss, ok = self._scored(left, total, node, np.full(len(at), f))
        if self.used is not None:
            codes = self.cuts[c.features[f]]
            loss = loss - np.array([self._penalty(c.features[f], tuple(sorted(float(codes[b]) for b in sets[x]))) for x in at])
        return np.full(len(at), f), bins[at] if len(bins) >= ONE_HOT else np.array([sets[x][0] for x in at]), missing_left, loss.astype(np.float32), ok, left, [sets[x] for x in at]

    def candidates(self, hist: np.ndarray, node: Node):
        """All candidates of a node by local feature, then in scan order; the last part are sets of categories."""
        c = self.chunk
        total = hist[:, c.starts[0] : c.starts[1]].sum(axis=1)
        if self.reg.path_smooth > 0 and node.value is None:
            node.value = self.reg.weights(total[: self.k] * self.scale[0], total[self.k : 2 * self.k] * self.scale[1])
        parts = [(*self.numeric(hist, total, node), None)]
        parts += [x for f, cat in enumerate(c.categorical) if cat and (x := self.categories(f, hist, total, node)) is not None]
        feature, bin_, missing, loss, ok = (np.concatenate([p[j] for p in parts]) for j in range(5))
        left = np.concatenate([p[5] for p in parts], axis=1)
        sets = [s for p in parts for s in (p[6] if p[6] is not None else [None] * len(p[0]))]
        if node.allowed is not None:
            ok = ok & np.array([f in node.allowed for f in c.features])[feature]
        return total, feature, bin_, missing, loss, ok, left, sets

    def takes(self, loss: np.ndarray, ok: np.ndarray) -> np.ndarray:
        return ok & (loss > MIN_LOSS) & (loss >= self.reg.gamma) & np.isfinite(loss)

    def row(self, node: Node, total, x: int, feature, bin_, missing, loss, left, sets) -> dict:
        """A split with its children's sums and outputs."""
        k, right = self.k, total - left[:, x]

        def output(v: np.ndarray) -> list[float]:
            g, h = v[:k] * self.scale[0], v[k : 2 * k] * self.scale[1]
            n = np.float64(v[-1])
            if self.reg.path_smooth > 0:
                n = np.rint(total[-1] * h.sum() / max(float((total[k : 2 * k] * self.scale[1]).sum()), 1e-300))
            w = self._outputs(g, h, n, node, total[-1])
            return [float(a) for a in (self.reg.weights(g, h) if w is None else w)]

        sums = lambda v: {"g": [float(a) for a in v[:k] * self.scale[0]], "h": [float(a) for a in v[k : 2 * k] * self.scale[1]], "n": int(v[-1])}
        l, r = sums(left[:, x]), sums(right)  # noqa: E741
        return {"feature": int(self.chunk.features[feature[x]]), "bin": int(bin_[x]), "default_left": bool(missing[x]), "categories": None if sets[x] is None else sorted(int(b) for b in sets[x]), "loss": float(loss[x]), **{f"{c}l": l[c] for c in "ghn"}, **{f"{c}r": r[c] for c in "ghn"}, "wl": output(left[:, x]), "wr": output(right)}

    def best(self, hist: np.ndarray, node: Node) -> dict | None:
        """The best acceptable split: ties go to the lower feature, then to the scan order."""
        total, feature, bin_, missing, loss, ok, left, sets = self.candidates(hist, node)
        takes = np.flatnonzero(self.takes(loss, ok))
        if not len(takes):
            return None
        x = takes[np.lexsort((takes, feature[takes], -loss[takes]))[0]]
        return self.row(node, total, x, feature, bin_, missing, loss, left, sets)

    def symmetric(self, hists: dict, nodes: dict) -> tuple[float, dict] | None:
        """(score, split of each node that it helps) of the one split that helps a whole level most.

        The score is the sum of what the split gains beyond gamma in the nodes that take it.
        """
        scores: dict[tuple, list] = {}
        for name, hist in hists.items():
            total, feature, bin_, missing, loss, ok, left, sets = self.candidates(hist, nodes[name])
            for x in np.flatnonzero(self.takes(loss, ok)).tolist():
                key = (int(feature[x]), bool(missing[x]), int(bin_[x]), None if sets[x] is None else tuple(sorted(map(int, sets[x]))))
                at = scores.setdefault(key, [0.0, x, {}])
                at[0] += float(loss[x]) - self.reg.gamma
                at[2][name] = self.row(nodes[name], total, x, feature, bin_, missing, loss, left, sets)
        if not scores:
            return None
        key = min(scores, key=lambda k: (-scores[k][0], k[0], k[1], -k[2] if k[1] else k[2]))
        return scores[key][0], scores[key][2]
