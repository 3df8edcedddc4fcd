"""Models in LightGBM's text form, version 4."""

from __future__ import annotations

import numpy as np

from ..errors import IncompatibleModel
from ..model import Model, Tree

#: Objectives by their names in the text; those of one output.
OBJECTIVES = {"regression": "reg:squarederror", "regression_l2": "reg:squarederror", "regression_l1": "reg:absoluteerror", "huber": "reg:pseudohubererror", "quantile": "reg:quantileerror", "poisson": "count:poisson", "gamma": "reg:gamma", "tweedie": "reg:tweedie", "binary": "binary:logistic", "lambdarank": "rank:ndcg", "rank_xendcg": "rank:xendcg"}


def _block(lines: list[str]) -> dict[str, str]:
    return dict(line.split("=", 1) for line in lines if "=" in line)


def _threshold(t: float) -> float:
    """The 32-bit number below which lie just the 32-bit numbers up to t."""
    with np.errstate(over="ignore"):
        f = np.float32(t)
    if float(f) > t:
        f = np.nextafter(f, np.float32(-np.inf))
    return float(np.nextafter(f, np.float32(np.inf)))


def _tree(x: dict[str, str], iteration: int, output: int, weight: float) -> Tree:
    n = int(x["num_leaves"])
    numbers = lambda key, kind=float: [kind(v) for v in x.get(key, "").split()]
    if x.get("is_linear", "0").strip() == "1":
        raise IncompatibleModel("linear leaves are not read")
    leaf, inner = numbers("leaf_value"), n - 1
    tree = Tree(iteration=iteration, output=output, weight=weight)
    if not inner:
        tree.value[0] = leaf[0]
        return tree
    left, right, kinds = numbers("left_child", int), numbers("right_child", int), numbers("decision_type", int)
    features, thresholds, gains = numbers("split_feature", int), numbers("threshold"), numbers("split_gain")
    bounds, words = numbers("cat_boundaries", int), numbers("cat_threshold", int)
    cover = numbers("leaf_weight") or numbers("leaf_count") or [0.0] * n
    inner_cover = numbers("internal_weight") or numbers("internal_count") or [0.0] * inner
    at, todo = {0: 0}, [0]
    while todo:
        k = todo.pop()
        kind, f = kinds[k], features[k]
        missing = kind >> 2 & 3
        if kind & 1:
            b, e = bounds[int(thresholds[k])], bounds[int(thresholds[k]) + 1]
            cats = [float(32 * j + bit) for j, w in enumerate(words[b:e]) for bit in range(32) if w >> bit & 1]
            a, b = tree.split(at[k], f, -1, 0.0, False, cats, gains[k])
        else:
            if missing == 1:
                raise IncompatibleModel("zero as a missing value is not read")
            default = bool(kind & 2) if missing == 2 else thresholds[k] >= 0  # without a missing type, a missing value counts as 0
            a, b = tree.split(at[k], f, -1, _threshold(thresholds[k]), default, None, gains[k])
        tree.cover[at[k]] = inner_cover[k]
        for node, child in ((a, left[k]), (b, right[k])):
            if child >= 0:
                at[child] = node
                todo.append(child)
            else:
                tree.value[node], tree.cover[node] = leaf[~child], cover[~child]
    return tree


def read(text: str) -> Model:
    """The model of a text; linear leaves and zero as missing value are refused."""
    lines = text.splitlines()
    if not lines or lines[0].strip() != "tree":
        raise IncompatibleModel("not a text model")
    starts = [k for k, line in enumerate(lines) if line.startswith("Tree=")]
    ends = next((k for k, line in enumerate(lines) if line.strip() == "end of trees"), len(lines))
    head = _block(lines[: starts[0] if starts else ends])
    words = head.get("objective", "regression").split()
    outputs, options = int(head.get("num_tree_per_iteration", 1)), {}
    own = dict(w.split(":", 1) for w in words[1:] if ":" in w)
    if words[0] in ("multiclass", "softmax"):
        name, options = "multi:softprob", {"num_class": outputs}
    elif words[0] in OBJECTIVES:
        name = OBJECTIVES[words[0]]
    else:
        raise IncompatibleModel(f"objective {words[0]!r} is not read")
    if float(own.get("sigmoid", 1)) != 1:
        raise IncompatibleModel("a sigmoid with a factor is not read")
    if name == "reg:quantileerror":
        options = {"quantile_alpha": [float(own.get("alpha", 0.5))]}
    blocks = [_block(lines[a:b]) for a, b in zip(starts, [*starts[1:], ends], strict=True)]
    weight = outputs / len(blocks) if "average_output" in (line.strip() for line in lines[:20]) and blocks else 1.0
    trees = [_tree(b, k // outputs, k % outputs, weight) for k, b in enumerate(blocks)]
    return Model(name, options, head["feature_names"].split(), [0.0] * outputs, trees)
