"""Models in XGBoost's JSON form."""

from __future__ import annotations

import json
import math

from ..errors import IncompatibleModel
from ..model import Model, Tree


def read(document: str | dict) -> Model:
    """The model of an XGBoost JSON document (or what it parses to) with tree boosters and scalar leaves."""
    learner = (json.loads(document) if isinstance(document, str) else document)["learner"]
    booster = learner["gradient_booster"]
    weights = None
    if booster["name"] == "dart":
        weights, booster = booster["weight_drop"], booster["gbtree"]
    elif booster["name"] != "gbtree":
        raise IncompatibleModel(f"booster {booster['name']!r} is not read")
    model = booster["model"]
    head = learner["learner_model_param"]
    name = learner["objective"]["name"]
    classes, targets = int(head.get("num_class", 0)), int(head.get("num_target", 1) or 1)
    outputs = max(classes, targets, 1)
    base = [float(x) for x in str(head["base_score"]).strip("[]").split(",")]
    if name.startswith("binary:") or name == "reg:logistic":
        base = [math.log(b / (1 - b)) for b in base]
    elif name in ("count:poisson", "reg:gamma", "reg:tweedie", "survival:cox", "survival:aft"):
        base = [math.log(b) for b in base]
    base = base * outputs if len(base) == 1 else base
    info = model["tree_info"]
    parallel = max(1, int(model["gbtree_model_param"].get("num_parallel_tree", 1)))
    trees = []
    for k, (t, output) in enumerate(zip(model["trees"], info, strict=True)):
        n = len(t["left_children"])
        cats: list = [None] * n
        for node, begin, size in zip(t.get("categories_nodes", []), t.get("categories_segments", []), t.get("categories_sizes", []), strict=True):
            right = {float(c) for c in t["categories"][begin : begin + size]}
            cats[node] = right  # the document lists the categories that go right
        leaf = [c < 0 for c in t["left_children"]]
        tree = Tree(
            iteration=k // (outputs * parallel), output=int(output), parallel=k % parallel, weight=float(weights[k]) if weights else 1.0,
            left=[int(c) for c in t["left_children"]], right=[int(c) for c in t["right_children"]],
            feature=[-1 if x else int(f) for x, f in zip(leaf, t["split_indices"], strict=True)], bin=[-1] * n,
            threshold=[0.0 if x else float(v) for x, v in zip(leaf, t["split_conditions"], strict=True)],
            default_left=[bool(d) for d in t["default_left"]], categories=[None] * n,
            value=[float(v) if x else float(w) for x, v, w in zip(leaf, t["split_conditions"], t["base_weights"], strict=True)],
            gain=[float(v) for v in t["loss_changes"]], cover=[float(v) for v in t["sum_hessian"]], depth=[0] * n,
        )
        for node, right in enumerate(cats):
            if right is not None:  # trade places, so that the listed categories go left
                tree.left[node], tree.right[node], tree.default_left[node] = tree.right[node], tree.left[node], not tree.default_left[node]
                tree.categories[node] = sorted(right)
        trees.append(tree)
    options = {"num_class": classes} if classes else {}
    n_features = int(head["num_feature"])
    return Model(name, options, list(learner.get("feature_names") or [f"f{k}" for k in range(n_features)]), base, trees)


def write(model: Model) -> str:
    """The model as an XGBoost JSON document, with sets of categories and, as a dart booster, tree weights."""
    if model.linear is not None:
        raise IncompatibleModel("linear models aren't written")
    trees = []
    for k, t in enumerate(model.trees):
        n = len(t.left)
        parents = t.parents()
        left, right, default = list(t.left), list(t.right), [int(d) for d in t.default_left]
        cats, nodes, segments, sizes = [], [], [], []
        for node, own in enumerate(t.categories):
            if own is not None:  # the document lists the categories that go right: the children trade places
                left[node], right[node], default[node] = right[node], left[node], 1 - default[node]
                nodes.append(node)
                segments.append(len(cats))
                sizes.append(len(own))
                cats += [int(c) for c in own]
        trees.append(
            {
                "id": k, "tree_param": {"num_nodes": str(n), "num_feature": str(len(model.features)), "num_deleted": "0", "size_leaf_vector": "1"},
                "left_children": left, "right_children": right, "parents": [parents.get(i, 2147483647) for i in range(n)],
                "split_indices": [max(f, 0) for f in t.feature], "split_conditions": [float(v if f < 0 else c) for f, c, v in zip(t.feature, t.threshold, t.value, strict=True)],
                "split_type": [int(c is not None) for c in t.categories], "default_left": default, "base_weights": [float(v) for v in t.value], "loss_changes": [float(v) for v in t.gain], "sum_hessian": [float(v) for v in t.cover],
                "categories": cats, "categories_nodes": nodes, "categories_segments": segments, "categories_sizes": sizes,
            }
        )
    base = model.base
    if model.objective.startswith("binary:") or model.objective == "reg:logistic":
        base = [1 / (1 + math.exp(-b)) for b in base]
    elif model.objective in ("count:poisson", "reg:gamma", "reg:tweedie", "survival:cox", "survival:aft"):
        base = [math.exp(b) for b in base]
    parallel = 1 + max((t.parallel for t in model.trees), default=0)
    learner = {
        "learner_model_param": {"base_score": "[" + ",".join(repr(b) for b in base) + "]", "num_class": str(model.options.get("num_class", 0)), "num_feature": str(len(model.features)), "num_target": "1"},
        "objective": {"name": model.objective}, "feature_names": model.features, "feature_types": [], "attributes": {},
        "gradient_booster": {"name": "gbtree", "model": {"gbtree_model_param": {"num_trees": str(len(trees)), "num_parallel_tree": str(parallel)}, "trees": trees, "tree_info": [t.output for t in model.trees]}},
    }
    if any(t.weight != 1 for t in model.trees):
        learner["gradient_booster"] = {"name": "dart", "gbtree": learner["gradient_booster"], "weight_drop": [float(t.weight) for t in model.trees]}
    return json.dumps({"learner": learner, "version": [3, 0, 0]})
