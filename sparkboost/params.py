"""Training parameters: names, aliases, ranges, and the combinations that are refused."""

from __future__ import annotations

import difflib
from dataclasses import dataclass, field, fields
from typing import Any

from .errors import InvalidParameter

ALIASES = {"learning_rate": "eta", "min_split_loss": "gamma", "reg_lambda": "lambda_", "lambda": "lambda_", "reg_alpha": "alpha", "random_state": "seed", "n_jobs": "nthread", "max_leaf_nodes": "max_leaves"}
#: Options that are accepted at one value only.
ONLY = {"updater": None, "feature_selector": "cyclic", "lambdarank_pair_method": "topk", "max_cat_to_onehot": 4, "max_cat_threshold": 64, "verbosity": 0}
#: Options that belong to an objective.
LOSS_OPTIONS = ("num_class", "scale_pos_weight", "huber_slope", "quantile_alpha", "expectile_alpha", "thresholds", "tweedie_variance_power", "lambdarank_num_pair_per_sample", "aft_loss_distribution", "aft_loss_distribution_scale", "pairs", "transform", "outputs")


@dataclass
class Params:
    """Parameters of one training; see ``parse`` for the flat form."""

    booster: str = "gbtree"
    objective: str = "reg:squarederror"
    base_score: float | None = None
    eval_metric: list[str] = field(default_factory=list)
    eta: float = 0.3
    gamma: float = 0.0
    max_depth: int = 6
    max_leaves: int = 0
    min_child_weight: float = 1.0
    min_child_groups: int = 1
    max_delta_step: float | None = None
    subsample: float = 1.0
    sampling_method: str = "uniform"
    colsample_bytree: float = 1.0
    colsample_bylevel: float = 1.0
    colsample_bynode: float = 1.0
    lambda_: float = 1.0
    alpha: float = 0.0
    tree_method: str = "auto"
    grow_policy: str = "depthwise"
    max_bin: int = 256
    monotone_constraints: dict[str, int] = field(default_factory=dict)
    interaction_constraints: list[list[str]] = field(default_factory=list)
    num_parallel_tree: int = 1
    rate_drop: float = 0.0
    skip_drop: float = 0.0
    one_drop: bool = False
    balanced_bagging: tuple[float, float] | None = None
    bagging_by_query: bool = False
    multi_strategy: str = "one_output_per_tree"
    process_type: str = "default"
    leaf_estimation: str = "newton"
    extra_trees: bool = False
    extra_seed: int = 6
    path_smooth: float = 0.0
    quantized_bins: int = 0
    quantized_stochastic: bool = True
    quantized_renew: bool = False
    toad_penalty_feature: float = 0.0
    toad_penalty_threshold: float = 0.0
    langevin: bool = False
    diffusion_temperature: float = 10_000.0
    model_shrink_rate: float = 0.0
    model_shrink_mode: str = "constant"
    seed: int = 0
    nthread: int | None = None
    device: str = "cpu"
    loss: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.validate()

    def validate(self) -> None:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise InvalidParameter(what)

        need(self.booster in ("gbtree", "dart", "gblinear", "ebm"), f"unknown booster {self.booster!r}")
        need(self.booster != "ebm" or not self.interaction_constraints, "the terms of ebm are single features")
        need(self.device == "cpu", "device must be cpu")
        need(self.tree_method in ("auto", "hist", "approx", "exact"), f"unknown tree_method {self.tree_method!r}")
        need(self.grow_policy in ("depthwise", "lossguide", "symmetric"), f"unknown grow_policy {self.grow_policy!r}")
        need(self.min_child_groups >= 1, "min_child_groups is at least 1")
        need(self.min_child_groups == 1 or self.grow_policy != "symmetric", "symmetric trees take no split groups")
        need(self.tree_method != "exact" or self.grow_policy == "depthwise", "exact trees grow by depth")
        need(self.tree_method != "exact" or self.sampling_method == "uniform", "gradient_based sampling needs hist or approx")
        need(self.multi_strategy in ("one_output_per_tree", "multi_output_tree"), f"unknown multi_strategy {self.multi_strategy!r}")
        need(self.process_type in ("default", "update"), f"unknown process_type {self.process_type!r}")
        need(self.leaf_estimation in ("newton", "exact"), f"unknown leaf_estimation {self.leaf_estimation!r}")
        need(self.leaf_estimation == "newton" or self.objective in ("reg:quantileerror", "reg:absoluteerror"), "exact leaves are those of reg:quantileerror and reg:absoluteerror")
        need(self.leaf_estimation == "newton" or not (self.langevin or self.path_smooth or self.monotone_constraints), "exact leaves take no langevin, path_smooth or monotone constraints")
        need(self.grow_policy != "symmetric" or not (self.extra_trees or self.path_smooth), "symmetric trees take no extra_trees or path_smooth")
        need(self.balanced_bagging is None or self.objective.startswith("binary:"), "balanced bagging needs binary labels")
        need(self.balanced_bagging is None or all(0 < x <= 1 for x in self.balanced_bagging), "both shares of balanced_bagging lie in (0, 1]")
        need(self.balanced_bagging is None or (self.subsample == 1 and not self.bagging_by_query), "balanced bagging takes no other sampling")
        need(self.quantized_bins == 0 or self.quantized_bins >= 2, "quantized_bins is 0 (off) or 2 at least")
        need(self.diffusion_temperature > 0, "diffusion_temperature must be positive")
        need(self.model_shrink_mode in ("constant", "decreasing"), f"unknown model_shrink_mode {self.model_shrink_mode!r}")
        need(self.model_shrink_rate * (self.eta if self.model_shrink_mode == "constant" else 1.0) < 1, "model_shrink_rate must leave a positive factor")
        need(self.booster != "dart" or not (self.model_shrink_rate or self.langevin), "dart takes no langevin and no model shrinkage")
        need(self.sampling_method in ("uniform", "gradient_based"), f"unknown sampling_method {self.sampling_method!r}")
        for name in ("subsample", "colsample_bytree", "colsample_bylevel", "colsample_bynode"):
            need(0 < getattr(self, name) <= 1, f"{name} lies in (0, 1]")
        for name in ("gamma", "min_child_weight", "lambda_", "alpha", "rate_drop", "skip_drop", "path_smooth", "toad_penalty_feature", "toad_penalty_threshold", "model_shrink_rate"):
            need(getattr(self, name) >= 0, f"{name} must not be negative")
        need(0 < self.eta, "eta must be positive")
        need(self.max_depth >= 0 and self.max_leaves >= 0, "max_depth and max_leaves must not be negative")
        need(self.max_depth > 0 or self.max_leaves > 0 or self.booster == "gblinear", "max_depth 0 needs max_leaves")
        need(self.grow_policy != "symmetric" or self.max_depth <= 16, "a symmetric tree has at most 16 levels")
        need(2 <= self.max_bin <= 32767, "max_bin lies in 2..32767")
        need(1 <= self.num_parallel_tree <= 65536, "num_parallel_tree lies in 1..65536")
        need(not (self.booster == "dart" and self.num_parallel_tree > 1), "dart grows one tree a round")
        need(not (self.sampling_method == "gradient_based" and self.booster == "gblinear"), "gblinear doesn't sample rows")
        need(not (self.grow_policy == "symmetric" and self.monotone_constraints), "symmetric trees take no monotone constraints")

    @property
    def step_bound(self) -> float:
        """Bound of leaf weights: the loss's own by default."""
        if self.max_delta_step is not None:
            return self.max_delta_step
        return 0.7 if self.objective == "count:poisson" else 0.0


def parse(options: dict[str, Any]) -> Params:
    """Params of a flat dictionary of options; an unknown name is refused with a suggestion."""
    known = {f.name for f in fields(Params)} - {"loss"}
    out: dict[str, Any] = {"loss": {}}
    for name, value in options.items():
        key = ALIASES.get(name, name)
        if key in ONLY:
            if value != ONLY[key]:
                raise InvalidParameter(f"{name} is supported at {ONLY[key]!r} only")
        elif key in LOSS_OPTIONS:
            out["loss"][key] = value
        elif key in known:
            out[key] = [value] if key == "eval_metric" and isinstance(value, str) else value
        else:
            near = difflib.get_close_matches(name, [*known, *ALIASES, *LOSS_OPTIONS], 1)
            raise InvalidParameter(f"unknown parameter {name!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
    return Params(**out)
