"""Trees of a model with statistics, and leaves, of other rows."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Model, Tree
from ..operators.split import Regularisation
from ..params import Params, parse


def refreshed(params: Params | dict, model: Model, df: DataFrame, label: str, *, weight: str | None = None, refresh_leaf: bool = True) -> Model:
    """The model's structure with covers, and if refresh_leaf leaf values, of df.

    Every tree is one aggregate by its leaves (at most as many rows as leaves); the sums of
    inner nodes are added up on the driver.  Gradients are taken at the margins of the
    refreshed trees before.
    """
    if isinstance(params, dict):
        params = parse(params)
    loss = model.loss
    reg = Regularisation(params.lambda_, params.alpha, params.gamma, params.min_child_weight, params.step_bound)
    out = Model(model.objective, model.options, model.features, model.base, [])
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    for i in range(model.iterations):
        trees = [t for t in model.trees if t.iteration == i]
        rows = out.margins(df.withColumn("__label", F.col(label).cast("double")).withColumn("__weight", w), ["__label", "__weight", *model.features])
        rows = loss.prepare(rows, [f"m{k}" for k in range(model.outputs)], "__label", F.col("__weight"))
        pairs = loss.pairs([F.col(f"m{k}") for k in range(model.outputs)], F.col("__label"), F.col("__weight"))
        for k, (g, h) in enumerate(pairs):
            rows = rows.withColumn(f"__g{k}", g).withColumn(f"__h{k}", h)
        one = Model(model.objective, model.options, model.features, model.base, [Tree(**{**asdict(t), "iteration": 0}) for t in trees])
        keep = [f"__{c}{k}" for k in range(model.outputs) for c in "gh"]
        leaves = one.predict_leaf(rows, keep, (0, 1))
        each = F.explode(F.array(*(F.struct(F.lit(s).alias("slot"), F.col("leaves")[s].alias("leaf"), F.col(f"__g{t.output}").alias("g"), F.col(f"__h{t.output}").alias("h")) for s, t in enumerate(trees))))
        sums = leaves.select(each.alias("e")).groupBy("e.slot", "e.leaf").agg(F.sum("e.g").alias("g"), F.sum("e.h").alias("h")).collect()
        for s, t in enumerate(trees):
            new = Tree(**asdict(t))
            total = {n: (0.0, 0.0) for n in range(len(t.left))}
            parents = t.parents()
            for r in sums:
                if r["slot"] == s:
                    n = r["leaf"]
                    while True:
                        total[n] = (total[n][0] + r["g"], total[n][1] + r["h"])
                        if n not in parents:
                            break
                        n = parents[n]
            new.cover = [total[n][1] for n in range(len(t.left))]
            if refresh_leaf:
                new.value = [reg.number(*total[n]) * params.eta / params.num_parallel_tree for n in range(len(t.left))]
            out.trees.append(new)
    return out
