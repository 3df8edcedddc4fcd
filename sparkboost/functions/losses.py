"""Training objectives: gradients and Hessians as column expressions.

An objective turns margins (one column for each output), a label and a weight into a
(gradient, Hessian) pair of columns for each output.  Objectives that need sums over all rows
declare them with ``prepare``, which adds columns before the pairs are formed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidParameter

Pairs = list[tuple[Column, Column]]
#: Smallest Hessian of the logistic losses, of softmax, and the floor of log1p losses.
LOGISTIC_FLOOR, SOFTMAX_FLOOR, EPS = 1e-16, 1e-16, 1e-6


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def softplus_inverse(x: float) -> float:
    x = max(x, EPS)
    return x + math.log(-math.expm1(-x))


@dataclass
class Objective:
    """A loss with one output; subclasses override what differs."""

    name: str
    metric: str
    options: dict = field(default_factory=dict)
    #: Whether gradients join, order or run Python, so that a round keeps them instead of forming them at each level.
    costly = False

    @property
    def outputs(self) -> int:
        return 1

    def prepare(self, df: DataFrame, margins: Sequence[str], label: str, weight: Column) -> DataFrame:
        return df

    def pairs(self, margins: Sequence[Column], label: Column, weight: Column) -> Pairs:
        raise NotImplementedError

    def transform(self, margins: Sequence[Column]) -> list[Column]:
        return list(margins)

    def link(self, base: float) -> float:
        """The margin of a base score that the user gave as a prediction."""
        return base

    def allowed(self, label: Column) -> Column | None:
        """Condition that all labels meet."""
        return None

    def intercepts(self, df: DataFrame, label: str, weight: Column) -> list[float]:
        """One Newton step from zero margins."""
        zero = df
        names = []
        for k in range(self.outputs):
            zero = zero.withColumn(f"__m{k}", F.lit(0.0))
            names.append(f"__m{k}")
        zero = self.prepare(zero, names, label, weight)
        sums = [x for k, (g, h) in enumerate(self.pairs([F.col(n) for n in names], F.col(label), weight)) for x in (F.sum(g).alias(f"g{k}"), F.sum(h).alias(f"h{k}"))]
        row = zero.agg(*sums).first()
        return [-(row[f"g{k}"] or 0.0) / max(row[f"h{k}"] or 0.0, 1e-6) for k in range(self.outputs)]


class SquaredError(Objective):
    def pairs(self, margins, label, weight):
        w = weight * F.when(label == 1, float(self.options.get("scale_pos_weight", 1.0))).otherwise(1.0)
        return [(w * (margins[0] - label), w)]

    def intercepts(self, df, label, weight):
        row = df.agg((F.sum(weight * F.col(label)) / F.sum(weight)).alias("m")).first()
        return [float(row["m"] or 0.0)]


class SquaredLogError(Objective):
    def pairs(self, margins, label, weight):
        p = F.greatest(margins[0], F.lit(-1 + EPS))
        d = F.log1p(p) - F.log1p(label)
        return [(weight * d / (p + 1), weight * F.greatest((1 - d) / ((p + 1) * (p + 1)), F.lit(EPS)))]

    def allowed(self, label):
        return label > -1


class PseudoHuber(Objective):
    def pairs(self, margins, label, weight):
        d2 = float(self.options.get("huber_slope", 1.0)) ** 2
        z = margins[0] - label
        s = F.sqrt(1 + z * z / d2)
        return [(weight * z / s, weight * d2 / ((d2 + z * z) * s))]


def _scale(margin: str, label: str, weight: Column) -> Column:
    """Squared mean of the roots of the absolute residuals."""
    r = F.sqrt(F.abs(F.col(margin) - F.col(label)))
    mean = F.sum(weight * r) / F.sum(weight)
    return mean * mean


def _with_sums(df: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """df with global sums as constants, by one small job."""
    row = df.agg(*(c.alias(k) for k, c in sums.items())).first()
    for k in sums:
        df = df.withColumn(k, F.lit(float(row[k]) if row[k] is not None else 0.0))
    return df


class AbsoluteError(Objective):
    def prepare(self, df, margins, label, weight):
        return _with_sums(df, {"__scale0": _scale(margins[0], label, weight)})

    def pairs(self, margins, label, weight):
        return self.scaled(margins[0], label, weight, F.col("__scale0"))

    def scaled(self, margin: Column, label: Column, weight: Column, scale: Column) -> Pairs:
        r = margin - label
        both = F.hypot(scale, r)
        c = F.when(both == 0, 1.0).otherwise(scale / F.when(both == 0, 1.0).otherwise(both))
        return [(weight * r * c, weight * c)]

    def intercepts(self, df, label, weight):
        mean = SquaredError("", "").intercepts(df, label, weight)[0]
        at = self.prepare(df.withColumn("__m0", F.lit(mean)), ["__m0"], label, weight)
        g, h = self.pairs([F.col("__m0")], F.col(label), weight)[0]
        row = at.agg(F.sum(g).alias("g"), F.sum(h).alias("h")).first()
        return [mean - (row["g"] or 0.0) / max(row["h"] or 0.0, 1e-6)]


class Quantile(Objective):
    """Smoothed pinball losses at ``quantile_alpha``, one output for each."""

    @property
    def alphas(self) -> list[float]:
        return list(self.options.get("quantile_alpha", [0.5]))

    @property
    def outputs(self):
        return len(self.alphas)

    def prepare(self, df, margins, label, weight):
        return _with_sums(df, {f"__scale{k}": _scale(m, label, weight) for k, m in enumerate(margins)})

    def pairs(self, margins, label, weight):
        out = []
        for k, (m, a) in enumerate(zip(margins, self.alphas, strict=True)):
            s = F.col(f"__scale{k}")
            x = (m - label) / (0.04 * F.when(s > 0, s))
            t = F.tanh(x)
            ratio = F.greatest(F.when(x == 0, 1.0).otherwise(t / F.when(x == 0, 1.0).otherwise(x)), F.lit(3e-4))
            g, h = 0.5 * s * (t + 1 - 2 * a), 0.5 / 0.04 * ratio
            out.append((F.coalesce(weight * g, F.lit(0.0)), F.coalesce(weight * h, F.lit(0.0))))
        return out

    def transform(self, margins):
        if len(margins) == 1:
            return list(margins)
        ordered = F.sort_array(F.array(*margins))
        return [ordered[k] for k in range(len(margins))]

    def intercepts(self, df, label, weight):
        from ..operators.order import grid_quantiles

        return grid_quantiles(df, label, self.alphas)


class Expectile(Objective):
    """Expectiles at ``quantile_alpha`` that can't cross."""

    @property
    def alphas(self) -> list[float]:
        return list(self.options.get("expectile_alpha", self.options.get("quantile_alpha", [0.5])))

    @property
    def outputs(self):
        return len(self.alphas)

    def transform(self, margins):
        out = [margins[0]]
        for m in margins[1:]:
            out.append(out[-1] + 1e-6 + softplus(m))
        return out

    def pairs(self, margins, label, weight):
        q = self.transform(margins)
        d = [x - label for x in q]
        a = [weight * F.when(x >= 0, 1 - alpha).otherwise(alpha) for x, alpha in zip(d, self.alphas, strict=True)]
        out = []
        for j, m in enumerate(margins):
            s = F.lit(1.0) if j == 0 else sigmoid(m)
            g = sum((a[k] * d[k] for k in range(j + 1, len(q))), a[j] * d[j])
            h = sum((a[k] for k in range(j + 1, len(q))), a[j])
            out.append((s * g, s * s * h))
        return out

    def intercepts(self, df, label, weight):
        mean = SquaredError("", "").intercepts(df, label, weight)[0]
        sums = []
        for k, alpha in enumerate(self.alphas):
            w = weight * F.when(F.lit(mean) - F.col(label) >= 0, 1 - alpha).otherwise(alpha)
            sums += [F.sum(w * (F.lit(mean) - F.col(label))).alias(f"g{k}"), F.sum(w).alias(f"h{k}")]
        row = df.agg(*sums).first()
        q = [mean - (row[f"g{k}"] or 0.0) / max(row[f"h{k}"] or 0.0, 1e-6) for k in range(self.outputs)]
        for k in range(1, len(q)):
            q[k] = max(q[k], q[k - 1])
        return [q[0], *(softplus_inverse(q[k] - q[k - 1] - 1e-6) for k in range(1, len(q)))]


class Logistic(Objective):
    def _positive(self, label: Column) -> Column:
        return F.when(label == 1, float(self.options.get("scale_pos_weight", 1.0))).otherwise(1.0)

    def pairs(self, margins, label, weight):
        p = sigmoid(margins[0])
        w = weight * self._positive(label)
        return [(w * (p - label), w * F.greatest(p * (1 - p), F.lit(LOGISTIC_FLOOR)))]

    def transform(self, margins):
        return [sigmoid(margins[0])] if self.name != "binary:logitraw" else list(margins)

    def link(self, base):
        if not 0 < base < 1:
            raise InvalidParameter("base_score of a logistic loss lies between 0 and 1")
        return math.log(base / (1 - base))

    def allowed(self, label):
        return label.between(0, 1)

    def intercepts(self, df, label, weight):
        w = weight * self._positive(F.col(label))
        row = df.agg((F.sum(w * F.col(label)) / F.sum(w)).alias("m")).first()
        p = min(max(row["m"] if row["m"] is not None else 0.5, EPS), 1 - EPS)
        return [math.log(p / (1 - p))]


class Exceedance(Objective):
    """Logistic losses of ``label >= threshold``, one output for each of ``thresholds``."""

    @property
    def thresholds(self) -> list[float]:
        return list(self.options["thresholds"])

    @property
    def outputs(self):
        return len(self.thresholds)

    def pairs(self, margins, label, weight):
        one = Logistic("", "")
        return [one.pairs([m], F.when(label >= k, 1.0).otherwise(0.0), weight)[0] for m, k in zip(margins, self.thresholds, strict=True)]

    def transform(self, margins):
        p = F.sort_array(F.array(*(sigmoid(m) for m in margins)), asc=False)
        return [p[k] for k in range(len(margins))]

    def intercepts(self, df, label, weight):
        shares = [(F.sum(F.when(F.col(label) >= k, weight).otherwise(0.0)) / F.sum(weight)).alias(f"s{j}") for j, k in enumerate(self.thresholds)]
        row = df.agg(*shares).first()
        p = [min(max(row[f"s{j}"] or 0.0, EPS), 1 - EPS) for j in range(self.outputs)]
        return [math.log(x / (1 - x)) for x in p]


class Hinge(Objective):
    def pairs(self, margins, label, weight):
        z = 2 * label - 1
        inside = margins[0] * z < 1
        return [(F.when(inside, -z * weight).otherwise(0.0), F.when(inside, weight).otherwise(1.1754943508222875e-38))]

    def transform(self, margins):
        return [F.when(margins[0] > 0, 1.0).otherwise(0.0)]


class Softmax(Objective):
    @property
    def outputs(self):
        return int(self.options["num_class"])

    def probabilities(self, margins: Sequence[Column]) -> list[Column]:
        top = F.greatest(*margins) if len(margins) > 1 else margins[0]
        e = [F.exp(m - top) for m in margins]
        total = sum(e[1:], e[0])
        return [x / total for x in e]

    def pairs(self, margins, label, weight):
        out = []
        for k, p in enumerate(self.probabilities(margins)):
            out.append((weight * (p - F.when(label == k, 1.0).otherwise(0.0)), F.greatest(2 * p * (1 - p) * weight, F.lit(SOFTMAX_FLOOR))))
        return out

    def transform(self, margins):
        if self.name == "multi:softprob":
            return self.probabilities(margins)
        values = F.array(*margins)
        return [(F.array_position(values, F.array_max(values)) - 1).cast("double")]

    def allowed(self, label):
        return label.between(0, self.outputs - 1) & (label == F.floor(label))

    def intercepts(self, df, label, weight):
        return [0.0] * self.outputs


class Poisson(Objective):
    def pairs(self, margins, label, weight):
        step = float(self.options.get("max_delta_step", 0.7))
        return [(weight * (F.exp(margins[0]) - label), weight * F.exp(margins[0] + step))]

    def transform(self, margins):
        return [F.exp(margins[0])]

    def link(self, base):
        return math.log(base)

    def allowed(self, label):
        return label >= 0


class Gamma(Poisson):
    def pairs(self, margins, label, weight):
        p = F.exp(margins[0])
        w = weight * F.when(label == 1, float(self.options.get("scale_pos_weight", 1.0))).otherwise(1.0)
        return [(w * (1 - label / p), w * label / p)]

    def allowed(self, label):
        return label > 0


class Tweedie(Poisson):
    def pairs(self, margins, label, weight):
        r = float(self.options.get("tweedie_variance_power", 1.5))
        a, b = label * F.exp((1 - r) * margins[0]), F.exp((2 - r) * margins[0])
        return [(weight * (b - a), weight * ((2 - r) * b - (1 - r) * a))]


class Cox(Objective):
    """Breslow partial likelihood; a negative label is a censored time.

    The sum over a risk set is that of all rows with this time or a later one.  Events add up row by
    row in order of time, then of row_id: a row has the terms of the events up to itself, of a tied time
    too.  All sums run over ranges of rows, none through one task.
    """

    costly = True

    def prepare(self, df, margins, label, weight):
        from ..operators.order import running

        rows = df if "row_id" in df.columns else df.withColumn("row_id", F.xxhash64(*df.columns))
        rows = rows.withColumn("__time", F.abs(F.col(label)))
        by = rows.groupBy("__time").agg(F.sum(F.exp(F.col(margins[0]))).alias("__e"))
        by = running(by, ["__time"], {"__risk": F.col("__e")}, after=True).select("__time", "__risk")
        event = F.when(F.col(label) > 0, 1.0).otherwise(0.0)
        rows = rows.join(by, "__time").withColumns({"__a": event / F.col("__risk"), "__b": event / (F.col("__risk") * F.col("__risk"))})
        rows = running(rows, ["__time", "row_id"], {"__r": F.col("__a"), "__s": F.col("__b")})
        rows = rows.withColumns({"__r": F.col("__r") + F.col("__a"), "__s": F.col("__s") + F.col("__b")})
        return rows.drop("__time", "__risk", "__a", "__b", *([] if "row_id" in df.columns else ["row_id"]))

    def pairs(self, margins, label, weight):
        e = F.exp(margins[0])
        event = F.when(label > 0, 1.0).otherwise(0.0)
        return [(weight * (e * F.col("__r") - event), weight * (e * F.col("__r") - e * e * F.col("__s")))]

    def transform(self, margins):
        return [F.exp(margins[0])]

    def link(self, base):
        return math.log(base)


class Ranking(Objective):
    """LambdaMART over the pairs of a query whose better-placed row is among the first ``top_k``.

    Pairs are formed by a join of a query's first rows with all its rows: top_k times the
    rows, never all pairs of a query.
    """

    costly = True

    GROUP = "qid"

    @property
    def top_k(self) -> int:
        return int(self.options.get("lambdarank_num_pair_per_sample", 32))

    def prepare(self, df, margins, label, weight):
        rows = df.withColumn("__row", F.monotonically_increasing_id() if "row_id" not in df.columns else F.col("row_id"))
        q = Window.partitionBy(self.GROUP)
        place = Window.partitionBy(self.GROUP).orderBy(F.desc(margins[0]), "__row")
        best = Window.partitionBy(self.GROUP).orderBy(F.desc(label), "__row")
        rows = rows.withColumn("__rank", F.row_number().over(place) - 1).withColumn("__n", F.count("*").over(q)).withColumn("__span", F.max(margins[0]).over(q) - F.min(margins[0]).over(q))
        gain = lambda y: F.pow(F.lit(2.0), y) - 1
        discount = lambda r: 1 / F.log2(r + 2.0)
        ideal = rows.withColumn("__best", F.row_number().over(best) - 1).groupBy(self.GROUP).agg(F.sum(F.when(F.col("__best") < self.top_k, gain(F.col(label)) * discount(F.col("__best"))).otherwise(0.0)).alias("__ideal"))
        hits = Window.partitionBy(self.GROUP).orderBy("__rank").rowsBetween(Window.unboundedPreceding, 0)
        relevant = F.when(F.col(label) > 0, 1).otherwise(0)
        rows = rows.withColumn("__hits", F.sum(relevant).over(hits)).withColumn("__rel", F.sum(relevant).over(q))
        rows = rows.withColumn("__acc", F.sum(relevant / (F.col("__rank") + 1)).over(hits)).join(ideal, self.GROUP)
        side = lambda s: rows.select(self.GROUP, F.col("__row").alias(f"row_{s}"), F.col("__rank").alias(f"rank_{s}"), F.col(margins[0]).alias(f"m_{s}"), F.col(label).alias(f"y_{s}"), F.col("__hits").alias(f"hits_{s}"), F.col("__acc").alias(f"acc_{s}"), *(["__span", "__ideal", "__rel"] if s == "i" else []))
        pairs = side("i").where(F.col("rank_i") < self.top_k).join(side("j"), self.GROUP).where("rank_i < rank_j and y_i <> y_j")
        up = F.col("y_i") > F.col("y_j")
        pick = lambda a, b: F.when(up, F.col(a)).otherwise(F.col(b))
        diff = pick("m_i", "m_j") - pick("m_j", "m_i")
        s = sigmoid(diff)
        if self.name == "rank:ndcg":
            delta = F.abs((gain(F.col("y_i")) - gain(F.col("y_j"))) * (discount(F.col("rank_i")) - discount(F.col("rank_j")))) / F.when(F.col("__ideal") > 0, F.col("__ideal")).otherwise(F.lit(float("inf")))
        elif self.name == "rank:map":
            # the change of average precision when a relevant and an irrelevant row trade places
            lower = F.when(up, -1.0).otherwise(1.0)
            inner = F.col("acc_j") - F.when(F.col("y_j") > 0, 1 / (F.col("rank_j") + 1.0)).otherwise(0.0) - F.col("acc_i")
            own = F.when(up, (F.col("hits_j") / (F.col("rank_j") + 1.0)) - F.col("hits_i") / (F.col("rank_i") + 1.0)).otherwise((F.col("hits_i") + 1) / (F.col("rank_i") + 1.0) - F.col("hits_j") / (F.col("rank_j") + 1.0))
            delta = F.abs(own + lower * inner) / F.when(F.col("__rel") > 0, F.col("__rel")).otherwise(F.lit(float("inf")))
        else:
            delta = F.lit(1.0)
        delta = F.when(F.col("__span") != 0, delta / (F.abs(diff) + 0.01)).otherwise(delta)
        pairs = pairs.withColumn("l", (s - 1) * delta).withColumn("h", F.greatest(s * (1 - s), F.lit(LOGISTIC_FLOOR)) * delta * 2)
        ends = F.array(F.struct(pick("row_i", "row_j").alias("__row"), F.col("l").alias("l")), F.struct(pick("row_j", "row_i").alias("__row"), (-F.col("l")).alias("l")))
        flat = pairs.select(self.GROUP, "h", F.explode(ends).alias("e")).select(self.GROUP, "e.__row", "e.l", "h")
        sums = flat.groupBy(self.GROUP, "__row").agg(F.sum("l").alias("__l"), F.sum("h").alias("__h"))
        total = pairs.groupBy(self.GROUP).agg(F.sum(-2 * F.col("l")).alias("__total"))
        out = rows.join(sums, [self.GROUP, "__row"], "left").join(total, self.GROUP, "left")
        norm = F.when(F.col("__total") > 0, F.log2(F.col("__total") + 1) / F.col("__total")).otherwise(1.0)
        out = out.withColumn("__lambda", F.coalesce("__l", F.lit(0.0)) * norm).withColumn("__curve", F.coalesce("__h", F.lit(0.0)) * norm)
        return out.drop("__rank", "__n", "__span", "__ideal", "__hits", "__rel", "__acc", "__l", "__h", "__total", *([] if "__row" in df.columns else ["__row"]))

    def pairs(self, margins, label, weight):
        return [(weight * F.col("__lambda"), weight * F.col("__curve"))]

    def intercepts(self, df, label, weight):
        return [0.5]


class CrossEntropyNdcg(Objective):
    """Softmax cross entropy of a query against its randomised gains ``2^label - U``, to the third order.

    U is a keyed draw of row_id.  A query's sums are aggregates that are joined back, so that a query
    of any size is added up by many tasks.
    """

    costly = True

    GROUP = "qid"

    def prepare(self, df, margins, label, weight):
        from .rng import uniform

        rows = df if "row_id" in df.columns else df.withColumn("row_id", F.xxhash64(*df.columns))
        u = uniform(F.col("row_id"), int(self.options.get("seed", 0)), int(self.options.get("iteration", 0)), 77)
        rows = rows.withColumns({"__m": F.col(margins[0]), "__phi": F.pow(F.lit(2.0), F.col(label)) - u})
        top = rows.groupBy(self.GROUP).agg(F.max("__m").alias("__top"), F.sum("__phi").alias("__all"), F.count("*").alias("__n"))
        rows = rows.join(top, self.GROUP).withColumn("__e", F.exp(F.col("__m") - F.col("__top")))
        rows = rows.join(rows.groupBy(self.GROUP).agg(F.sum("__e").alias("__z")), self.GROUP)
        rows = rows.withColumns({"__rho": F.col("__e") / F.col("__z"), "__q": (F.col("__z") - F.col("__e")) / F.col("__z")})
        rows = rows.withColumn("__l1", F.col("__rho") - F.col("__phi") / F.greatest("__all", F.lit(1e-15)))
        full = F.col("__q") < 1.1920928955078125e-07  # a saturated softmax has the first order only
        safe = F.when(full, F.lit(1.0)).otherwise(F.col("__q"))
        rows = rows.withColumn("__t1", F.col("__l1") / safe)
        rows = rows.join(rows.groupBy(self.GROUP).agg(F.sum("__t1").alias("__s1"), F.max(full).alias("__full")), self.GROUP)
        rows = rows.withColumn("__l2", F.col("__rho") * (F.col("__s1") - F.col("__t1"))).withColumn("__t2", F.col("__l2") / safe)
        rows = rows.join(rows.groupBy(self.GROUP).agg(F.sum("__t2").alias("__s2")), self.GROUP)
        l3 = F.col("__rho") * (F.col("__s2") - F.col("__t2"))
        g = F.when(F.col("__n") <= 1, 0.0).when(F.col("__full"), F.col("__l1")).otherwise(F.col("__l1") + F.col("__l2") + l3)
        rows = rows.withColumns({"__lambda": g, "__curve": F.when(F.col("__n") <= 1, 0.0).otherwise(F.col("__rho") * F.col("__q"))})
        return rows.drop("__m", "__phi", "__top", "__all", "__n", "__e", "__z", "__rho", "__q", "__l1", "__t1", "__s1", "__full", "__l2", "__t2", "__s2", *([] if "row_id" in df.columns else ["row_id"]))

    def pairs(self, margins, label, weight):
        return [(weight * F.col("__lambda"), weight * F.col("__curve"))]

    def intercepts(self, df, label, weight):
        return [0.0]


class MultiTarget(Objective):
    """An elementwise objective on several label columns (label, label1, ...), an output for each."""

    def __init__(self, one: Objective, targets: int) -> None:
        super().__init__(one.name, one.metric, one.options)
        self.one, self.targets = one, targets

    @property
    def outputs(self):
        return self.targets

    @staticmethod
    def _name(label: str, k: int) -> str:
        return label if not k else f"{label}{k}"

    def prepare(self, df, margins, label, weight):
        if isinstance(self.one, AbsoluteError):
            return _with_sums(df, {f"__scale{k}": _scale(m, self._name(label, k), weight) for k, m in enumerate(margins)})
        return df

    def pairs(self, margins, label, weight):
        out = []
        for k, m in enumerate(margins):
            y = label if not k else F.col(f"label{k}")
            if isinstance(self.one, AbsoluteError):
                out += self.one.scaled(m, y, weight, F.col(f"__scale{k}"))
            else:
                out += self.one.pairs([m], y, weight)
        return out

    def transform(self, margins):
        return [x for m in margins for x in self.one.transform([m])]

    def link(self, base):
        return self.one.link(base)

    def allowed(self, label):
        return self.one.allowed(label)

    def intercepts(self, df, label, weight):
        return [x for k in range(self.targets) for x in self.one.intercepts(df, self._name(label, k), weight)]


class Distribution(Objective):
    """Outputs are the margins of a distribution's parameters, by negative log-likelihood.

    Gradients of gamma, negative binomial and Student's distribution need digamma functions: an
    Arrow function on a batch of margins gives them.
    """

    costly = True

    @property
    def family(self) -> str:
        return self.name.partition(":")[2]

    @property
    def outputs(self):
        from .distributions import PARAMETERS

        return len(PARAMETERS[self.family])

    def prepare(self, df, margins, label, weight):
        family = self.family

        @F.pandas_udf("array<double>")
        def both(y, *m):
            import numpy as np
            import pandas as pd

            from sparkboost.functions.distributions import Dist

            got = Dist.of_margins(family, [x.to_numpy() for x in m]).gradients(y.to_numpy())
            return pd.Series(list(np.stack([np.broadcast_to(x, len(y)) for pair in got for x in pair], axis=1)))

        return df.withColumn("__pairs", both(F.col(label).cast("double"), *margins))

    def pairs(self, margins, label, weight):
        return [(weight * F.col("__pairs")[2 * k], weight * F.col("__pairs")[2 * k + 1]) for k in range(self.outputs)]

    def transform(self, margins):
        e = [F.exp(F.greatest(F.least(m, F.lit(30.0)), F.lit(-30.0))) for m in margins]
        if self.family != "student_t":
            return e
        df = 1 + e[2]
        return [margins[0], e[1] * df / (df + 1), df]

    def allowed(self, label):
        return {"gamma": label > 0, "negbinomial": (label >= 0) & (label == F.floor(label))}.get(self.family)

    def intercepts(self, df, label, weight):
        """From moments: a gamma's shape by its logarithm, a size by the variance, Student's df at 5."""
        y = F.col(label)
        logs = F.log(y) if self.family == "gamma" else F.lit(0.0)
        row = df.agg((F.sum(weight * y) / F.sum(weight)).alias("m"), (F.sum(weight * y * y) / F.sum(weight)).alias("q"), (F.sum(weight * logs) / F.sum(weight)).alias("l")).first()
        m = row["m"] or 0.0
        var = max((row["q"] or 0.0) - m * m, 1e-12)
        if self.family == "gamma":
            s = max(math.log(m) - row["l"], 1e-9)
            return [math.log(m), math.log((3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s))]
        if self.family == "negbinomial":
            m = max(m, 1e-9)
            return [math.log(m), math.log(min(max(m * m / max(var - m, 1e-9 * m), 1e-3), 1e6))]
        from ..operators.order import grid_quantiles

        low, middle, high = grid_quantiles(df, label, [0.25, 0.5, 0.75])
        spread = (high - low) * 0.7413 or math.sqrt(var)
        return [middle, math.log(spread * 6 / 5), math.log(4.0)]


class Custom(Objective):
    """An objective of the caller: ``options['pairs'](margins, label, weight)`` gives column pairs."""

    costly = True

    @property
    def outputs(self):
        return int(self.options.get("outputs", 1))

    def pairs(self, margins, label, weight):
        return self.options["pairs"](margins, label, weight)

    def transform(self, margins):
        f = self.options.get("transform")
        return f(margins) if f else list(margins)


class NormalDistribution(Objective):
    """Outputs (mean, log scale) by negative log-likelihood and Fisher information; ``lognormal`` on log labels."""

    @property
    def outputs(self):
        return 2

    def _z(self, label: Column) -> Column:
        return F.log(label) if self.name == "dist:lognormal" else label

    def pairs(self, margins, label, weight):
        mean, s = margins[0], F.greatest(F.least(margins[1], F.lit(30.0)), F.lit(-30.0))
        i = F.exp(-2 * s)
        r = mean - self._z(label)
        return [(weight * r * i, weight * i), (weight * (1 - r * r * i), weight * 2.0)]

    def transform(self, margins):
        return [margins[0], F.exp(F.greatest(F.least(margins[1], F.lit(30.0)), F.lit(-30.0)))]

    def allowed(self, label):
        return label > 0 if self.name == "dist:lognormal" else None

    def intercepts(self, df, label, weight):
        z = self._z(F.col(label))
        row = df.agg((F.sum(weight * z) / F.sum(weight)).alias("m"), (F.sum(weight * z * z) / F.sum(weight)).alias("q")).first()
        mean = row["m"] or 0.0
        return [mean, 0.5 * math.log(max((row["q"] or 0.0) - mean * mean, 1e-12))]


class PoissonDistribution(Poisson):
    def pairs(self, margins, label, weight):
        e = F.exp(F.greatest(F.least(margins[0], F.lit(30.0)), F.lit(-30.0)))
        return [(weight * (e - label), weight * e)]

    def intercepts(self, df, label, weight):
        return [math.log(max(SquaredError("", "").intercepts(df, label, weight)[0], 1e-12))]


class AcceleratedFailure(Objective):
    """Accelerated failure times between ``label_lower`` and ``label_upper`` (infinite: censored on the right).

    The margin is a log time.  Logistic and extreme errors are column expressions; normal ones
    need the error function, by an Arrow function.
    """

    costly = True

    @property
    def sigma(self) -> float:
        return float(self.options.get("aft_loss_distribution_scale", 1.0))

    def _functions(self):
        """Density, its derivative, its second derivative and the distribution function of an error."""
        kind = self.options.get("aft_loss_distribution", "normal")
        if kind == "logistic":
            s = sigmoid
            return lambda z: s(z) * (1 - s(z)), lambda z: s(z) * (1 - s(z)) * (1 - 2 * s(z)), lambda z: s(z) * (1 - s(z)) * (1 - 6 * s(z) + 6 * s(z) * s(z)), s
        if kind == "extreme":
            w = F.exp
            return lambda z: w(z) * F.exp(-w(z)), lambda z: (1 - w(z)) * w(z) * F.exp(-w(z)), lambda z: (1 - 3 * w(z) + w(z) * w(z)) * w(z) * F.exp(-w(z)), lambda z: 1 - F.exp(-w(z))
        if kind != "normal":
            raise InvalidParameter(f"unknown error distribution {kind!r}")
        density = lambda z: F.exp(-z * z / 2) / math.sqrt(2 * math.pi)

        def below(z: Column) -> Column:
            @F.pandas_udf("double")
            def cdf(x):
                import pandas as pd

                from sparkboost.functions.special import normal_cdf

                return pd.Series(normal_cdf(x.to_numpy()))

            return cdf(z)

        return density, lambda z: -z * density(z), lambda z: (z * z - 1) * density(z), below

    def pairs(self, margins, label, weight):
        f, f1, f2, below = self._functions()
        lo, hi, s = F.col("label_lower"), F.col("label_upper"), self.sigma
        finite = hi < float("inf")
        zl = F.greatest(F.least((F.log(F.greatest(lo, F.lit(1e-12))) - margins[0]) / s, F.lit(30.0)), F.lit(-30.0))
        zu = F.when(finite, F.greatest(F.least((F.log(F.when(finite, hi).otherwise(1.0)) - margins[0]) / s, F.lit(30.0)), F.lit(-30.0))).otherwise(30.0)
        exact = lo == hi
        d = F.greatest(f(zl), F.lit(1e-12))
        top, dtop = F.when(finite, f(zu)).otherwise(0.0), F.when(finite, f1(zu)).otherwise(0.0)
        bottom, dbottom = F.when(lo > 0, f(zl)).otherwise(0.0), F.when(lo > 0, f1(zl)).otherwise(0.0)
        mass = F.greatest(F.when(finite, below(zu)).otherwise(1.0) - F.when(lo > 0, below(zl)).otherwise(0.0), F.lit(1e-12))
        g = F.when(exact, f1(zl) / (s * d)).otherwise((top - bottom) / (s * mass))
        h = F.when(exact, -(f(zl) * f2(zl) - f1(zl) * f1(zl)) / (s * s * d * d)).otherwise(-(mass * (dtop - dbottom) - (top - bottom) * (top - bottom)) / (s * s * mass * mass))
        clip = lambda x, a, b: F.greatest(F.least(x, F.lit(b)), F.lit(a))
        return [(weight * clip(g, -15.0, 15.0), weight * clip(h, 1e-16, 15.0))]

    def transform(self, margins):
        return [F.exp(margins[0])]

    def link(self, base):
        return math.log(base)

    def intercepts(self, df, label, weight):
        return [math.log(0.5)]


CATALOG: dict[str, tuple[Callable[..., Objective], str]] = {
    "reg:squarederror": (SquaredError, "rmse"),
    "reg:squaredlogerror": (SquaredLogError, "rmsle"),
    "reg:pseudohubererror": (PseudoHuber, "mphe"),
    "reg:absoluteerror": (AbsoluteError, "mae"),
    "reg:quantileerror": (Quantile, "quantile"),
    "reg:expectileerror": (Expectile, "expectile"),
    "reg:exceedance": (Exceedance, "exceedance-logloss"),
    "reg:logistic": (Logistic, "rmse"),
    "binary:logistic": (Logistic, "logloss"),
    "binary:logitraw": (Logistic, "logloss"),
    "binary:hinge": (Hinge, "error"),
    "multi:softmax": (Softmax, "mlogloss"),
    "multi:softprob": (Softmax, "mlogloss"),
    "count:poisson": (Poisson, "poisson-nloglik"),
    "reg:gamma": (Gamma, "gamma-nloglik"),
    "reg:tweedie": (Tweedie, "tweedie-nloglik"),
    "rank:pairwise": (Ranking, "ndcg"),
    "rank:ndcg": (Ranking, "ndcg"),
    "rank:map": (Ranking, "map"),
    "rank:xendcg": (CrossEntropyNdcg, "ndcg"),
    "survival:cox": (Cox, "cox-nloglik"),
    "survival:aft": (AcceleratedFailure, "aft-nloglik"),
    "dist:normal": (NormalDistribution, "nll"),
    "dist:lognormal": (NormalDistribution, "nll"),
    "dist:poisson": (PoissonDistribution, "nll"),
    "dist:gamma": (Distribution, "nll"),
    "dist:negbinomial": (Distribution, "nll"),
    "dist:student_t": (Distribution, "nll"),
    "custom": (Custom, "rmse"),
}


def objective(name: str, **options) -> Objective:
    if name not in CATALOG:
        import difflib

        near = difflib.get_close_matches(name, CATALOG, 1)
        raise InvalidParameter(f"unknown objective {name!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
    kind, metric = CATALOG[name]
    targets = options.pop("targets", 1)
    one = kind(name, options.get("metric", metric) if name == "custom" else metric, options)
    if targets > 1 and (one.outputs > 1 or not isinstance(one, (SquaredError, SquaredLogError, PseudoHuber, AbsoluteError, Logistic, Poisson))):
        raise InvalidParameter(f"{name} takes one label")
    return MultiTarget(one, targets) if targets > 1 else one
