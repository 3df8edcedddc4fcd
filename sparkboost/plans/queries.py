"""Queries of the boosting operators on the star-schema tables, with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.losses import objective
from ..functions.metrics import evaluate
from ..functions.rng import uniform_sql
from ..model import Router, Tree
from ..operators import binning, conformal, folds, histogram, sampling, split, target_stats
from ..operators.order import grid_quantiles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# lineitem as training rows: a margin m, labels of several kinds, a weight, three features of which one has gaps

LINES = """SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity AS q, l_tax AS tax,
  CASE WHEN l_linenumber = 1 THEN NULL ELSE l_discount END AS disc, l_extendedprice AS ep,
  (l_discount - 0.05) * 20 + l_tax * 10 - 0.4 AS m, l_quantity / 10.0 AS y, 1 + l_tax * 10 AS w,
  CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y01,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS cls FROM lineitem"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "lineitem")
    return d.select(
        "l_orderkey", "l_linenumber", "l_suppkey", F.col("l_quantity").alias("q"), F.col("l_tax").alias("tax"),
        F.when(F.col("l_linenumber") != 1, F.col("l_discount")).alias("disc"), F.col("l_extendedprice").alias("ep"),
        ((F.col("l_discount") - 0.05) * 20 + F.col("l_tax") * 10 - 0.4).alias("m"), (F.col("l_quantity") / 10.0).alias("y"), (1 + F.col("l_tax") * 10).alias("w"),
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y01"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("cls"),
    )


# gradients

S = "(1 / (1 + exp(-m)))"
SOFT = "exp(m0) + exp(m1) + exp(m2)"
GRADIENTS: dict[str, tuple[str, dict, str, list[str], list[tuple[str, str]]]] = {
    # name: objective, options, label, margins, SQL of the pairs over (LINES)
    "squarederror": ("reg:squarederror", {"scale_pos_weight": 2.0}, "y01", ["m"], [("w * (CASE WHEN y01 = 1 THEN 2 ELSE 1 END) * (m - y01)", "w * (CASE WHEN y01 = 1 THEN 2 ELSE 1 END)")]),
    "squaredlogerror": ("reg:squaredlogerror", {}, "y", ["m1"], [("w * (ln(1 + m1) - ln(1 + y)) / (m1 + 1)", "w * greatest((1 - ln(1 + m1) + ln(1 + y)) / ((m1 + 1) * (m1 + 1)), 1e-6)")]),
    "pseudohuber": ("reg:pseudohubererror", {"huber_slope": 1.5}, "y", ["m"], [("w * (m - y) / sqrt(1 + (m - y) * (m - y) / 2.25)", "w * 2.25 / ((2.25 + (m - y) * (m - y)) * sqrt(1 + (m - y) * (m - y) / 2.25))")]),
    "logistic": ("binary:logistic", {"scale_pos_weight": 3.0}, "y01", ["m"], [(f"w * (CASE WHEN y01 = 1 THEN 3 ELSE 1 END) * ({S} - y01)", f"w * (CASE WHEN y01 = 1 THEN 3 ELSE 1 END) * greatest({S} * (1 - {S}), 1e-16)")]),
    "hinge": ("binary:hinge", {}, "y01", ["m"], [("CASE WHEN m * (2 * y01 - 1) < 1 THEN -(2 * y01 - 1) * w ELSE 0 END", "CASE WHEN m * (2 * y01 - 1) < 1 THEN w ELSE 0 END")]),
    "poisson": ("count:poisson", {}, "y", ["m"], [("w * (exp(m) - y)", "w * exp(m + 0.7)")]),
    "gamma": ("reg:gamma", {}, "y", ["m"], [("w * (1 - y / exp(m))", "w * y / exp(m)")]),
    "tweedie": ("reg:tweedie", {"tweedie_variance_power": 1.3}, "y", ["m"], [("w * (exp(0.7 * m) - y * exp(-0.3 * m))", "w * (0.7 * exp(0.7 * m) + 0.3 * y * exp(-0.3 * m))")]),
    "softmax": ("multi:softprob", {"num_class": 3}, "cls", ["m0", "m1", "m2"], [(f"w * (exp(m{k}) / ({SOFT}) - CASE WHEN cls = {k} THEN 1 ELSE 0 END)", f"greatest(2 * exp(m{k}) / ({SOFT}) * (1 - exp(m{k}) / ({SOFT})) * w, 1e-16)") for k in range(3)]),
    "exceedance": ("reg:exceedance", {"thresholds": [1.0, 3.0]}, "y", ["m0", "m1"], [(f"w * (1 / (1 + exp(-m{k})) - CASE WHEN y >= {t} THEN 1 ELSE 0 END)", f"w * greatest(1 / (1 + exp(-m{k})) * (1 - 1 / (1 + exp(-m{k}))), 1e-16)") for k, t in enumerate((1.0, 3.0))]),
    "normal": ("dist:normal", {}, "y", ["m0", "m1"], [("w * (m0 - y) * exp(-2 * m1)", "w * exp(-2 * m1)"), ("w * (1 - (m0 - y) * (m0 - y) * exp(-2 * m1))", "w * 2")]),
    "absoluteerror": ("reg:absoluteerror", {}, "y", ["m"], [("w * (m - y) * s / sqrt(s * s + (m - y) * (m - y))", "w * s / sqrt(s * s + (m - y) * (m - y))")]),
    "quantile": ("reg:quantileerror", {"quantile_alpha": [0.3]}, "y", ["m"], [("w * 0.5 * s * (tanh((m - y) / (0.04 * s)) + 1 - 0.6)", "w * 12.5 * greatest(CASE WHEN m = y THEN 1 ELSE tanh((m - y) / (0.04 * s)) / ((m - y) / (0.04 * s)) END, 3e-4)")]),
    "expectile": ("reg:expectileerror", {"expectile_alpha": [0.25, 0.75]}, "y", ["m0", "m1"], [("w * a0 * d0 + w * a1 * d1", "w * a0 + w * a1"), ("sg * (w * a1 * d1)", "sg * sg * (w * a1)")]),
}
_MORE = """m AS m0, tax * 10 AS m1, 0.3 - m AS m2,
  pow(sum(w * sqrt(abs(m - y))) OVER () / sum(w) OVER (), 2) AS s"""
_EXPECT = """*, d0v AS d0, d1v AS d1, CASE WHEN d0v >= 0 THEN 0.75 ELSE 0.25 END AS a0, CASE WHEN d1v >= 0 THEN 0.25 ELSE 0.75 END AS a1, 1 / (1 + exp(-m1)) AS sg
  FROM (SELECT *, m0 - y AS d0v, m0 + 1e-6 + ln(1 + exp(m1)) - y AS d1v FROM (SELECT *, {more} FROM ({lines})))"""


def _gradient(name: str) -> None:
    kind, options, label, margins, pairs = GRADIENTS[name]
    columns = ", ".join(f"round({g}, 6) + 0 AS g{k}, round({h}, 6) + 0 AS h{k}" for k, (g, h) in enumerate(pairs))
    sql = f"SELECT l_orderkey, l_linenumber, {columns} FROM (SELECT {_EXPECT.format(more=_MORE, lines=LINES)})"

    @query(f"grad_{name}", sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        loss = objective(kind, **options)
        rows = lines(spark, sf_dir).withColumns({"m0": F.col("m"), "m1": F.col("tax") * 10, "m2": 0.3 - F.col("m")})
        rows = loss.prepare(rows, margins, label, F.col("w"))
        out = loss.pairs([F.col(m) for m in margins], F.col(label), F.col("w"))
        return rows.select("l_orderkey", "l_linenumber", *(x for k, (g, h) in enumerate(out) for x in ((F.round(g, 6) + 0.0).alias(f"g{k}"), (F.round(h, 6) + 0.0).alias(f"h{k}"))))


for _name in GRADIENTS:
    _gradient(_name)

_COX = "SELECT event_id, value / 20 AS m, CASE WHEN event_type = 'error' THEN -(1 + event_id % 97) ELSE 1 + event_id % 97 END AS y FROM events"


@query(
    "grad_cox",
    f"""WITH r AS ({_COX}), t AS (SELECT abs(y) AS t, sum(exp(m)) AS e FROM r GROUP BY 1),
  u AS (SELECT t, sum(e) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s FROM t),
  v AS (SELECT event_id, m, CASE WHEN y > 0 THEN 1 ELSE 0 END AS d, sum(CASE WHEN y > 0 THEN 1 / s ELSE 0 END) OVER o AS a, sum(CASE WHEN y > 0 THEN 1 / (s * s) ELSE 0 END) OVER o AS b FROM r JOIN u ON abs(y) = t WINDOW o AS (ORDER BY t, event_id ROWS UNBOUNDED PRECEDING))
  SELECT event_id, round(exp(m) * a - d, 6) AS g, round(exp(m) * a - exp(m) * exp(m) * b, 6) AS h FROM v""",
)
def grad_cox(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss = objective("survival:cox")
    time = 1 + F.col("event_id") % 97
    rows = _table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("row_id"), (F.col("value") / 20).alias("m"), F.when(F.col("event_type") == "error", -time).otherwise(time).cast("double").alias("y"))
    rows = loss.prepare(rows, ["m"], "y", F.lit(1.0))
    g, h = loss.pairs([F.col("m")], F.col("y"), F.lit(1.0))[0]
    return rows.select("event_id", F.round(g, 6).alias("g"), F.round(h, 6).alias("h"))


# metrics

P = "(1 / (1 + exp(-m)))"


def _mean(term: str) -> str:
    return f"SELECT round(sum(w * ({term})) / sum(w), 6) AS value FROM ({LINES})"


METRICS: dict[str, tuple[list[str], str, dict, str]] = {
    "rmse": (["pr"], "y", {}, f"SELECT round(sqrt(sum(w * (y - ep / 20000) * (y - ep / 20000)) / sum(w)), 6) AS value FROM ({LINES})"),
    "rmsle": (["pr"], "y", {}, f"SELECT round(sqrt(sum(w * pow(ln(1 + y) - ln(1 + ep / 20000), 2)) / sum(w)), 6) AS value FROM ({LINES})"),
    "mae": (["pr"], "y", {}, _mean("abs(y - ep / 20000)")),
    "mape": (["pr"], "y", {}, _mean("abs((y - ep / 20000) / y)")),
    "mphe": (["pr"], "y", {"huber_slope": 1.5}, _mean("2.25 * (sqrt(1 + (y - ep / 20000) * (y - ep / 20000) / 2.25) - 1)")),
    "logloss": (["p"], "y01", {}, _mean(f"-(y01 * ln({P}) + (1 - y01) * ln(1 - {P}))")),
    "error": (["p"], "y01", {}, _mean(f"CASE WHEN ({P} > 0.5) = (y01 > 0.5) THEN 0.0 ELSE 1.0 END")),
    "poisson-nloglik": (["pr"], "y", {}, _mean("ep / 20000 - y * ln(ep / 20000)")),
    "gamma-nloglik": (["pr"], "y", {}, _mean("y / (ep / 20000) + ln(ep / 20000)")),
    "tweedie-nloglik@1.3": (["pr"], "y", {}, _mean("-y * pow(ep / 20000, -0.3) / -0.3 + pow(ep / 20000, 0.7) / 0.7")),
    "mlogloss": (["c0", "c1", "c2"], "cls", {}, _mean("-ln(CASE cls WHEN 0 THEN 0.2 WHEN 1 THEN 0.3 + tax ELSE 0.5 - tax END)")),
    "merror": (["c0", "c1", "c2"], "cls", {}, _mean("CASE WHEN (CASE WHEN 0.3 + tax >= 0.5 - tax THEN 1 ELSE 2 END) = cls THEN 0.0 ELSE 1.0 END")),
    "quantile": (["pr", "p"], "y", {"quantile_alpha": [0.2, 0.8]}, _mean(f"((CASE WHEN y >= ep / 20000 THEN 0.2 * (y - ep / 20000) ELSE 0.8 * (ep / 20000 - y) END) + (CASE WHEN y >= {P} THEN 0.8 * (y - {P}) ELSE 0.2 * ({P} - y) END)) / 2")),
    "expectile": (["pr", "p"], "y", {"expectile_alpha": [0.2, 0.8]}, _mean(f"((CASE WHEN ep / 20000 >= y THEN 0.8 ELSE 0.2 END) * pow(ep / 20000 - y, 2) + (CASE WHEN {P} >= y THEN 0.2 ELSE 0.8 END) * pow({P} - y, 2)) / 2")),
    "exceedance-logloss": (["p", "c1"], "y", {"thresholds": [1.0, 3.0]}, _mean(f"(-(CASE WHEN y >= 1 THEN ln({P}) ELSE ln(1 - {P}) END) - (CASE WHEN y >= 3 THEN ln(0.3 + tax) ELSE ln(1 - (0.3 + tax)) END)) / 2")),
    "exceedance-brier": (["p", "c1"], "y", {"thresholds": [1.0, 3.0]}, _mean(f"1.0 * pow({P} - CASE WHEN y >= 1 THEN 1 ELSE 0 END, 2) + 1.0 * pow(0.3 + tax - CASE WHEN y >= 3 THEN 1 ELSE 0 END, 2)")),
    "auc": (["ep"], "y01", {}, f"WITH b AS (SELECT ep AS s, sum(y01) AS p, sum(1 - y01) AS n FROM ({LINES}) GROUP BY 1), r AS (SELECT p, n, coalesce(sum(p) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p0 FROM b) SELECT round(sum(n * (p0 + p / 2)) / (sum(p) * sum(n)), 6) AS value FROM r"),
    "aucpr": (["ep"], "y01", {}, f"WITH b AS (SELECT ep AS s, sum(w * y01) AS p, sum(w * (1 - y01)) AS n FROM ({LINES}) GROUP BY 1), r AS (SELECT p, sum(p) OVER o AS p1, sum(n) OVER o AS n1, coalesce(sum(p) OVER b, 0) AS p0, coalesce(sum(n) OVER b, 0) AS n0 FROM b WINDOW o AS (ORDER BY s DESC), b AS (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT round(sum(p * (p1 / (p1 + n1) + CASE WHEN p0 + n0 > 0 THEN p0 / (p0 + n0) ELSE p1 / (p1 + n1) END) / 2) / sum(p), 6) AS value FROM r"),
    "nll": (["pr", "w"], "y", {}, _mean("0.5 * ln(2 * pi()) + ln(w) + pow(y - ep / 20000, 2) / (2 * w * w)")),
}


def _metric(name: str) -> None:
    preds, label, options, sql = METRICS[name]

    @query("metric_" + name.partition("@")[0].replace("-", "_"), sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = lines(spark, sf_dir).withColumns({"p": 1 / (1 + F.exp(-F.col("m"))), "pr": F.col("ep") / 20000, "c0": F.lit(0.2), "c1": 0.3 + F.col("tax"), "c2": 0.5 - F.col("tax")})
        return evaluate(name, rows, preds, label, weight=F.col("w"), **options).select(F.round("value", 6).alias("value"))


for _name in METRICS:
    _metric(_name)

_EVENTS = "SELECT event_id AS row, user_id AS q, value AS p, CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS y, 1 + user_id % 3 AS w FROM events"
_RANKED = f"WITH e AS ({_EVENTS}), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY p DESC, row) - 1 AS r, row_number() OVER (PARTITION BY q ORDER BY y DESC, row) - 1 AS i FROM e)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "events")
    return d.select(F.col("event_id").alias("row_id"), "user_id", "value", "ts", "event_type", F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1).otherwise(0).alias("y"), (1 + F.col("user_id") % 3).cast("double").alias("w"))


@query("metric_ndcg", _RANKED + ", g AS (SELECT q, min(w) AS w, sum(CASE WHEN r < 5 THEN (pow(2, y) - 1) / log2(r + 2) ELSE 0 END) AS d, sum(CASE WHEN i < 5 THEN (pow(2, y) - 1) / log2(i + 2) ELSE 0 END) AS b FROM r GROUP BY q) SELECT round(sum(w * CASE WHEN b > 0 THEN d / b ELSE 0 END) / sum(w), 6) AS value FROM g")
def metric_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate("ndcg@5", _events(spark, sf_dir), ["value"], "y", weight=F.col("w"), qid="user_id").select(F.round("value", 6).alias("value"))


@query("metric_map", _RANKED + ", h AS (SELECT *, sum(CASE WHEN y > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY q ORDER BY r) AS hits FROM r), g AS (SELECT q, min(w) AS w, sum(CASE WHEN r < 10 AND y > 0 THEN hits / (r + 1) ELSE 0 END) AS a, sum(CASE WHEN y > 0 THEN 1 ELSE 0 END) AS n FROM h GROUP BY q) SELECT round(sum(w * CASE WHEN n > 0 THEN a / n ELSE 0 END) / sum(w), 6) AS value FROM g")
def metric_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate("map@10", _events(spark, sf_dir), ["value"], "y", weight=F.col("w"), qid="user_id").select(F.round("value", 6).alias("value"))


@query("metric_pre", _RANKED + ", g AS (SELECT q, min(w) AS w, sum(CASE WHEN r < 4 AND y > 0 THEN 1.0 ELSE 0.0 END) / least(count(*), 4) AS s FROM r GROUP BY q) SELECT round(sum(w * s) / sum(w), 6) AS value FROM g")
def metric_pre(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("y", F.when(F.col("y") > 0, 1).otherwise(0))
    return evaluate("pre@4", rows, ["value"], "y", weight=F.col("w"), qid="user_id").select(F.round("value", 6).alias("value"))


@query("metric_cox_nloglik", f"WITH r AS ({_COX}), t AS (SELECT abs(y) AS t, sum(exp(m)) AS e, sum(CASE WHEN y > 0 THEN 1 ELSE 0 END) AS d, sum(CASE WHEN y > 0 THEN m ELSE 0 END) AS l FROM r GROUP BY 1), u AS (SELECT *, sum(e) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s FROM t) SELECT round(sum(d * ln(s) - l) / sum(d), 6) AS value FROM u")
def metric_cox(spark: SparkSession, sf_dir: str) -> DataFrame:
    time = 1 + F.col("event_id") % 97
    rows = _table(spark, sf_dir, "events").select(F.exp(F.col("value") / 20).alias("p"), F.when(F.col("event_type") == "error", -time).otherwise(time).cast("double").alias("y"))
    return evaluate("cox-nloglik", rows, ["p"], "y").select(F.round("value", 6).alias("value"))


@query("metric_interval_regression_accuracy", "SELECT round(avg(CASE WHEN o_totalprice >= 50000 AND o_totalprice <= 50000 + o_custkey * 300 THEN 1.0 ELSE 0.0 END), 6) AS value FROM orders")
def metric_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select("o_totalprice", F.lit(50000.0).alias("label_lower"), (50000 + F.col("o_custkey") * 300).alias("label_upper"))
    return evaluate("interval-regression-accuracy", rows, ["o_totalprice"], "label_lower").select(F.round("value", 6).alias("value"))


# binning and histograms: a bin is the rank of a value among the feature's distinct ones

FEATURES = ["q", "disc", "tax"]
BINNED = f"""SELECT *, dense_rank() OVER (ORDER BY q) - 1 AS b0, CASE WHEN disc IS NOT NULL THEN dense_rank() OVER (ORDER BY disc NULLS LAST) - 1 END AS b1,
  dense_rank() OVER (ORDER BY tax) - 1 AS b2, m - y AS g FROM ({LINES})"""
CELLS = f"""SELECT node, feature, coalesce(b, -1) AS bin, g, w AS h FROM (SELECT CASE WHEN tax > 0.04 THEN 2 ELSE 1 END AS node, unnest([0, 1, 2]) AS feature, unnest([b0, b1, b2]) AS b, w * g AS g, w FROM ({BINNED}))"""
HIST = f"SELECT node, feature, bin, sum(g) AS g, sum(h) AS h, count(*) AS n FROM ({CELLS}) GROUP BY 1, 2, 3"


def _binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    return binning.binned(rows.withColumn("g", F.col("w") * (F.col("m") - F.col("y"))), binning.make_cuts(rows, FEATURES), ["l_orderkey", "l_linenumber", "tax", "g", "w"])


def _packed(spark: SparkSession, sf_dir: str, group: str | None = None):
    """Packed training rows with one pair of gradients, their cuts, and a tree that parts them at tax 0.04 into nodes 1 and 2."""
    rows = lines(spark, sf_dir).withColumns({"g0": F.col("w") * (F.col("m") - F.col("y")), "h0": F.col("w")})
    cuts = binning.make_cuts(rows, FEATURES)
    tree = Tree()
    bin_ = int(cuts.bins_of(2, np.array([0.04], dtype=np.float32))[0])
    tree.split(0, 2, bin_, float(cuts.values[2][bin_]), False, None, 0.0)
    if group:
        rows = rows.withColumn("grp", F.col(group).cast("long"))
    own = ["g0", "h0", *(["grp"] if group else [])]
    return binning.packed(rows, cuts, own).select("codes", *own), cuts, tree


SHIFT = (30, 30)


def _level(spark: SparkSession, sf_dir: str, reg: split.Regularisation | None = None, *, nodes=(1, 2), features=(0, 1, 2), categorical=(), allowed=None, keys=False, used=None, group=None, **options):
    """Whole sums and best splits of nodes, and their chunks of features."""
    rows, cuts, tree = _packed(spark, sf_dir, group)
    parts = split.chunks(features, cuts.sizes, [f in categorical for f in range(3)], histogram.CHUNK_CELLS)
    router = Router(tree if 0 not in nodes else Tree(), cuts)
    task = histogram.Task(0, router, list(nodes), [0], {n: 0 if options.get("symmetric") else -1 for n in nodes}, search=list(nodes))
    sums = histogram.partial_sums(rows, [task], parts, 3, cuts.code, SHIFT)
    if group:
        sums = sums.unionByName(histogram.group_counts(rows, [task], parts, 3, cuts.code))
    known = {(0, n): split.Node(np.array([-np.inf]), np.array([np.inf]), allowed=(allowed or {}).get(n), key=(n,) if keys else ()) for n in nodes}
    if used is not None:
        options |= {"used": ({used[0]}, {(used[0], float(cuts.values[used[0]][used[1]]))}), "cuts": cuts.values}
    return histogram.searched(sums, [task], parts, reg or split.Regularisation(), SHIFT, known, **options), parts


def _hist(spark: SparkSession, sf_dir: str, nodes=(1, 2)) -> DataFrame:
    return histogram.cells(*_level(spark, sf_dir, nodes=nodes), SHIFT)


_SHOW = "round(g, 4) + 0 AS g, round(h, 4) + 0 AS h, n"


def _shown(hist: DataFrame) -> DataFrame:
    return hist.select("node", "feature", "bin", (F.round("g", 4) + 0.0).alias("g"), (F.round("h", 4) + 0.0).alias("h"), "n")


@query("cuts_distinct", f"SELECT feature, row_number() OVER (PARTITION BY feature ORDER BY v) - 1 AS bin, round(v, 4) AS cut FROM (SELECT DISTINCT unnest([0, 1, 2]) AS feature, unnest([q, disc, tax]) AS v FROM ({LINES})) WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY feature ORDER BY v) > 0")
def cuts_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = binning.distinct_values(lines(spark, sf_dir), FEATURES)
    place = F.row_number().over(Window.partitionBy("feature").orderBy("value")) - 1
    return values.select("feature", place.cast("long").alias("bin"), F.round(F.col("value").cast("double"), 4).alias("cut"))


_CUTS = """WITH d AS (SELECT l_extendedprice::FLOAT AS v, sum({w}) AS w FROM lineitem GROUP BY 1), r AS (SELECT v, sum(w) OVER (ORDER BY v) AS run, sum(w) OVER () AS total, min(v) OVER () AS low FROM d),
  c AS (SELECT DISTINCT min(v) AS v FROM r JOIN (SELECT unnest(range(1, 16)) AS i) ON run >= total * i / 16 WHERE true GROUP BY i)
  SELECT round(v::DOUBLE, 2) AS cut FROM c WHERE v > (SELECT min(low) FROM r)"""


def _quantile_cuts(spark: SparkSession, sf_dir: str, weight) -> DataFrame:
    """Cuts of a feature with far more distinct values than bins, by summaries that hold all of them."""
    rows = _table(spark, sf_dir, "lineitem")
    (values, weights), = binning.summaries(rows, ["l_extendedprice"], weight, size=1 << 17)
    cuts = binning.cuts_of(values, weights, 16)[:-1]
    return spark.createDataFrame([(round(float(c), 2),) for c in cuts], "cut double")


@query("cuts_quantile", _CUTS.format(w="1"))
def cuts_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quantile_cuts(spark, sf_dir, None)


@query("cuts_weighted", _CUTS.format(w="l_linenumber"))
def cuts_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quantile_cuts(spark, sf_dir, F.col("l_linenumber"))


@query("bin_values", f"SELECT l_orderkey, l_linenumber, b0, b1, b2 FROM ({BINNED})")
def bin_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _binned(spark, sf_dir).select("l_orderkey", "l_linenumber", *(F.col("bins")[k].cast("long").alias(f"b{k}") for k in range(3)))


@query("hist_nodes", f"SELECT node, feature, bin, {_SHOW} FROM ({HIST})")
def hist_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_hist(spark, sf_dir)).withColumns({"feature": F.col("feature").cast("long"), "bin": F.col("bin").cast("long")})


@query("hist_root", f"SELECT 0 AS node, feature, bin, {_SHOW} FROM (SELECT feature, bin, sum(g) AS g, sum(h) AS h, sum(n)::BIGINT AS n FROM ({HIST}) GROUP BY 1, 2)")
def hist_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_hist(spark, sf_dir, (0,))).withColumns({"feature": F.col("feature").cast("long"), "bin": F.col("bin").cast("long")})


@query("hist_subtract", f"SELECT 2 AS node, feature, bin, {_SHOW} FROM ({HIST}) WHERE node = 2")
def hist_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node 2 as the root less node 1, as a level of training has it."""
    rows, cuts, tree = _packed(spark, sf_dir)
    root, parts = _level(spark, sf_dir, nodes=(0,))
    task = histogram.Task(0, Router(tree, cuts), [1], [0], {1: 0, 2: 0}, {0: (1, 2)})
    sums = histogram.partial_sums(rows, [task], parts, 3, cuts.code, SHIFT).unionByName(histogram.parent_sums(root, {0: [0]}))
    known = {(0, n): split.Node(np.array([-np.inf]), np.array([np.inf])) for n in (1, 2)}
    whole = histogram.searched(sums, [task], parts, split.Regularisation(), SHIFT, known)
    return _shown(histogram.cells(whole.where("node = 2"), parts, SHIFT)).withColumns({"feature": F.col("feature").cast("long"), "bin": F.col("bin").cast("long")})


# split search

_SCAN = """WITH h AS ({hist}), t AS (SELECT *, sum(g) OVER p AS tg, sum(h) OVER p AS th, sum(n) OVER p AS tn,
  sum(CASE WHEN bin < 0 THEN g ELSE 0 END) OVER p AS mg, sum(CASE WHEN bin < 0 THEN h ELSE 0 END) OVER p AS mh, sum(CASE WHEN bin < 0 THEN n ELSE 0 END) OVER p AS mn FROM h WINDOW p AS (PARTITION BY node, feature)),
  s AS (SELECT *, sum(g) OVER o AS pg, sum(h) OVER o AS ph, sum(n) OVER o AS pn FROM t WHERE bin >= 0 WINDOW o AS (PARTITION BY node, feature ORDER BY bin)),
  c AS (SELECT node, feature, bin, false AS default_left, tg, th, tn, pg AS gl, ph AS hl, pn AS nl FROM s UNION ALL SELECT node, feature, bin, true, tg, th, tn, pg + mg, ph + mh, pn + mn FROM s WHERE mn > 0),
  x AS (SELECT *, gl * gl / (hl + {l}) + (tg - gl) * (tg - gl) / (th - hl + {l}) - tg * tg / (th + {l}) AS loss, -gl / (hl + {l}) AS wl, -(tg - gl) / (th - hl + {l}) AS wr FROM c WHERE hl >= {m} AND th - hl >= {m} AND nl > 0 AND tn - nl > 0)"""


def _split_sql(where: str = "true", l: float = 1.0, m: float = 1.0) -> str:  # noqa: E741
    best = "row_number() OVER (PARTITION BY node ORDER BY loss DESC, feature, default_left, CASE WHEN default_left THEN -bin ELSE bin END) = 1"
    return _SCAN.format(hist=HIST, l=l, m=m) + f" SELECT node, feature, bin, default_left, round(loss, 1) AS loss, round(gl, 3) AS gl, round(hl, 3) AS hl, nl::BIGINT AS nl FROM x WHERE {where} QUALIFY {best}"


def _best(spark: SparkSession, sf_dir: str, reg: split.Regularisation, **options) -> DataFrame:
    rows = _level(spark, sf_dir, reg, **options)[0].where("feature is not null")
    return rows.select("node", F.col("feature").cast("long").alias("feature"), F.col("bin").cast("long").alias("bin"), "default_left", F.round(F.col("loss").cast("double"), 1).alias("loss"), F.round(F.col("gl")[0], 3).alias("gl"), F.round(F.col("hl")[0], 3).alias("hl"), "nl")


@query("split_best_numeric", _split_sql())
def split_best_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir, split.Regularisation())


@query("split_missing_direction", _split_sql("feature = 1"))
def split_missing_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir, split.Regularisation(), features=(1,))


@query("split_monotone", _split_sql("(feature <> 0 OR wl <= wr) AND (feature <> 1 OR wl >= wr)", 5.0, 20.0))
def split_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir, split.Regularisation(lambda_=5.0, min_child_weight=20.0, monotone={0: 1, 1: -1}))


@query("split_interaction", _split_sql("(node = 1 AND feature IN (0, 2)) OR (node = 2 AND feature = 1)"))
def split_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir, split.Regularisation(), allowed={1: frozenset({0, 2}), 2: frozenset({1})})


@query("split_symmetric", _SCAN.format(hist=HIST, l=1.0, m=1.0) + ", z AS (SELECT feature, bin, default_left, sum(loss) AS score FROM x WHERE loss > 1e-6 GROUP BY 1, 2, 3 QUALIFY row_number() OVER (ORDER BY sum(loss) DESC, feature, default_left) = 1) SELECT x.node, x.feature, x.bin, x.default_left, round(loss, 1) AS loss, round(gl, 3) AS gl FROM x JOIN z USING (feature, bin, default_left)")
def split_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir, split.Regularisation(), symmetric=True).select("node", "feature", "bin", "default_left", "loss", "gl")


@query("split_categorical_partition", f"""WITH h AS (SELECT * FROM ({HIST}) WHERE feature = 2), t AS (SELECT *, sum(g) OVER p AS tg, sum(h) OVER p AS th, -g / (h + 1) AS place FROM h WINDOW p AS (PARTITION BY node)),
  s AS (SELECT *, sum(g) OVER o AS gl, sum(h) OVER o AS hl, row_number() OVER o AS k FROM t WINDOW o AS (PARTITION BY node ORDER BY place, bin)),
  x AS (SELECT *, gl * gl / (hl + 1) + (tg - gl) * (tg - gl) / (th - hl + 1) - tg * tg / (th + 1) AS loss FROM s WHERE hl >= 1 AND th - hl >= 1)
  SELECT node, k AS n_categories, round(loss, 1) AS loss, round(gl, 3) AS gl FROM x QUALIFY row_number() OVER (PARTITION BY node ORDER BY loss DESC, k) = 1""")
def split_categorical_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _level(spark, sf_dir, features=(2,), categorical=(2,))[0].where("feature is not null")
    return rows.select("node", F.size("categories").cast("long").alias("n_categories"), F.round(F.col("loss").cast("double"), 1).alias("loss"), F.round(F.col("gl")[0], 3).alias("gl"))


@query("leaf_values", f"SELECT node, round(-(CASE WHEN sum(g) > 2 THEN sum(g) - 2 WHEN sum(g) < -2 THEN sum(g) + 2 ELSE 0 END) / (sum(h) + 1), 6) AS leaf, round(sum(h), 3) AS cover FROM ({CELLS}) WHERE feature = 0 GROUP BY node")
def leaf_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _hist(spark, sf_dir).where("feature = 0").groupBy("node").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    return by.select("node", F.round(split.Regularisation(alpha=2.0).weight(F.col("g"), F.col("h")), 6).alias("leaf"), F.round("h", 3).alias("cover"))


# sampling

@query("sample_rows", f"SELECT o_orderkey FROM orders WHERE {uniform_sql('o_orderkey', 7, 2, 1)} < 0.3")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.bernoulli(_table(spark, sf_dir, "orders"), "o_orderkey", 0.3, 7, 2, 1).select("o_orderkey")


@query("sample_balanced", f"SELECT o_orderkey FROM orders WHERE {uniform_sql('o_orderkey', 5)} < CASE WHEN o_orderstatus = 'P' THEN 0.8 ELSE 0.1 END")
def sample_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").withColumn("y", F.when(F.col("o_orderstatus") == "P", 1).otherwise(0))
    return sampling.balanced(rows, "o_orderkey", "y", 0.8, 0.1, 5).select("o_orderkey")


@query("sample_query", f"SELECT o_orderkey FROM orders WHERE {uniform_sql('o_custkey', 3)} < 0.4")
def sample_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.whole_queries(_table(spark, sf_dir, "orders"), "o_custkey", 0.4, 3).select("o_orderkey")


@query("sample_mvs", """WITH r AS (SELECT o_totalprice AS r, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT r, n, sum(n * r) OVER (ORDER BY r) AS low, sum(n) OVER (ORDER BY r) AS below, sum(n) OVER () AS total FROM r)
  SELECT round(min_by(low / (0.4 * total - (total - below)), r), 2) AS threshold FROM c WHERE 0.4 * total > total - below AND low / (0.4 * total - (total - below)) >= r""")
def sample_mvs(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = sampling.gradient_threshold(_table(spark, sf_dir, "orders"), F.col("o_totalprice"), 0.4)
    return spark.createDataFrame([(round(u, 2),)], "threshold double")


# target statistics

_ORDER = uniform_sql("o_orderkey", 11)


@query("target_stats_ordered", f"""SELECT o_orderkey, round((coalesce(sum(y) OVER w, 0) + 1.0 * prior) / (count(y) OVER w + 1.0), 6) AS encoded FROM (SELECT *, CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END AS y, {_ORDER} AS u, avg(CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END) OVER () AS prior FROM orders)
  WINDOW w AS (PARTITION BY o_orderpriority ORDER BY u, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def target_stats_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").withColumn("y", F.when(F.col("o_orderstatus") == "P", 1.0).otherwise(0.0))
    out, _ = target_stats.fit_transform(rows, ["o_orderpriority"], "y", "o_orderkey", seed=11)
    return out.select("o_orderkey", F.round("o_orderpriority", 6).alias("encoded"))


@query("target_stats_apply", """WITH f AS (SELECT o_orderpriority AS c, sum(CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END) AS s, count(*) AS n FROM orders GROUP BY 1), p AS (SELECT sum(s) / sum(n) AS prior FROM f)
  SELECT o_orderkey, round(coalesce((s + prior) / (n + 1), prior), 6) AS encoded FROM orders CROSS JOIN p LEFT JOIN f ON o_orderpriority = c""")
def target_stats_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").withColumn("y", F.when(F.col("o_orderstatus") == "P", 1.0).otherwise(0.0))
    fitted = target_stats.fit(rows, ["o_orderpriority"], "y", binary=True)
    return fitted.transform(rows).select("o_orderkey", F.round("o_orderpriority", 6).alias("encoded"))


# folds

@query("fold_kfold", f"SELECT f AS fold, o_orderkey AS row_id, CASE WHEN place % 4 = f THEN 'test' ELSE 'train' END AS role FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {uniform_sql('o_orderkey', 9)}, o_orderkey) - 1 AS place FROM orders) CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS f)")
def fold_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.k_fold(_table(spark, sf_dir, "orders"), "o_orderkey", 4, 9)


@query("fold_forward", """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place, count(*) OVER () AS n FROM orders), x AS (SELECT f, o_orderkey, place, (f + 1) * (n // 4) AS a, CASE WHEN f = 2 THEN n ELSE (f + 2) * (n // 4) END AS z FROM r CROSS JOIN (SELECT unnest([0, 1, 2]) AS f))
  SELECT f AS fold, o_orderkey AS row_id, CASE WHEN place >= a THEN 'test' ELSE 'train' END AS role FROM x WHERE (place >= a AND place < z) OR place < a - 10""")
def fold_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.forward_chaining(_table(spark, sf_dir, "orders"), "o_orderkey", 3, 10)


_TIMES = "SELECT event_id, epoch_us(ts) // 3600000000 AS t, epoch_us(ts) // 3600000000 + event_id % 5 AS e FROM events"


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.floor(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 3600000000).cast("long")
    return _table(spark, sf_dir, "events").select("event_id", t.alias("t"), (t + F.col("event_id") % 5).alias("e"))


@query("fold_purged_forward", f"""WITH r AS ({_TIMES}), d AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT t FROM r)), s AS (SELECT k, n, t, f FROM d CROSS JOIN (SELECT unnest([0, 1, 2]) AS f) WHERE k = n - (n * 0.5)::BIGINT - CASE WHEN (n * 0.5)::BIGINT > n * 0.5 THEN -1 ELSE 0 END + (CASE WHEN (n * 0.5)::BIGINT > n * 0.5 THEN (n * 0.5)::BIGINT - 1 ELSE (n * 0.5)::BIGINT END) * f // 3),
  b AS (SELECT f, t AS lo, lead(t) OVER (ORDER BY f) AS hi FROM s)
  SELECT f AS fold, event_id AS row_id, CASE WHEN t >= lo THEN 'test' ELSE 'train' END AS role FROM r CROSS JOIN b WHERE (t >= lo AND (hi IS NULL OR t < hi)) OR (t < lo AND e <= lo)""")
def fold_purged_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.purged_forward(_times(spark, sf_dir), "event_id", "t", "e", 3, 0.5)


@query("fold_purged_at", f"SELECT f AS fold, event_id AS row_id, CASE WHEN t >= lo THEN 'test' ELSE 'train' END AS role FROM ({_TIMES}) CROSS JOIN (SELECT * FROM (VALUES (0, 473500, 473600), (1, 473600, NULL)) AS v(f, lo, hi)) WHERE (t >= lo AND (hi IS NULL OR t < hi)) OR (t < lo AND e <= lo)")
def fold_purged_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.purged_at(_times(spark, sf_dir), "event_id", "t", "e", [473500, 473600])


@query("purged_tail", f"WITH r AS ({_TIMES}), b AS (SELECT max(t) - floor((max(t) - min(t)) * 0.25)::BIGINT AS lo FROM r) SELECT 0 AS fold, event_id AS row_id, CASE WHEN t >= lo THEN 'test' ELSE 'train' END AS role FROM r CROSS JOIN b WHERE t >= lo OR e <= lo")
def purged_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.purged_tail(_times(spark, sf_dir), "event_id", "t", "e", 0.25, by="span")


# conformal

_RESIDUALS = "SELECT o_orderkey, o_totalprice AS y, 150000 + o_custkey * 10 AS p, 100000 + o_custkey AS lo, 250000 - o_custkey AS hi FROM orders"


def _residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey")
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("y"), (150000 + c * 10).cast("double").alias("p"), (100000 + c).cast("double").alias("lo"), (250000 - c).cast("double").alias("hi"))


def _conformal_sql(score: str, low: str, high: str) -> str:
    return f"""WITH r AS ({_RESIDUALS}), q AS (SELECT s FROM (SELECT {score} AS s, row_number() OVER (ORDER BY {score}) AS k, count(*) OVER () AS n FROM r) WHERE k = ceil((n + 1) * 0.9 - 1e-12) LIMIT 1)
  SELECT o_orderkey, round({low} - s, 4) AS lower, round({high} + s, 4) AS upper FROM r CROSS JOIN q"""


@query("conformal_split", _conformal_sql("abs(y - p)", "p", "p"))
def conformal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _residuals(spark, sf_dir)
    return conformal.split_interval(rows, "y", "p", 0.1, rows).select("o_orderkey", F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"))


@query("conformal_cqr", _conformal_sql("greatest(lo - y, y - hi)", "lo", "hi"))
def conformal_cqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _residuals(spark, sf_dir)
    return conformal.quantile_interval(rows, "y", "lo", "hi", 0.1, rows).select("o_orderkey", F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"))


@query("label_quantiles", "WITH r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS k, count(*) OVER () AS n FROM orders), a AS (SELECT unnest([0.1, 0.5, 0.9]) AS a), x AS (SELECT a, v, k, a * (n + 1) AS x FROM r CROSS JOIN a) SELECT a AS alpha, round(max(CASE WHEN k = floor(x) THEN v END) + (max(x) - floor(max(x))) * (max(CASE WHEN k = floor(x) + 1 THEN v END) - max(CASE WHEN k = floor(x) THEN v END)), 4) AS quantile FROM x GROUP BY a")
def label_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    alphas = [0.1, 0.5, 0.9]
    got = grid_quantiles(_table(spark, sf_dir, "orders"), "o_totalprice", alphas)
    return spark.createDataFrame([(a, round(v, 4)) for a, v in zip(alphas, got, strict=True)], "alpha double, quantile double")
