"""Queries that train one small tree (or one round) whose result SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.losses import objective
from ..functions.metrics import evaluate
from ..functions.rng import draw, uniform_sql
from ..operators import split
from .queries import _SCAN, BINNED, CELLS, HIST, LINES, _level, lines
from .train import train

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
KEY = ["l_orderkey", "l_linenumber"]


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return keep


# a tree of one split on the quantity: every cut is tried, the first of the best ones is taken


def _stump(g: str, h: str, sums: str, gamma_l: float = 1.0, where: str = "true", tag: str = "") -> str:
    """CTEs x{tag} (rows with gradients), best{tag} (b, gl, hl, tg, th, loss); sums: aggregates that g and h may use."""
    return f"""s{tag} AS (SELECT {sums} FROM r WHERE {where}), x{tag} AS (SELECT r.*, {g} AS gg, {h} AS hh FROM r CROSS JOIN s{tag}),
  h{tag} AS (SELECT b0 AS b, sum(gg) AS g, sum(hh) AS h FROM x{tag} WHERE {where} GROUP BY 1),
  c{tag} AS (SELECT b, sum(g) OVER (ORDER BY b) AS gl, sum(h) OVER (ORDER BY b) AS hl, sum(g) OVER () AS tg, sum(h) OVER () AS th FROM h{tag}),
  best{tag} AS (SELECT *, gl * gl / (hl + {gamma_l}) + (tg - gl) * (tg - gl) / (th - hl + {gamma_l}) - tg * tg / (th + {gamma_l}) AS loss FROM c{tag} WHERE hl >= 1 AND th - hl >= 1 ORDER BY loss DESC, b LIMIT 1)"""


_LEAF = "CASE WHEN b0 <= b THEN -gl / (hl + 1) ELSE -(tg - gl) / (th - hl + 1) END"
_SQUARED = f"WITH r AS ({BINNED}), " + _stump("base - y", "1.0", "avg(y) AS base")


def _tree(spark: SparkSession, sf_dir: str, label: str = "y", **params):
    rows = lines(spark, sf_dir)
    return rows, train({"max_depth": 1, "max_bin": 256, "eta": 0.5, **params}, rows, ["q"], label, 1)


def _rounded(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*KEY, *((F.round(c, 4) + 0.0).alias(c) for c in columns))


for _name, _params in {
    "lossguide": {"grow_policy": "lossguide", "max_depth": 0, "max_leaves": 2},
    "symmetric": {"grow_policy": "symmetric"},
    "forest": {"num_parallel_tree": 3},
    "ebm": {"booster": "ebm"},
    "dart": {"booster": "dart", "rate_drop": 0.5},
    "approx": {"tree_method": "approx"},
    "exact": {"tree_method": "exact"},
}.items():

    @query(f"tree_{_name}", _SQUARED + f" SELECT l_orderkey, l_linenumber, round(base + 0.5 * ({_LEAF}), 4) + 0 AS prediction FROM r CROSS JOIN s CROSS JOIN best")
    def _same_stump(spark: SparkSession, sf_dir: str, params=_params) -> DataFrame:
        rows, model = _tree(spark, sf_dir, **params)
        return _rounded(model.predict(rows, KEY), "prediction")


@query("tree_binary", f"WITH r AS ({BINNED}), " + _stump("1 / (1 + exp(-base)) - y01", "1 / (1 + exp(-base)) * (1 - 1 / (1 + exp(-base)))", "ln(avg(y01) / (1 - avg(y01))) AS base") + f" SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(base + 0.5 * ({_LEAF})))), 4) AS prediction FROM r CROSS JOIN s CROSS JOIN best")
def tree_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = _tree(spark, sf_dir, "y01", objective="binary:logistic")
    return _rounded(model.predict(rows, KEY), "prediction")


@query(
    "tree_distribution",
    f"WITH r AS ({BINNED}), "
    + _stump("(base - y) * exp(-2 * ls)", "exp(-2 * ls)", "avg(y) AS base, 0.5 * ln(avg(y * y) - avg(y) * avg(y)) AS ls")
    + ", "
    + _stump("1 - (base - y) * (base - y) * exp(-2 * ls)", "2.0", "avg(y) AS base, 0.5 * ln(avg(y * y) - avg(y) * avg(y)) AS ls", tag="2")
    + f" SELECT l_orderkey, l_linenumber, round(s.base + 0.5 * ({_LEAF.replace('b0 <= b', 'b0 <= best.b').replace('gl', 'best.gl').replace('hl', 'best.hl').replace('tg', 'best.tg').replace('th ', 'best.th ')}), 4) AS prediction0, round(exp(s.ls + 0.5 * (CASE WHEN b0 <= best2.b THEN -best2.gl / (best2.hl + 1) ELSE -(best2.tg - best2.gl) / (best2.th - best2.hl + 1) END)), 4) AS prediction1 FROM r CROSS JOIN s CROSS JOIN best CROSS JOIN best2",
)
def tree_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = _tree(spark, sf_dir, objective="dist:normal")
    return _rounded(model.predict(rows, KEY), "prediction0", "prediction1")


@query("tree_shap", _SQUARED + f""", m AS (SELECT *, (hl * -gl / (hl + 1) + (th - hl) * -(tg - gl) / (th - hl + 1)) / th AS expected FROM best)
  SELECT l_orderkey, l_linenumber, round(0.5 * ({_LEAF} - expected), 4) + 0 AS phi0, round(base + 0.5 * expected, 4) AS bias FROM r CROSS JOIN s CROSS JOIN m""")
def tree_shap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = _tree(spark, sf_dir)
    out = model.contributions(rows, KEY).select(*KEY, F.col("contributions0")[0].alias("phi0"), F.col("contributions0")[1].alias("bias"))
    return _rounded(out, "phi0", "bias")


@query("tree_gain", _SQUARED + " SELECT round(loss, 0) AS gain, round(th, 0) AS cover, b + 1 AS n_bins_left FROM best")
def tree_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, model = _tree(spark, sf_dir)
    t = model.trees[0]
    return spark.createDataFrame([(round(t.gain[0], 0), round(t.cover[0], 0), t.bin[0] + 1)], "gain double, cover double, n_bins_left long")


_MEDIAN = """CASE WHEN n % 2 = 1 THEN max(CASE WHEN k = (n + 1) // 2 THEN v END) ELSE (max(CASE WHEN k = n // 2 THEN v END) + max(CASE WHEN k = n // 2 + 1 THEN v END)) / 2 END"""


@query("tree_exact_leaves", f"""WITH r AS ({BINNED}), o AS (SELECT ep / 1000 AS v, row_number() OVER (ORDER BY ep / 1000) AS k, count(*) OVER () AS n FROM r), b AS (SELECT {_MEDIAN} AS base FROM o GROUP BY n),
  z AS (SELECT r.*, base, ep / 1000 AS t, pow(sum(sqrt(abs(base - ep / 1000))) OVER () / count(*) OVER (), 2) AS sc FROM r CROSS JOIN b),
  x AS (SELECT *, 0.5 * sc * (exp((base - t) / (0.02 * sc)) - 1) / (exp((base - t) / (0.02 * sc)) + 1) AS gg, 12.5 * greatest(CASE WHEN base = t THEN 1 ELSE tanh((base - t) / (0.04 * sc)) / ((base - t) / (0.04 * sc)) END, 3e-4) AS hh FROM z),
  y AS (SELECT *, 0.5 * sc * tanh((base - t) / (0.04 * sc)) AS gt FROM x),
  h AS (SELECT b0 AS b, sum(gt) AS g, sum(hh) AS h FROM y GROUP BY 1), c AS (SELECT b, sum(g) OVER (ORDER BY b) AS gl, sum(h) OVER (ORDER BY b) AS hl, sum(g) OVER () AS tg, sum(h) OVER () AS th FROM h),
  best AS (SELECT b FROM c WHERE hl >= 1 AND th - hl >= 1 ORDER BY gl * gl / (hl + 1) + (tg - gl) * (tg - gl) / (th - hl + 1) DESC, b LIMIT 1),
  l AS (SELECT (b0 <= b) AS low, t - base AS v, row_number() OVER (PARTITION BY (b0 <= b) ORDER BY t - base) AS k, count(*) OVER (PARTITION BY (b0 <= b)) AS n FROM y CROSS JOIN best),
  m AS (SELECT low, {_MEDIAN} AS leaf FROM l GROUP BY low, n)
  SELECT l_orderkey, l_linenumber, round(base + 0.5 * leaf, 3) AS prediction FROM y CROSS JOIN best JOIN m ON low = (b0 <= b)""")
def tree_exact_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).withColumn("t", F.col("ep") / 1000)
    model = train({"objective": "reg:quantileerror", "quantile_alpha": [0.5], "leaf_estimation": "exact", "max_depth": 1, "eta": 0.5}, rows, ["q"], "t", 1)
    return model.predict(rows, KEY).select(*KEY, F.round("prediction", 3).alias("prediction"))


_VECTOR = f"""WITH r AS ({BINNED}), s AS (SELECT avg(y) AS m0, avg(ep / 10000) AS m1 FROM r), x AS (SELECT r.*, m0 - y AS g0, m1 - ep / 10000 AS g1 FROM r CROSS JOIN s),
  h AS (SELECT b0 AS b, sum(g0) AS p, sum(g1) AS q, count(*) AS n FROM x GROUP BY 1),
  c AS (SELECT b, sum(p) OVER o AS pl, sum(q) OVER o AS ql, sum(n) OVER o AS nl, sum(p) OVER () AS tp, sum(q) OVER () AS tq, sum(n) OVER () AS tn FROM h WINDOW o AS (ORDER BY b)),
  best AS (SELECT * FROM c WHERE nl < tn ORDER BY (pl * pl + ql * ql) / (nl + 1) + ((tp - pl) * (tp - pl) + (tq - ql) * (tq - ql)) / (tn - nl + 1) DESC, b LIMIT 1)"""


@query("tree_vector_leaves", _VECTOR + """ SELECT l_orderkey, l_linenumber, round(m0 + 0.5 * CASE WHEN b0 <= b THEN -pl / (nl + 1) ELSE -(tp - pl) / (tn - nl + 1) END, 4) AS prediction0, round(m1 + 0.5 * CASE WHEN b0 <= b THEN -ql / (nl + 1) ELSE -(tq - ql) / (tn - nl + 1) END, 4) AS prediction1 FROM r CROSS JOIN s CROSS JOIN best""")
def tree_vector_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One structure for two label columns."""
    rows = lines(spark, sf_dir).withColumn("z", F.col("ep") / 10000)
    model = train({"max_depth": 1, "eta": 0.5, "multi_strategy": "multi_output_tree"}, rows, ["q"], ["y", "z"], 1)
    return _rounded(model.predict(rows, KEY), "prediction0", "prediction1")


@query("linear_round", f"""WITH r AS (SELECT *, q::DOUBLE AS x FROM ({LINES})), s AS (SELECT avg(ep / 1000) AS base FROM r), a AS (SELECT base, sum(x * (base - ep / 1000)) AS g, sum(x * x) AS h, sum(base - ep / 1000) AS g0, count(*) AS n, sum(x) AS sx FROM r CROSS JOIN s GROUP BY base),
  b AS (SELECT base - 0.5 * g0 / n AS bias, -0.5 * (g - 0.5 * g0 / n * sx) / (h + 2) AS w FROM a) SELECT l_orderkey, l_linenumber, round(b.bias + b.w * x, 4) AS prediction FROM r CROSS JOIN b""")
def linear_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).withColumn("t", F.col("ep") / 1000)
    model = train({"booster": "gblinear", "eta": 0.5, "lambda": 2.0}, rows, ["q"], "t", 1)
    return _rounded(model.predict(rows, KEY), "prediction")


@query("refresh_stump", _SQUARED + """, n AS (SELECT CASE WHEN b0 <= b THEN 1 ELSE 2 END AS node_id, y / 2 AS z FROM r CROSS JOIN best), w AS (SELECT *, avg(z) OVER () AS base2 FROM n)
  SELECT node_id, count(*)::DOUBLE AS cover, round(-0.5 * sum(s.base - z) / (count(*) + 1), 4) AS leaf FROM w CROSS JOIN s GROUP BY node_id""")
def refresh_stump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structure learnt from y with the leaves of y / 2, by process_type update."""
    rows, model = _tree(spark, sf_dir)
    new = train({"max_depth": 1, "eta": 0.5, "process_type": "update"}, rows.withColumn("y", F.col("y") / 2), ["q"], "y", 1, init_model=model)
    return new.nodes(spark).where("left < 0").select(F.col("node_id").cast("long").alias("node_id"), F.col("sum_hess").alias("cover"), F.round("leaf_value", 4).alias("leaf"))


# options of the search, on the level of nodes 1 and 2 as in ``queries``


def _found(rows: DataFrame) -> DataFrame:
    rows = rows.where("feature is not null")
    return rows.select("node", F.col("feature").cast("long").alias("feature"), F.col("bin").cast("long").alias("bin"), "default_left", F.round(F.col("loss").cast("double"), 1).alias("loss"), F.round(F.col("gl")[0], 3).alias("gl"), F.round(F.col("hl")[0], 3).alias("hl"), "nl")


_PICK = "row_number() OVER (PARTITION BY node ORDER BY loss DESC, feature, default_left, CASE WHEN default_left THEN -bin ELSE bin END) = 1"
_SHOWN = "SELECT node, feature, bin, default_left, round(loss, 1) AS loss, round(gl, 3) AS gl, round(hl, 3) AS hl, nl::BIGINT AS nl"
_EXTRA_SEED = 9
_SMOOTH = 500.0


def _extra_sql() -> str:
    drawn = ", ".join(f"({n}, {f}, {draw(_EXTRA_SEED, n, f, 5)!r})" for n in (1, 2) for f in range(3))
    scan = _SCAN.format(hist=HIST, l=1.0, m=1.0)
    return scan + f""", u AS (SELECT * FROM (VALUES {drawn}) AS v(node, feature, u)), e AS (SELECT node, feature, min(bin) AS low, max(bin) AS high FROM h WHERE bin >= 0 GROUP BY 1, 2),
  d AS (SELECT node, feature, CASE WHEN high > low THEN low + floor(u * (high - low)) ELSE low END AS cut FROM e JOIN u USING (node, feature)),
  f AS (SELECT h.node, h.feature, max(h.bin) AS bin FROM h JOIN d USING (node, feature) WHERE h.bin >= 0 AND h.bin <= cut GROUP BY 1, 2)
  {_SHOWN} FROM x JOIN f USING (node, feature, bin) QUALIFY {_PICK}"""


@query("split_extra_trees", _extra_sql())
def split_extra_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One drawn threshold of each feature and node."""
    return _found(_level(spark, sf_dir, split.Regularisation(extra_trees=True, extra_seed=_EXTRA_SEED), keys=True)[0])


def _smoothed_sql() -> str:
    scan = _SCAN.format(hist=HIST, l=1.0, m=1.0)
    out = lambda g, h, n: f"(-{g} / ({h} + 1) * {n} / ({n} + {_SMOOTH}) + own * {_SMOOTH} / ({n} + {_SMOOTH}))"
    score = lambda g, h, w: f"-(2 * ({g}) * {w} + ({h} + 1) * {w} * {w})"
    return scan + f""", p AS (SELECT *, -tg / (th + 1) AS own, round(tn * hl / th) AS el, round(tn * (1 - hl / th)) AS er FROM c WHERE hl >= 1 AND th - hl >= 1 AND nl > 0 AND tn - nl > 0),
  w AS (SELECT *, {out("gl", "hl", "el")} AS a, {out("(tg - gl)", "(th - hl)", "er")} AS b, {out("tg", "th", "tn")} AS o FROM p),
  v AS (SELECT *, {score("gl", "hl", "a")} + {score("tg - gl", "(th - hl)", "b")} - ({score("tg", "th", "o")}) AS loss FROM w)
  SELECT node, feature, bin, default_left, round(loss, 1) AS loss, round(a, 5) AS wl, round(b, 5) AS wr FROM v QUALIFY {_PICK}"""


@query("split_path_smooth", _smoothed_sql())
def split_path_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children's outputs are pulled towards their parent's."""
    rows = _level(spark, sf_dir, split.Regularisation(path_smooth=_SMOOTH))[0].where("feature is not null")
    return rows.select("node", F.col("feature").cast("long").alias("feature"), F.col("bin").cast("long").alias("bin"), "default_left", F.round(F.col("loss").cast("double"), 1).alias("loss"), F.round(F.col("wl")[0], 5).alias("wl"), F.round(F.col("wr")[0], 5).alias("wr"))


_USED = (2, 3)  # feature and bin that the model already splits at
_IOTA, _XI = 5000.0, 800.0


@query("split_reuse", _SCAN.format(hist=HIST, l=1.0, m=1.0) + f""", v AS (SELECT * REPLACE (loss - CASE WHEN feature <> {_USED[0]} THEN {_IOTA + _XI} WHEN bin <> {_USED[1]} THEN {_XI} ELSE 0 END AS loss) FROM x) {_SHOWN} FROM v WHERE loss > 1e-6 QUALIFY {_PICK}""")
def split_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits at new features and thresholds pay for being new."""
    return _found(_level(spark, sf_dir, split.Regularisation(new_feature=_IOTA, new_threshold=_XI), used=_USED)[0])


_GROUPS = 40


def _groups_sql() -> str:
    cells = CELLS.replace("SELECT node, feature, coalesce(b, -1) AS bin, g, w AS h FROM", "SELECT node, feature, coalesce(b, -1) AS bin, l_suppkey AS grp FROM").replace("w * g AS g, w FROM", "l_suppkey FROM")
    return _SCAN.format(hist=HIST, l=1.0, m=1.0) + f""", z AS ({cells}), y AS (SELECT x.node, x.feature, x.bin, x.default_left, count(DISTINCT CASE WHEN z.bin BETWEEN 0 AND x.bin OR (z.bin < 0 AND x.default_left) THEN grp END) AS kl, count(DISTINCT CASE WHEN z.bin > x.bin OR (z.bin < 0 AND NOT x.default_left) THEN grp END) AS kr
  FROM x JOIN z ON x.node = z.node AND x.feature = z.feature GROUP BY ALL)
  {_SHOWN} FROM x JOIN y USING (node, feature, bin, default_left) WHERE kl >= {_GROUPS} AND kr >= {_GROUPS} QUALIFY {_PICK}"""


@query("split_groups", _groups_sql())
def split_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both children hold rows of so many suppliers."""
    return _found(_level(spark, sf_dir, split.Regularisation(min_groups=_GROUPS), group="l_suppkey")[0])


# gradients and metrics of further objectives

_QUERIES = "SELECT event_id, user_id AS q, value / 20 AS m, CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS y FROM events"


@query("grad_xendcg", f"""WITH r AS (SELECT *, pow(2, y) - {uniform_sql('event_id', 0, 0, 77)} AS phi, max(m) OVER (PARTITION BY q) AS top FROM ({_QUERIES})),
  a AS (SELECT *, exp(m - top) / sum(exp(m - top)) OVER (PARTITION BY q) AS rho, count(*) OVER (PARTITION BY q) AS n, phi / sum(phi) OVER (PARTITION BY q) AS p FROM r),
  b AS (SELECT *, rho - p AS l1, CASE WHEN n > 1 THEN (rho - p) / (1 - rho) ELSE 0 END AS t1 FROM a), c AS (SELECT *, rho * (sum(t1) OVER (PARTITION BY q) - t1) AS l2 FROM b),
  d AS (SELECT *, CASE WHEN n > 1 THEN l2 / (1 - rho) ELSE 0 END AS t2 FROM c), e AS (SELECT *, rho * (sum(t2) OVER (PARTITION BY q) - t2) AS l3 FROM d)
  SELECT event_id, round(CASE WHEN n > 1 THEN l1 + l2 + l3 ELSE 0 END, 5) + 0 AS g, round(CASE WHEN n > 1 THEN rho * (1 - rho) ELSE 0 END, 6) + 0 AS h FROM e""")
def grad_xendcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.select("event_id", F.col("event_id").alias("row_id"), F.col("user_id").alias("qid"), (F.col("value") / 20).alias("m"), F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1).otherwise(0).alias("y"))
    loss = objective("rank:xendcg")
    rows = loss.prepare(rows, ["m"], "y", F.lit(1.0))
    g, h = loss.pairs([F.col("m")], F.col("y"), F.lit(1.0))[0]
    return rows.select("event_id", (F.round(g, 5) + 0.0).alias("g"), (F.round(h, 6) + 0.0).alias("h"))


def _psi(x: str) -> str:
    return f"((lgamma({x} + 1e-4) - lgamma({x} - 1e-4)) / 2e-4)"


def _psi1(x: str) -> str:
    return f"((lgamma({x} + 1e-3) - 2 * lgamma({x}) + lgamma({x} - 1e-3)) / 1e-6)"


_GRADS = {
    "gamma": ("dist:gamma", "y", 2, "exp(m0) AS a, exp(m1) AS s", [("s * (1 - y / a)", "s"), (f"s * ({_psi('s')} - ln(s) - ln(y / a) + y / a - 1)", f"s * s * ({_psi1('s')} - 1 / s)")]),
    "negbinomial": ("dist:negbinomial", "k", 2, "exp(m0) AS a, exp(m1) AS r", [("r * (a - k) / (a + r)", "a * r / (a + r)"), (f"-r * ({_psi('(k + r)')} - {_psi('r')} - ln(1 + a / r) + (a - k) / (a + r))", None)]),
    "student_t": ("dist:student_t", "y", 3, "1 + exp(m2) AS v, exp(m1) * (1 + exp(m2)) / (2 + exp(m2)) AS s, (y - m0) / (exp(m1) * (1 + exp(m2)) / (2 + exp(m2))) AS z", [("-(v + 1) / (v + z * z) * z / s", "(v + 1) / ((v + 3) * s * s)"), ("1 - (v + 1) / (v + z * z) * z * z", "2 * v / (v + 3)"), (f"(v - 1) * (0.5 * ({_psi('(v / 2)')} - {_psi('((v + 1) / 2)')} + 1 / v + ln(1 + z * z / v) - (v + 1) / v * (z * z / v) / (1 + z * z / v)) + (1 - (v + 1) / (v + z * z) * z * z) / (v * (v + 1)))", None)]),
}


def _dist(name: str) -> None:
    kind, label, n, parts, pairs = _GRADS[name]
    cells = ", ".join(f"round(w * ({e}), 3) + 0 AS {c}{k}" for k, pair in enumerate(pairs) for c, e in zip("gh", pair, strict=True) if e)
    inner = f"SELECT l_orderkey, l_linenumber, w, y, l_linenumber::DOUBLE AS k, 0.5 + tax * 5 AS m0, 0.2 + m / 10 AS m1, 1.0 + tax * 10 AS m2 FROM ({LINES})"

    @query(f"grad_{name}_distribution", f"SELECT l_orderkey, l_linenumber, {cells} FROM (SELECT *, {parts} FROM ({inner}))")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        loss = objective(kind)
        rows = lines(spark, sf_dir).withColumns({"k": F.col("l_linenumber").cast("double"), "m0": 0.5 + F.col("tax") * 5, "m1": 0.2 + F.col("m") / 10, "m2": 1.0 + F.col("tax") * 10})
        margins = [f"m{j}" for j in range(n)]
        rows = loss.prepare(rows, margins, label, F.col("w"))
        got = loss.pairs([F.col(m) for m in margins], F.col(label), F.col("w"))
        return rows.select(*KEY, *((F.round(x, 3) + 0.0).alias(f"{c}{j}") for j, pair in enumerate(got) for c, x, e in zip("gh", pair, pairs[j], strict=True) if e))


for _name in _GRADS:
    _dist(_name)


@query("metric_nll_gamma", f"SELECT round(sum(w * -(w * ln(w / (ep / 20000)) + (w - 1) * ln(y) - w * y / (ep / 20000) - lgamma(w))) / sum(w), 5) AS value FROM ({LINES})")
def metric_nll_gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).withColumn("pr", F.col("ep") / 20000)
    return evaluate("nll", rows, ["pr", "w"], "y", weight=F.col("w"), objective="dist:gamma").select(F.round("value", 5).alias("value"))


_AFT = "SELECT o_totalprice / 100000 AS t, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 0.5 + o_custkey % 3 END AS lo, CASE WHEN o_orderstatus = 'O' THEN 'inf'::DOUBLE WHEN o_custkey % 5 = 0 AND o_orderstatus <> 'P' THEN 0.5 + o_custkey % 3 ELSE 4 + o_custkey % 3 END AS hi FROM orders"


@query("metric_aft_nloglik", f"""WITH z AS (SELECT *, CASE WHEN lo > 0 THEN (ln(lo) - ln(t)) / 1.5 END AS a, CASE WHEN hi < 'inf'::DOUBLE THEN (ln(hi) - ln(t)) / 1.5 END AS b FROM ({_AFT})),
  f AS (SELECT *, CASE WHEN a IS NULL THEN 0 ELSE 1 / (1 + exp(-a)) END AS fa, CASE WHEN b IS NULL THEN 1 ELSE 1 / (1 + exp(-b)) END AS fb FROM z)
  SELECT round(avg(-ln(greatest(CASE WHEN lo = hi THEN fa * (1 - fa) / (1.5 * lo) ELSE fb - fa END, 1e-12))), 5) AS value FROM f""")
def metric_aft_nloglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lo = F.when(F.col("o_orderstatus") == "P", 0.0).otherwise(0.5 + F.col("o_custkey") % 3)
    hi = F.when(F.col("o_orderstatus") == "O", float("inf")).when((F.col("o_custkey") % 5 == 0) & (F.col("o_orderstatus") != "P"), 0.5 + F.col("o_custkey") % 3).otherwise(4.0 + F.col("o_custkey") % 3)
    rows = o.select((F.col("o_totalprice") / 100000).alias("t"), lo.alias("label_lower"), hi.alias("label_upper"), F.lit(0.0).alias("label"))
    return evaluate("aft-nloglik", rows, ["t"], "label", aft_loss_distribution="logistic", aft_loss_distribution_scale=1.5).select(F.round("value", 5).alias("value"))

