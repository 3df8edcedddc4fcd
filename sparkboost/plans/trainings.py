"""Queries that train a model; their results have no SQL form but for single trees."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folds
from ..streaming.online_calibrator import calibrated
from .cv import cv
from .queries import BINNED, lines
from .refresh import refreshed
from .train import train

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


KEY = ["l_orderkey", "l_linenumber"]


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows: two codes of strings are categories, the unit price is the label."""
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    status = F.when(F.col("l_linestatus") == "F", 0).otherwise(1)
    return d.select(*KEY, (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice", flag.alias("flag"), status.alias("status"), F.month("l_shipdate").alias("month"), (F.col("l_extendedprice") / F.col("l_quantity") / 1000).alias("price"))


FEATURES = ["l_quantity", "l_discount", "l_tax", "flag", "status"]
PARAMS = {"max_depth": 3, "max_bin": 32, "eta": 0.3}


def _model(spark, sf_dir, rounds=3, features=FEATURES, label="price", evals=False, categorical=("flag", "status"), **params):
    rows = _rows(spark, sf_dir)
    return rows, train({**PARAMS, **params}, rows, features, label, rounds, row_id="row_id", categorical=categorical, evals={"train": rows} if evals else None)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = _model(spark, sf_dir, 5)
    return model.predict(rows, KEY)


def _history(spark: SparkSession, model) -> DataFrame:
    return spark.createDataFrame(model.history, "iteration int, dataset string, metric string, value double")


QUERIES["train_regression"] = flagship


@query(
    "tree_depth1_predict",
    f"""WITH r AS ({BINNED}), s AS (SELECT avg(y) AS base, count(*) AS n FROM r), h AS (SELECT b0 AS b, sum((SELECT base FROM s) - y) AS g, count(*) AS n FROM r GROUP BY 1),
  c AS (SELECT b, sum(g) OVER (ORDER BY b) AS gl, sum(n) OVER (ORDER BY b) AS hl, sum(g) OVER () AS tg, sum(n) OVER () AS th FROM h),
  x AS (SELECT b, gl, hl, tg, th, gl * gl / (hl + 1) + (tg - gl) * (tg - gl) / (th - hl + 1) AS loss FROM c WHERE hl < th), best AS (SELECT * FROM x ORDER BY loss DESC, b LIMIT 1)
  SELECT l_orderkey, l_linenumber, round(base + 0.5 * CASE WHEN r.b0 <= best.b THEN -gl / (hl + 1) ELSE -(tg - gl) / (th - hl + 1) END, 4) AS prediction FROM r CROSS JOIN s CROSS JOIN best""",
)
def tree_depth1_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    model = train({"max_depth": 1, "max_bin": 256, "eta": 0.5}, rows, ["q"], "y", 1)
    return model.predict(rows, KEY).select(*KEY, F.round("prediction", 4).alias("prediction"))


@query("train_binary")
def train_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = _model(spark, sf_dir, features=["l_quantity", "l_discount", "month"], label="status", categorical=(), objective="binary:logistic", subsample=0.8, colsample_bynode=0.7)
    return model.predict(rows, KEY)


@query("train_multiclass")
def train_multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = _model(spark, sf_dir, 2, ["l_quantity", "l_discount", "month"], "flag", categorical=("month",), objective="multi:softprob", num_class=3)
    return model.predict_class(rows, KEY)


@query("train_ranking")
def train_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    model = train({**PARAMS, "objective": "rank:ndcg"}, rows, ["l_quantity", "l_discount", "month"], "flag", 2, qid="l_orderkey", row_id="row_id")
    return model.predict(rows, KEY)


@query("train_lossguide")
def train_lossguide(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = _model(spark, sf_dir, 2, grow_policy="lossguide", max_leaves=6)
    return model.predict_leaf(rows, KEY).select(*KEY, F.col("leaves")[0].alias("leaf0"), F.col("leaves")[1].alias("leaf1"))


@query("train_symmetric")
def train_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, model = _model(spark, sf_dir, 2, grow_policy="symmetric")
    return model.nodes(spark)


@query("train_dart_eval")
def train_dart_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, model = _model(spark, sf_dir, 3, evals=True, booster="dart", rate_drop=0.3, one_drop=True)
    return _history(spark, model)


@query("train_linear")
def train_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = _model(spark, sf_dir, 5, ["l_quantity", "l_tax"], categorical=(), booster="gblinear")
    return model.predict(rows, KEY)


@query("train_quantile_forest")
def train_quantile_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = _model(spark, sf_dir, 1, objective="reg:quantileerror", quantile_alpha=[0.1, 0.9], num_parallel_tree=2, subsample=0.7)
    return model.predict(rows, KEY)


@query("train_distribution")
def train_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = _model(spark, sf_dir, 2, objective="dist:normal")
    return model.predict(rows, KEY)


@query("train_constrained")
def train_constrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = _model(spark, sf_dir, 2, monotone_constraints={"l_quantity": -1}, interaction_constraints=[["l_quantity", "l_tax"], ["l_discount"]])
    return model.predict(rows, KEY)


@query("shap_contributions")
def shap_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = _model(spark, sf_dir, 2)
    return model.contributions(rows, KEY).select(*KEY, *(F.col("contributions0")[k].alias(f"phi{k}") for k in range(len(FEATURES) + 1)))


@query("importance")
def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, model = _model(spark, sf_dir, 2)
    return spark.createDataFrame([(kind, f, v) for kind in ("weight", "gain", "total_gain", "cover", "total_cover") for f, v in model.importance(kind).items()], "kind string, feature string, value double")


@query("refresh_nodes")
def refresh_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = _model(spark, sf_dir, 2)
    return refreshed(PARAMS, model, rows, "price").nodes(spark)


@query("cv_mean_std")
def cv_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).dropDuplicates(["row_id"])
    parts = folds.k_fold(rows, "row_id", 2, 1)
    return cv(PARAMS, rows, ["l_quantity", "l_tax"], "price", 2, parts, row_id="row_id")[0]


@query("online_calibration")
def online_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return calibrated(e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("value").alias("score")), 0.1, 0.5, 20.0)
