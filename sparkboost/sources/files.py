"""Numeric CSV and libsvm files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidData


def read_csv(spark: SparkSession, path: str, columns: list[str], *, header: bool = True, sep: str = ",", na_value: str = "") -> DataFrame:
    """Numbers of a CSV file with the given columns; empty fields and na_value are missing, ragged rows an error."""
    schema = ", ".join(f"`{c}` double" for c in columns)
    return spark.read.csv(path, schema=schema, header=header, sep=sep, nullValue=na_value, mode="FAILFAST", enforceSchema=True)


def read_libsvm(spark: SparkSession, path: str, n_features: int | None = None) -> DataFrame:
    """label, qid, f0, f1, ... of lines ``label [qid:q] index:value ...`` with indices from 0; ``#`` begins a comment.

    An absent entry is missing, an explicit zero is present.
    """
    line = F.trim(F.regexp_replace("value", "#.*", ""))
    rows = spark.read.text(path).select(line.alias("line")).where("line <> ''").select(F.split("line", r"\s+").alias("p"))
    pair = F.transform(F.filter(F.slice("p", 2, F.size("p")), lambda x: ~x.startswith("qid:")), lambda x: F.struct(F.split(x, ":")[0].cast("int").alias("i"), F.split(x, ":")[1].cast("double").alias("v")))
    query = F.filter("p", lambda x: x.startswith("qid:"))
    rows = rows.select(F.col("p")[0].cast("double").alias("label"), F.when(F.size(query) > 0, F.substring(F.get(query, F.lit(0)), 5, 20).cast("long")).alias("qid"), pair.alias("x"))
    if n_features is None:
        n_features = (rows.agg(F.max(F.array_max(F.transform("x", lambda e: e["i"]))).alias("m")).first()["m"] or 0) + 1
    if not rows.where(F.exists("x", lambda e: e["i"].isNull() | (e["i"] >= n_features))).isEmpty():
        raise InvalidData("an index is malformed or too large")
    value = F.map_from_entries("x")
    return rows.select("label", "qid", *(F.element_at(value, k).alias(f"f{k}") for k in range(n_features)))
