"""Memory and passes of training steps, which must not grow with a partition's rows."""

import tracemalloc

import numpy as np
import pyarrow as pa

from sparkboost.operators import histogram
from sparkboost.operators.split import chunks


class Steps:
    """Stands for a table: keeps the functions over its batches."""

    def __init__(self, columns):
        self.columns, self.functions = columns, []

    def mapInArrow(self, f, _):
        self.functions.append(f)
        return self

    def repartition(self, *_):
        return self

    sortWithinPartitions = repartition


def test_split_groups_are_counted_as_they_stream_by():
    parts = chunks([0, 1], [4, 4], [False, False], 4096)
    task = histogram.Task(0, lambda codes: np.zeros(len(codes), np.int64), [0], [0], {0: -1}, {}, [0])
    steps = Steps(["codes", "g0", "h0", "grp"])
    histogram.group_counts(steps, [task], parts, 2, np.uint8)
    names = ["slot", "node", "grp", "low", "high", "gone"]
    n, each = 60, 2000
    groups = n * each // 3  # a group has three rows: some go on in the next batch
    seen = np.zeros((5, parts[0].cells), np.int64)
    at = [np.zeros(groups, np.int64) + 9, np.zeros(groups, np.int64)]

    def batches():
        rng = np.random.default_rng(3)
        for k in range(n):
            grp, x = (np.arange(k * each, (k + 1) * each) // 3), rng.integers(1, 5, (each, 2)).astype(np.uint16)
            grp = np.minimum(grp, groups - 1)
            np.minimum.at(at[0], grp, x[:, 0])
            np.maximum.at(at[1], grp, x[:, 0])
            as_binary = lambda v: pa.array([r.tobytes() for r in v], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(each, np.int32)), pa.array(np.zeros(each, np.int32)), pa.array(grp), as_binary(x), as_binary(x), as_binary(np.zeros((each, 2), np.uint8))], names=names)

    list(steps.functions[1](batches()))  # what is imported on the way doesn't count
    tracemalloc.start()
    out = list(steps.functions[1](batches()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    seen = np.frombuffer(out[0].column(5)[0].as_py(), np.int64).reshape(5, -1)
    assert len(out) == 1 and (seen[0, :5] == np.bincount(at[0], minlength=5)).all() and (seen[1, :5] == np.bincount(at[1], minlength=5)).all()
    assert peak < 4 << 20, peak


def test_levels_read_blocks_of_rows(spark):
    """A level's pass sends Python a row for many, and sums them as rows of their own."""
    rng = np.random.default_rng(5)
    from pyspark.sql import functions as F

    from sparkboost.operators.binning import make_cuts, packed

    df = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(rng.integers(0, 9, (3000, 2)))], "id long, x double, y double").repartition(3)
    cuts = make_cuts(df, ["x", "y"])
    rows = packed(df, cuts, ["id"]).select("codes", (F.col("id") * 0.25 - 300).cast("float").alias("g0"), F.lit(1.0).cast("float").alias("h0"), F.col("id").alias("key"))
    blocks = histogram.in_blocks(rows, 2, cuts.code)
    assert blocks.count() == 3 and histogram.totals(blocks, 1) == (3000, [449.75, 1.0])
    parts = chunks([0, 1], cuts.sizes, [False, False], 4096)
    task = histogram.Task(0, lambda codes: np.zeros(len(codes), np.int64), [0], [0], {0: -1})
    shift, sample = (20, 20), histogram.Sample(1, 2, 0.5)
    total = lambda table: sum(np.frombuffer(r["sums"], np.int64) for r in histogram.partial_sums(table, [task], parts, 2, cuts.code, shift, sample).collect())
    assert (total(blocks) == total(rows)).all() and 0 < total(blocks).reshape(3, -1)[2, :10].sum() < 3000


def test_cv_makes_its_rows_once_a_fold(spark, tmp_path):
    import uuid

    from pyspark.sql import functions as F

    from sparkboost.plans.cv import cv

    folder = str(tmp_path)

    def counted(batches):
        open(f"{folder}/{uuid.uuid4()}", "w").close()
        yield from batches

    df = spark.range(0, 400, 1, 1).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"))
    df = df.mapInArrow(counted, df.schema)
    folds = spark.range(0, 800, 1, 1).select((F.col("id") % 2).cast("int").alias("fold"), F.floor(F.col("id") / 2).alias("row_id"), F.when(F.col("id") % 4 < 2, "train").otherwise("test").alias("role"))
    table = cv({"max_depth": 1}, df, ["x"], "y", 1, folds, row_id="id", history_only=True)[0]
    assert table.count() == 2 and len(list(tmp_path.iterdir())) == 2
