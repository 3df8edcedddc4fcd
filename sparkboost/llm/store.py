"""Shared storage and session settings that all operators use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch: with long texts a batch must stay far below a worker's memory.
ARROW_ROWS = "512"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session has none and runs on this machine alone (tests) is a local folder set
    and used; a cluster without the setting is refused, for its executors couldn't see the folder.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="sparkboost-")
        spark.conf.set("spark.checkpoint.dir", path)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Lowers the Arrow batch size unless the user has chosen one."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, ARROW_ROWS)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sparkboost/{name}-{uuid.uuid4().hex}"


#: Paths of the tables that this process has written and not removed.
_made: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives executor loss."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A place in the record of written tables, for ``release``."""
    return len(_made)


def release(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Removes the tables written since a mark, but for the last ``keep``: nothing may read them any more."""
    stop = len(_made) - keep
    for path in _made[since:stop]:
        remove(spark, path)
    del _made[since:stop]


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def kept_rows(docs: DataFrame, text: str, mask) -> DataFrame:
    """The rows of docs, with all their columns, for which mask(bytes, offsets) is true; no shuffle."""
    import numpy as np
    import pyarrow as pa

    from .text import slices

    place = docs.columns.index(text)
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            keep = [np.asarray(mask(data, off), dtype=bool) for _, _, data, off in slices(batch.column(place))]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
