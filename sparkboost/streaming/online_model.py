"""A model that follows its rows: additions and deletions in batches, by exact retraining."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..model import Model
from ..params import Params
from ..plans.train import train


class OnlineModel:
    """Rows in a versioned Parquet folder and the model of the latest version.

    An update writes the next version of the rows (those before without the deleted ids, and the
    new ones) and trains on it, so that the model is the one that training on those rows gives.
    The latest version is the last that the folder holds in full: an object made after a restart
    goes on from it, and what a broken update has left is written over.
    """

    def __init__(self, params: Params | dict, path: str, features: Sequence[str], label: str, rounds: int, row_id: str, **options) -> None:
        self.params, self.path, self.features, self.label, self.rounds, self.row_id, self.options = params, path.rstrip("/"), list(features), label, rounds, row_id, options
        self.model = None

    def version(self, spark) -> int:
        """The last whole version in the folder, -1 if there is none."""
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return -1
        whole = [s.getPath().getName() for s in fs.listStatus(at) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max((int(n[1:]) for n in whole if n[:1] == "v" and n[1:].isdigit()), default=-1)

    def rows(self, spark) -> DataFrame:
        return spark.read.parquet(f"{self.path}/v{self.version(spark):08d}")

    def update(self, added: DataFrame | None = None, deleted: DataFrame | None = None) -> Model:
        """added: new rows; deleted: a table with the row_ids to go.  A row_id that is added again replaces its row."""
        spark = (added if added is not None else deleted).sparkSession
        rows, version = None, self.version(spark)
        if version >= 0:
            rows = self.rows(spark)
            for gone in (deleted, added):
                if gone is not None:
                    rows = rows.join(gone.select(self.row_id).distinct(), self.row_id, "left_anti")
        if added is not None:
            rows = added if rows is None else rows.unionByName(added.select(rows.columns))
        rows.write.mode("overwrite").parquet(f"{self.path}/v{version + 1:08d}")
        self.model = train(self.params, self.rows(spark), self.features, self.label, self.rounds, row_id=self.row_id, **self.options)
        return self.model

    def follow(self, stream: DataFrame, checkpoint: str):
        """A streaming query that takes up each micro-batch of new rows.

        A batch that is replayed after a restart replaces its own rows, so that it does no harm.
        """

        def take(batch: DataFrame, number: int) -> None:
            if not batch.isEmpty():
                self.update(batch)

        return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).start()
