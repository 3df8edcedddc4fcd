"""Prepared training rows: binned once, used by many trainings; views of rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.binning import Cuts, make_cuts, packed


@dataclass
class BinnedMatrix:
    """Cached rows of packed codes with their other columns, and the cuts that made them; raw features are gone."""

    rows: DataFrame
    cuts: Cuts

    @classmethod
    def of(cls, df: DataFrame, features: Sequence[str], *, max_bin: int = 256, categorical: Sequence[str] = (), weight: Column | None = None, cuts: Cuts | None = None) -> BinnedMatrix:
        """cuts: those of another table, for a view that is to be binned as its source was."""
        cuts = cuts or make_cuts(df, features, max_bin=max_bin, categorical=categorical, weight=weight)
        keep = [c for c in df.columns if c not in features]
        return cls(packed(df, cuts, keep).persist(StorageLevel.MEMORY_AND_DISK), cuts)

    def release(self) -> None:
        self.rows.unpersist()


def select_rows(df: DataFrame, row_id: str, selection: DataFrame) -> DataFrame:
    """The rows of df that ``selection`` (position, row_id) names, in that order and as often, with the column ``position``."""
    wanted = selection.select(F.col("position"), F.col("row_id").alias("__wanted"))
    return df.join(wanted, F.col(row_id) == F.col("__wanted")).drop("__wanted")
