"""pyspark.ml estimators over the trainer."""

from __future__ import annotations

from typing import Any

from pyspark.ml import Estimator, Transformer
from pyspark.sql import DataFrame

from .errors import InvalidParameter
from .model import Model
from .plans.train import train


class BoostModel(Transformer):
    """A fitted model; ``transform`` adds the column ``prediction`` (or ``prediction0``, ... ) to a table."""

    def __init__(self, model: Model, classify: bool = False) -> None:
        super().__init__()
        self.model, self.classify = model, classify

    def _transform(self, dataset: DataFrame) -> DataFrame:
        keep = dataset.columns
        if self.classify:
            return self.model.predict_class(dataset, keep).withColumnRenamed("class", "prediction")
        return self.model.predict(dataset, keep)


class BoostRegressor(Estimator):
    """Options: features, label, rounds, weight, and any training parameter by name."""

    objective = "reg:squarederror"
    classify = False

    def __init__(self, *, features: list[str], label: str = "label", rounds: int = 100, weight: str | None = None, qid: str | None = None, row_id: str | None = None, categorical: tuple[str, ...] = (), **params: Any) -> None:
        super().__init__()
        self.features, self.label, self.rounds, self.weight, self.qid, self.row_id, self.categorical = features, label, rounds, weight, qid, row_id, categorical
        self.options = {"objective": self.objective, **params}

    def _fit(self, dataset: DataFrame) -> BoostModel:
        model = train(self.options, dataset, self.features, self.label, self.rounds, weight=self.weight, qid=self.qid, row_id=self.row_id, categorical=self.categorical)
        return BoostModel(model, self.classify)


class BoostClassifier(BoostRegressor):
    """Two classes, or ``num_class`` of them."""

    objective = "binary:logistic"
    classify = True

    def __init__(self, **options: Any) -> None:
        if options.get("num_class", 2) > 2:
            options.setdefault("objective", "multi:softprob")
        else:
            options.pop("num_class", None)
        super().__init__(**options)


class BoostRanker(BoostRegressor):
    objective = "rank:ndcg"

    def __init__(self, **options: Any) -> None:
        super().__init__(**options)
        if self.qid is None:
            raise InvalidParameter("ranking needs qid")
