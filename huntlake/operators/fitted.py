"""Base classes for fit/transform pairs (Z3, E6): Spark ML Estimator / Model with
their fitted values held as a JSON Param, so ``save``/``load`` and ``Pipeline``
work out of the box and the state is a few literals broadcast in the plan.
"""

from __future__ import annotations

import json

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable


class _Common(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns to use (empty: schema-driven)",
                      typeConverter=TypeConverters.toListString)
    options = Param(Params._dummy(), "options", "operator options as JSON",
                    typeConverter=TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(inputCols=[], options="{}")

    def get_options(self) -> dict:
        return json.loads(self.getOrDefault(self.options))

    def get_cols(self) -> list[str]:
        return list(self.getOrDefault(self.inputCols))


class JsonEstimator(Estimator, _Common, DefaultParamsReadable, DefaultParamsWritable):
    model_class: type = None

    def __init__(self, inputCols: list[str] | None = None, **options):
        super().__init__()
        if inputCols:
            self._set(inputCols=list(inputCols))
        merged = dict(self.default_options())
        merged.update({k: v for k, v in options.items() if v is not None})
        self._set(options=json.dumps(merged))

    def default_options(self) -> dict:
        return {}

    def fit_state(self, dataset) -> dict:
        raise NotImplementedError

    def _fit(self, dataset):
        model = self.model_class()
        model._set(inputCols=self.get_cols(), options=self.getOrDefault(self.options))
        model._set(state=json.dumps(self.fit_state(dataset)))
        return model


class JsonModel(Model, _Common, DefaultParamsReadable, DefaultParamsWritable):
    state = Param(Params._dummy(), "state", "fitted values as JSON", typeConverter=TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(state="{}")

    def get_state(self) -> dict:
        return json.loads(self.getOrDefault(self.state))
