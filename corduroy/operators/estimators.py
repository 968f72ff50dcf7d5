"""The models as pyspark.ml estimators: fit, transform, save and load, also as stages of a Pipeline.

What a fit gives is a few numbers, kept as a parameter in JSON, and for models with a value for each group or key a table as well,
kept as Parquet beside the parameters.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import models
from .panel import leave_one_out_rate, prior_strength
from .ranks import quantiles


class _State(HasLabelCol, HasPredictionCol):
    """What all of these share: the label, the prediction and, once fitted, the numbers of the fit."""

    state = Param(Params._dummy(), "state", "numbers of the fit, in JSON", TypeConverters.toString)

    def fitted(self) -> dict:
        """The numbers of the fit."""
        return json.loads(self.getOrDefault(self.state))


class _Regression(_State):
    columns = Param(Params._dummy(), "columns", "feature columns; an intercept is added", TypeConverters.toListString)
    exposure = Param(Params._dummy(), "exposure", "column of exposures, whose logarithm is the offset; empty for none", TypeConverters.toString)
    family = Param(Params._dummy(), "family", "poisson or nb2", TypeConverters.toString)
    grid = Param(Params._dummy(), "grid", "number of dispersions that nb2 tries", TypeConverters.toInt)

    def _design(self, df: DataFrame) -> tuple[DataFrame, list[str], str | None]:
        expo = self.getOrDefault(self.exposure)
        rows = df.withColumn("_one", F.lit(1.0))
        return (rows.withColumn("_offset", F.ln(F.col(expo).cast("double"))) if expo else rows), ["_one", *self.getOrDefault(self.columns)], "_offset" if expo else None


class CountRegression(_Regression, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Poisson or negative-binomial regression of counts."""

    @keyword_only
    def __init__(self, *, labelCol: str = "label", predictionCol: str = "prediction", columns: list[str] | None = None, exposure: str = "", family: str = "poisson", grid: int = 60):
        super().__init__()
        self._setDefault(labelCol="label", predictionCol="prediction", columns=[], exposure="", family="poisson", grid=60)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> CountRegressionModel:
        rows, columns, offset = self._design(df)
        y = self.getLabelCol()
        nb2 = self.getOrDefault(self.family) == "nb2"
        m = models.fit_negative_binomial(rows, y, columns, offset, self.getOrDefault(self.grid)) if nb2 else models.fit_counts(rows, y, columns, offset)
        state = {k: v.tolist() if hasattr(v, "tolist") else v for k, v in m.items()}
        out = self._copyValues(CountRegressionModel())
        return out._set(state=json.dumps(state))


class CountRegressionModel(_Regression, Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the expected count; rate_ratios() gives the effects."""

    def __init__(self):
        super().__init__()
        self._setDefault(labelCol="label", predictionCol="prediction", columns=[], exposure="", family="poisson", grid=60)

    def _transform(self, df: DataFrame) -> DataFrame:
        rows, _, _ = self._design(df)
        return models.predict(rows, self.fitted(), self.getPredictionCol()).drop("_one", "_offset")

    def rate_ratios(self) -> list[dict]:
        import numpy as np

        m = self.fitted()
        return models.rate_ratios(m | {"cov": np.array(m["cov"])})


class _Baseline(_State):
    statistic = Param(Params._dummy(), "statistic", "mean or median", TypeConverters.toString)


class BaselineRegressor(_Baseline, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """The training rows' mean or median as the prediction of every row."""

    @keyword_only
    def __init__(self, *, labelCol: str = "label", predictionCol: str = "prediction", statistic: str = "mean"):
        super().__init__()
        self._setDefault(labelCol="label", predictionCol="prediction", statistic="mean")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> BaselineModel:
        y = self.getLabelCol()
        if self.getOrDefault(self.statistic) == "median":
            value = quantiles(df, y, [0.5]).first()["q"][0]
        else:
            value = df.agg(F.avg(F.col(y).cast("double"))).first()[0]
        return self._copyValues(BaselineModel())._set(state=json.dumps({"value": value}))


class BaselineModel(_Baseline, Model, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self):
        super().__init__()
        self._setDefault(labelCol="label", predictionCol="prediction", statistic="mean")

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getPredictionCol(), F.lit(self.fitted()["value"]).cast("double"))


class _TableWriter(MLWriter):
    def __init__(self, model: _TableModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.table.write.parquet(f"{path}/table")


class _TableReader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> _TableModel:
        spark = SparkSession.builder.getOrCreate()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        out = self.kind(spark.read.parquet(f"{path}/table"))
        out._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(out, metadata)
        return out


class _TableModel(Model, MLReadable, MLWritable):
    """A model with a table, which is saved with it."""

    table: DataFrame

    def write(self) -> _TableWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> _TableReader:
        return _TableReader(cls)


class _Keyed(_State):
    key = Param(Params._dummy(), "key", "column that names a place", TypeConverters.toString)
    year = Param(Params._dummy(), "year", "column of years", TypeConverters.toString)


class PersistenceRegressor(_Keyed, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """The same place's count of the year before as the prediction; null without it."""

    @keyword_only
    def __init__(self, *, labelCol: str = "label", predictionCol: str = "prediction", key: str = "key", year: str = "year"):
        super().__init__()
        self._setDefault(labelCol="label", predictionCol="prediction", key="key", year="year")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> PersistenceModel:
        return self._copyValues(PersistenceModel(df.select(self.getOrDefault(self.key), self.getOrDefault(self.year), self.getLabelCol())))


class PersistenceModel(_Keyed, _TableModel):
    def __init__(self, table: DataFrame):
        super().__init__()
        self.table = table
        self._setDefault(labelCol="label", predictionCol="prediction", key="key", year="year")

    def _transform(self, df: DataFrame) -> DataFrame:
        out = models.persistence(self.table, df, self.getOrDefault(self.key), self.getOrDefault(self.year), self.getLabelCol())
        return out.withColumnRenamed("persistencia", self.getPredictionCol())


class _Bayes(_State):
    group = Param(Params._dummy(), "group", "column whose rate is the prior", TypeConverters.toString)
    exposure = Param(Params._dummy(), "exposure", "column of exposures", TypeConverters.toString)


class EmpiricalBayes(_Bayes, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Rates drawn towards their group's: the prior's strength from the training rows, the groups' rates as a table."""

    @keyword_only
    def __init__(self, *, labelCol: str = "label", predictionCol: str = "prediction", group: str = "group", exposure: str = "exposure"):
        super().__init__()
        self._setDefault(labelCol="label", predictionCol="prediction", group="group", exposure="exposure")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> EmpiricalBayesModel:
        y, x, g = self.getLabelCol(), self.getOrDefault(self.exposure), self.getOrDefault(self.group)
        k = prior_strength(leave_one_out_rate(df, g, y, x), y, x).first()["k"]
        rate = F.try_divide(F.sum(F.col(y).cast("double")), F.nullif(F.sum(F.col(x).cast("double")), F.lit(0.0)))
        whole = df.agg(rate).first()[0]
        table = df.where(F.col(g).isNotNull()).groupBy(g).agg(rate.alias("prior"))
        return self._copyValues(EmpiricalBayesModel(table))._set(state=json.dumps({"k": k, "rate": whole}))


class EmpiricalBayesModel(_Bayes, _TableModel):
    """Adds the estimated rate, its prior and its weight; groups that the training rows lack get the whole table's rate as prior."""

    def __init__(self, table: DataFrame):
        super().__init__()
        self.table = table
        self._setDefault(labelCol="label", predictionCol="prediction", group="group", exposure="exposure")

    def _transform(self, df: DataFrame) -> DataFrame:
        m = self.fitted()
        rows = df.join(self.table, self.getOrDefault(self.group), "left").withColumn("prior", F.coalesce("prior", F.lit(m["rate"]).cast("double"), F.lit(0.0)))
        y, x, k = F.col(self.getLabelCol()).cast("double"), F.col(self.getOrDefault(self.exposure)).cast("double"), m["k"]
        if k is None:  # no over-dispersion: the prior is all there is
            return rows.withColumn("weight", F.lit(0.0)).withColumn(self.getPredictionCol(), F.col("prior"))
        return rows.withColumn("weight", x / (x + k)).withColumn(self.getPredictionCol(), (y + k * F.col("prior")) / (x + k))
