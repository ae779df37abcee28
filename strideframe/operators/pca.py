"""First principal component of stacked joints (V-15, V-16)."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ComponentModel:
    """mean and loadings; the loading of greatest magnitude is positive, as the sign is arbitrary."""

    def __init__(self, mean: np.ndarray, loadings: np.ndarray):
        self.mean = np.asarray(mean, np.float64)
        sign = np.sign(loadings[np.abs(loadings).argmax()]) or 1.0
        self.loadings = np.asarray(loadings, np.float64) * sign

    def transform(self, frames: DataFrame, values: str = "values") -> DataFrame:
        """V-16: adds `score`, the centred projection (Spark's own model does not centre)."""
        shift = float(self.mean @ self.loadings)
        terms = [F.col(values)[k] * F.lit(float(w)) for k, w in enumerate(self.loadings)]
        return frames.withColumn("score", sum(terms[1:], terms[0]) - F.lit(shift))


def fit_component(frames: DataFrame, values: str = "values", neutral: np.ndarray | None = None) -> ComponentModel:
    """V-15: centred, not scaled. A neutral pose is not supported (K-17)."""
    if neutral is not None:
        raise NotImplementedError("a neutral pose is not supported")
    rows = frames.select(array_to_vector(F.col(values)).alias("v"))
    model = PCA(k=1, inputCol="v", outputCol="s").fit(rows)
    width = model.pc.numRows
    means = frames.agg(F.array(*[F.avg(F.col(values)[k]) for k in range(width)]).alias("m")).first()["m"]  # one row
    return ComponentModel(np.asarray(means), model.pc.toArray()[:, 0])
