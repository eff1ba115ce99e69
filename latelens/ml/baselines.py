"""Two reference scores every trained model has to beat."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latelens.functions.expressions import clip, flag
from latelens.operators.quantiles import median_by

# Weights of distance and state crossing in the rule score.
DISTANCE_WEIGHT, CROSSING_WEIGHT, TINY = 0.7, 0.3, 1e-9


@dataclass(frozen=True)
class MajorityBaseline:
    """Constant score: the late rate of the training part."""

    rate: float

    @classmethod
    def fit(cls, train: DataFrame) -> "MajorityBaseline":
        return cls(train.agg(F.avg("entrega_tarde")).first()[0])

    def score(self, df: DataFrame) -> DataFrame:
        return df.withColumn("score", F.lit(self.rate))

    def decide(self, df: DataFrame) -> DataFrame:
        return df.withColumn("pred", F.lit(int(self.rate >= 0.5)))


@dataclass(frozen=True)
class RuleBaseline:
    """Risk grows with distance (relative to the training median) and across states."""

    median_km: float

    @classmethod
    def fit(cls, train: DataFrame) -> "RuleBaseline":
        return cls(median_by(train, "dist_haversine_km").first()[0])

    def _distance(self):
        return F.coalesce("dist_haversine_km", F.lit(self.median_km))

    def score(self, df: DataFrame) -> DataFrame:
        d = self._distance()
        far = d / (d + F.lit(self.median_km) + F.lit(TINY))
        crossing = flag(F.col("mismo_estado") == 0)
        return df.withColumn("score", clip(far * DISTANCE_WEIGHT + crossing * CROSSING_WEIGHT, 0.0, 1.0))

    def decide(self, df: DataFrame) -> DataFrame:
        return df.withColumn("pred", flag((self._distance() > self.median_km) & (F.col("mismo_estado") == 0)))
