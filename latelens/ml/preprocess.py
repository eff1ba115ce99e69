"""Feature preparation fitted on the training part only.

Numbers: fill with the exact median, then standardise with the population deviation.
Categories: fill with the most frequent value, then one indicator per frequent level;
levels below the frequency limit share one indicator; unseen levels get zeros.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latelens.operators.quantiles import long_form, medians_of
from latelens.operators.staging import stage
from latelens.schemas import CATEGORICAL_FEATURES, NUMERIC_FEATURES

MIN_FREQUENCY = 0.01  # so a column keeps at most 100 levels of its own


def numeric_profile(train: DataFrame, columns: list[str] = NUMERIC_FEATURES) -> DataFrame:
    """Per numeric column: exact median, then mean and deviation of the filled values."""
    medians = stage(medians_of(train, columns, [f"__m_{c}" for c in columns]), "medians")
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col(f"__m_{c}")) for c in columns}
    one = train.crossJoin(F.broadcast(medians)).agg(  # one row
        *[F.first(f"__m_{c}").alias(f"__m_{c}") for c in columns],
        *[F.avg(v).alias(f"__a_{c}") for c, v in filled.items()],
        *[F.stddev_pop(v).alias(f"__d_{c}") for c, v in filled.items()],
    )
    cells = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"__m_{c}").alias("median"), F.col(f"__a_{c}").alias("mean"),
                 F.col(f"__d_{c}").alias("deviation")) for c in columns
    ])
    return one.select(F.inline(cells)).where("median is not null")  # a column without any value has none


def category_levels(
    train: DataFrame, columns: list[str] = CATEGORICAL_FEATURES, min_frequency: float = MIN_FREQUENCY
) -> DataFrame:
    """Levels of each category column after filling, and whether they keep an indicator."""
    counts = stage(
        long_form(train, columns, "string").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")),
        "levels",
    )
    # Most frequent value, the smallest of equals.
    modes = counts.where("value is not null").groupBy("column_name").agg(
        F.min_by("value", F.struct((-F.col("n")).alias("rank"), F.col("value"))).alias("mode")
    )
    filled = counts.join(F.broadcast(modes), "column_name").groupBy(  # one row per category column
        "column_name", F.coalesce("value", "mode").alias("value")
    ).agg(F.sum("n").alias("n"), F.first("mode").alias("mode"))
    totals = counts.groupBy("column_name").agg(F.sum("n").alias("__all"))
    return filled.join(F.broadcast(totals), "column_name").select(
        "column_name", "value", "n", (F.col("n") / F.col("__all")).alias("share"),
        (F.col("n") >= F.lit(min_frequency) * F.col("__all")).alias("kept"),
        (F.col("value") == F.col("mode")).alias("is_mode"),
    )


@dataclass
class Preprocessor:
    """Learned parameters; the rare levels stay in a table because their number is open."""

    numbers: dict[str, dict[str, float]]
    modes: dict[str, str]
    kept: dict[str, list[str]]
    has_rare: dict[str, bool]
    names: list[str] = field(default_factory=list)
    rare: DataFrame | None = None

    @classmethod
    def fit(cls, train: DataFrame, numeric=NUMERIC_FEATURES, categorical=CATEGORICAL_FEATURES) -> "Preprocessor":
        profile = {r["column_name"]: r for r in numeric_profile(train, numeric).collect()}
        numbers = {
            c: {k: profile[c][k] for k in ("median", "mean", "deviation")}
            for c in numeric if c in profile  # a column without any value has no median
        }
        levels = stage(category_levels(train, categorical), "category_levels")
        # At most 100 kept levels and one mode per column come to the driver.
        own = levels.where("kept or is_mode").orderBy("column_name", "value").collect()
        modes = {r["column_name"]: r["value"] for r in own if r["is_mode"]}
        kept = {c: [r["value"] for r in own if r["column_name"] == c and r["kept"]] for c in modes}
        rare = levels.where("not kept").select("column_name", "value")
        with_rare = {r[0] for r in rare.select("column_name").distinct().collect()}
        kept = {c: kept[c] for c in categorical if c in kept}
        names = [f"num__{c}" for c in numbers]
        for c, values in kept.items():
            names += [f"cat__{c}_{v}" for v in values] + ([f"cat__{c}_infrequent"] if c in with_rare else [])
        return cls(numbers, modes, kept, {c: c in with_rare for c in kept}, names, rare)

    def groups(self) -> list[tuple[int, int]]:
        """(first place, length) of each category column's indicators in the vector."""
        out, place = [], len(self.numbers)
        for c, values in self.kept.items():
            size = len(values) + self.has_rare[c]
            if size:
                out.append((place, size))
            place += size
        return out

    def transform(self, df: DataFrame, output: str = "features") -> DataFrame:
        """Add the feature vector; only columns with rare levels need a (small) lookup."""
        columns = []
        for c, p in self.numbers.items():
            scale = p["deviation"] or 1.0
            columns.append((F.coalesce(F.col(c).cast("double"), F.lit(p["median"])) - p["mean"]) / scale)
        for c, values in self.kept.items():
            filled = F.coalesce(F.col(c).cast("string"), F.lit(self.modes[c]))
            columns += [(filled == v).cast("double") for v in values]
            if self.has_rare[c]:
                lookup = self.rare.where(F.col("column_name") == c).select(F.col("value").alias(f"__rare_{c}"))
                df = df.join(lookup, filled == F.col(f"__rare_{c}"), "left")
                columns.append(F.col(f"__rare_{c}").isNotNull().cast("double"))
        inputs = [f"__f{i}" for i in range(len(columns))]
        wide = df.select("*", *[e.alias(n) for e, n in zip(columns, inputs)])
        vectors = VectorAssembler(inputCols=inputs, outputCol=output).transform(wide)
        return vectors.drop(*inputs, *[f"__rare_{c}" for c in self.kept])

    def save(self, spark: SparkSession, path: str) -> None:
        state = {k: getattr(self, k) for k in ("numbers", "modes", "kept", "has_rare", "names")}
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").json(f"{path}/state")
        self.rare.write.mode("overwrite").parquet(f"{path}/rare_levels")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Preprocessor":
        state = json.loads(spark.read.schema("state string").json(f"{path}/state").first()[0])
        rare = spark.read.schema("column_name string, value string").parquet(f"{path}/rare_levels")
        return cls(**state, rare=rare)
