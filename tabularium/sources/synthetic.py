"""A synthetic cohort with the columns of the registry's first model; for demonstration only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.functions.expressions import logistic

#: Effects on the logit of the outcome (fixed values); age counts from 69.
EFFECTS = {"tension": 0.85, "feeling_depressed": 0.70, "loss_appetite": 0.45, "vomiting": 0.40, "ECOG": 0.25, "antidepressants": -0.45, "brain_metastases": 0.35}
AGE_EFFECT, NOISE, INTERCEPT = 0.03, 0.6, -2.4

#: Columns in order: low and high of an integer, or "severity", 0 to 3 with more zeros (fixed values).
COLUMNS: dict[str, tuple[int, int] | str] = {
    "age": "age", "gender": (1, 2), "ECOG": (0, 4), "living_situation": (0, 3), "pal_care_service": (0, 3), "brain_metastases": (0, 1),
    "pain": "severity", "nausea": "severity", "vomiting": "severity", "dyspnea": "severity", "constipation": "severity", "weakness": "severity",
    "loss_appetite": "severity", "tiredness": "severity", "assistance_adl": (0, 3), "antidepressants": (0, 1), "sedatives_anxiolytics": (0, 1),
    "corticosteroids": (0, 1), "feeling_depressed": "severity", "tension": "severity", "disorientation_confusion": "severity",
}


def generate(spark: SparkSession, n: int = 600, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """``n`` rows; each column draws from a seed of its own."""
    seeds = iter(range(seed * 1000, seed * 1000 + 999))

    def between(low: int, high: int) -> Column:
        return (F.floor(F.rand(next(seeds)) * (high - low + 1)) + low).cast("int")

    def column(kind: tuple[int, int] | str) -> Column:
        if kind == "age":
            return F.round(F.greatest(F.lit(19.0), F.least(F.lit(105.0), 69 + 12 * F.randn(next(seeds)))), 1)
        if kind == "severity":
            return F.when(F.rand(next(seeds)) > 0.6, F.lit(0)).otherwise(between(0, 3)).cast("int")
        return between(*kind)

    drawn = spark.range(0, n, 1, partitions).select(*[column(k).alias(c) for c, k in COLUMNS.items()])
    logit = F.lit(INTERCEPT) + AGE_EFFECT * (F.col("age") - 69) + NOISE * F.randn(next(seeds))
    for name, effect in EFFECTS.items():
        logit = logit + effect * F.col(name)
    return drawn.withColumn("anxiety", F.when(F.rand(next(seeds)) < logistic(logit), between(1, 3)).otherwise(0).cast("int"))
