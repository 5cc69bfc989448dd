"""Model features and scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.constants import BANDS, BANDS_BY_RESOLUTION, MODEL_BANDS
from skysift.functions import radiometry as R
from skysift.operators.grid import block_keys
from skysift.operators.resample import block_sums

FEATURES = tuple(b.lower() for b in BANDS)
MODEL_FEATURES = tuple(b.lower() for b in MODEL_BANDS)
# Demonstration coefficients of the closed-form score; not a trained model.
LOGIT_INTERCEPT = -1.25
LOGIT_WEIGHTS = {
    "b01": 0.8, "b02": 2.0, "b04": 1.5, "b05": -0.5, "b08": 0.25, "b8a": -0.75, "b09": 1.0, "b10": 40.0, "b11": -1.5, "b12": 0.6,
}


def feature_stack(px10: DataFrame, px20: DataFrame, px60: DataFrame, offset: float, quantification: float) -> DataFrame:
    """All bands on the 60 m grid in instrument order: block mean, then clipped at 0.

    Each resolution is reduced inside its block and the three are joined there.
    """
    out = None
    for table, resolution in ((px10, 10), (px20, 20), (px60, 60)):
        bands = [b.lower() for b in BANDS_BY_RESOLUTION[resolution]]
        factor = 60 // resolution
        keys = ["scene_id", *block_keys(table), "y", "x"]
        sums = block_sums(table.select(*keys, *bands), bands, factor) if factor > 1 else table.select(*keys, *bands)
        n = float(factor * factor)
        refl = sums.select(*keys, *[
            R.clip_reflectance(((F.col(b) / F.lit(n) + F.lit(offset)) / F.lit(quantification)).cast("float")).alias(b) for b in bands])
        out = refl if out is None else out.join(refl, keys)
    kept = [c for c in out.columns if c not in FEATURES]
    return out.select(*kept, *FEATURES)


def check_order(df: DataFrame, expected: Sequence[str] = FEATURES) -> None:
    """The stack must hold the bands in the order the model was built for."""
    found = [c for c in df.columns if c in set(expected)]
    if found != list(expected):
        raise ValueError(f"bands are in the order {found}, expected {list(expected)}")


def logit_probability(shift: float = 0.0) -> Column:
    """Closed-form score over the model bands; ``shift`` is added to each reflectance."""
    z = F.lit(LOGIT_INTERCEPT)
    for band, weight in LOGIT_WEIGHTS.items():
        z = z + F.lit(weight) * (F.col(band).cast("double") + F.lit(shift))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def train_cloud_model(labelled: DataFrame, label: str, trees: int = 10, depth: int = 4) -> GBTClassificationModel:
    """Boosted trees on the model bands, trained by Spark on labelled pixels."""
    rows = labelled.select(*MODEL_FEATURES, F.col(label).cast("double").alias("label"))
    assembled = VectorAssembler(inputCols=list(MODEL_FEATURES), outputCol="features").transform(rows)
    return GBTClassifier(maxIter=trees, maxDepth=depth, seed=7).fit(assembled.select("features", "label"))


def cloud_probability(model: GBTClassificationModel, stack: DataFrame) -> DataFrame:
    """Adds ``prob``, the probability of cloud, to every row of a feature stack."""
    check_order(stack)
    assembled = VectorAssembler(inputCols=list(MODEL_FEATURES), outputCol="features").transform(stack)
    scored = model.transform(assembled)
    return scored.withColumn("prob", vector_to_array("probability")[1].cast("float")).drop(
        "features", "rawPrediction", "probability", "prediction")


def offset_drift(stack: DataFrame, threshold: float, shift: float = 0.1) -> DataFrame:
    """Share flagged with the radiometric offset applied and with it left out."""
    n = F.count(F.lit(1))
    return stack.groupBy("scene_id").agg(
        (F.lit(100.0) * F.count_if(logit_probability() > threshold) / n).alias("with_offset"),
        (F.lit(100.0) * F.count_if(logit_probability(shift) > threshold) / n).alias("without_offset"))
