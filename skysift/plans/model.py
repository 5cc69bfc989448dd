"""Feature and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysift.constants import BANDS_BY_RESOLUTION
from skysift.functions import radiometry as R
from skysift.operators import cells as E
from skysift.operators import model as D
from skysift.plans import fixtures as X
from skysift.plans.registry import query
from skysift.plans.scalars import KEY
from skysift.session import cut_lineage

I = X._idiv


def _means(src: str, resolution: int) -> str:
    f = 60 // resolution
    cols = ", ".join(f"greatest(cast((sum({b.lower()}) / {f * f}e0 + -1000e0) / 10000e0 as float), cast(0 as float)) as {b.lower()}" for b in BANDS_BY_RESOLUTION[resolution])
    return f"(select scene_id, {I('y', f)} as y, {I('x', f)} as x, {cols} from {src} group by all)"


STACK = f"stack13 as (select * from {_means('px10', 10)} join {_means('px20', 20)} using (scene_id, y, x) join {_means('px60', 60)} using (scene_id, y, x))"


def _logit(shift: str) -> str:
    z = repr(D.LOGIT_INTERCEPT) + "e0" + "".join(f" + {w!r}e0 * (cast({b} as double) + {shift})" for b, w in D.LOGIT_WEIGHTS.items())
    return f"(1e0 / (1e0 + exp(-({z}))))"


def stack(spark, sf):
    return E.feature_stack(X.cells10(spark, sf), X.cells20(spark, sf), X.px60(spark, sf, placed=True), X.OFFSET, X.QUANT)


@query("feature_stack", X.sql("select scene_id, y, x, " + ", ".join(f"cast({b} as double) as {b}" for b in D.FEATURES) + " from stack13", STACK))
def feature_stack(spark, sf):
    out = stack(spark, sf)
    D.check_order(out)
    return out.drop("brow", "bcol")


@query("logit_probability", X.sql(f"select scene_id, y, x, round({_logit('0e0')}, 9) as prob from stack13", STACK))
def logit_probability(spark, sf):
    return stack(spark, sf).select(*KEY, F.round(D.logit_probability(), 9).alias("prob"))


@query("offset_drift", X.sql(
    f"select scene_id, 1e2 * count(*) filter ({_logit('0e0')} > 0.6e0) / count(*) as with_offset, 1e2 * count(*) filter ({_logit('0.1e0')} > 0.6e0) / count(*) as without_offset from stack13 group by scene_id", STACK))
def offset_drift(spark, sf):
    """Leaving out the offset shifts every reflectance by 0.1."""
    return D.offset_drift(stack(spark, sf), 0.6)


@query("cloud_probability")
def cloud_probability(spark, sf):
    """Boosted trees trained on the class mask and applied to every pixel.

    No SQL equivalent: the model is fitted iteratively.
    """
    features = cut_lineage(stack(spark, sf), "features")
    labelled = features.join(
        X.px60(spark, sf, placed=True).select(*KEY, "brow", "bcol", R.class_union(F.col("opaque"), F.col("cirrus")).alias("ref")),
        ["scene_id", "brow", "bcol", "y", "x"])
    model = D.train_cloud_model(labelled, "ref", trees=5, depth=3)
    scored = D.cloud_probability(model, features)
    return scored.select(*KEY, R.encode_prob24(F.col("prob")).alias("code"))
