"""Risk of an event from its detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.functions import vocabulary as V
from murmur.functions.scalars import rounded, severity


def score_events(detections: DataFrame, tiers: DataFrame, *, key: list[str], ord_col: str = "ord") -> DataFrame:
    """A row an event: risk_score, severity, dominant_class, guards, and the parts of the score.

    Detections (key, class_id, confidence, ord) below the confidence floor or of a class without a tier do not count,
    and leave the guard ``confidence_floor``.  The score is the greatest weight times confidence, 1 at most; severity
    is told by it before rounding.  Where the clearest detection, the first of equals, is of the Negative tier and no
    other tier alerts, severity is LOW and the guard ``group_b_block`` is left.  The terms for combinations and
    context are 0 by definition.  tiers is a taxonomy, a row a class, and small enough to be sent to every task.
    """
    d = detections.join(F.broadcast(tiers.select("class_id", "tier", "weight")), "class_id", "left")
    usable = (F.col("confidence") >= V.CONFIDENCE_FLOOR) & F.col("tier").isNotNull()
    clear = F.when(usable, F.struct("confidence", -F.col(ord_col)))
    agg = d.groupBy(*key).agg(
        F.count("*").alias("n_detections"),
        F.count_if(usable).alias("n_usable"),
        F.coalesce(F.max(F.when(usable, F.col("weight") * F.col("confidence"))), F.lit(0.0)).alias("max_weighted"),
        F.max_by(F.struct("class_id", "tier"), clear).alias("dominant"),
        F.coalesce(F.bool_or(usable & (F.col("tier") != "Negative") & (F.col("confidence") >= V.GROUP_A_ALERT)), F.lit(False)).alias("alerting"),
    )
    score = F.least(F.lit(1.0), F.col("max_weighted"))
    blocked = F.coalesce((F.col("dominant.tier") == "Negative") & ~F.col("alerting"), F.lit(False))
    guards = F.array_compact(F.array(F.when(F.col("n_usable") < F.col("n_detections"), "confidence_floor"), F.when(blocked, "group_b_block")))
    return agg.select(
        *key, "n_detections", "n_usable", rounded(score, 4).alias("risk_score"), F.when(blocked, "LOW").otherwise(severity(score)).alias("severity"),
        F.col("dominant.class_id").alias("dominant_class"), guards.alias("guards"), rounded("max_weighted", 4).alias("max_weighted"), F.lit(0.0).alias("combo"), F.lit(0.0).alias("ctx"),
    )
