"""Feedback-driven threshold tuning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.bounded import attach_global

from ledgerscope.operators.aggregates import agg_feedback


def tune_threshold(feedback: DataFrame, current: DataFrame | float = 0.6) -> DataFrame:
    """New model threshold from analyst verdicts.

    False-positive ratio > 0.5 -> min(0.9, t + 0.05); < 0.1 -> max(0.1, t - 0.05);
    otherwise, or without verdicts, unchanged; 3 dp. ``current`` is a number or a
    one-row table with ``ml_score_threshold`` (e.g. the stored override).
    """
    fb = agg_feedback(feedback)
    cur = current if isinstance(current, DataFrame) else fb.sparkSession.range(1).select(
        F.lit(float(current)).alias("ml_score_threshold"))
    t = F.col("ml_score_threshold")
    r = F.col("fp_ratio")
    new = (F.when(r.isNull(), t).when(r > 0.5, F.least(F.lit(0.9), t + 0.05))
            .when(r < 0.1, F.greatest(F.lit(0.1), t - 0.05)).otherwise(t))
    return (attach_global(fb, cur.select("ml_score_threshold"))
            .select("true_positives", "false_positives", "total", F.round(r, 6).alias("fp_ratio"),
                    t.alias("previous_threshold"), F.round(new, 3).alias("new_threshold"),
                    F.when(r.isNull(), "no_feedback").when(r > 0.5, "raise").when(r < 0.1, "lower")
                     .otherwise("keep").alias("action")))


def params_from_override(override: DataFrame | None, defaults: dict[str, float]) -> DataFrame:
    """One-row parameter table: values of the override file where present, else defaults."""
    if override is None:
        raise ValueError("override table required; pass an empty table for defaults")
    cols = []
    for name, val in defaults.items():
        src = F.max(F.col(name).cast("double")) if name in override.columns else F.lit(None).cast("double")
        cols.append(F.coalesce(src, F.lit(float(val))).alias(name))
    return override.agg(*cols)
