"""Supervised and unsupervised backtests on labelled transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.bounded import attach_global

from ledgerscope.operators.aggregates import agg_customer_features, eval_binary, win_train_split
from ledgerscope.operators.features import compute_features
from ledgerscope.operators.forest import detect_anomaly
from ledgerscope.params import DEFAULT_PARAMS, Params

SUPERVISED_FEATURES = ["amount", "rolling_7d_count", "rolling_30d_sum", "amount_zscore_vs_customer_avg",
                       "velocity_hours_since_last_txn"]


def split_features(labelled_txn: DataFrame, params: Params = DEFAULT_PARAMS, frac: float = 0.7) -> DataFrame:
    """Features with the positional 70/30 split (sorted by customer, time)."""
    f = compute_features(labelled_txn, params)
    return win_train_split(f, frac)


def train_supervised(split: DataFrame, model: str = "gbt", label: str = "is_laundering_ground_truth") -> DataFrame:
    """Boosted trees (100 x depth 4, seed 42) or a random forest (50 trees) on five features.

    Returns test rows with ``label`` and ``prediction``. Training is
    ``pyspark.ml``: distributed over the training rows.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    data = split.select("transaction_id", "customer_id", "is_train", F.col(label).cast("double").alias("label"),
                        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in SUPERVISED_FEATURES])
    asm = VectorAssembler(inputCols=SUPERVISED_FEATURES, outputCol="features")
    clf = (GBTClassifier(maxIter=100, maxDepth=4, seed=42) if model == "gbt"
           else RandomForestClassifier(numTrees=50, seed=42))
    fitted = Pipeline(stages=[asm, clf]).fit(data.filter("is_train"))
    test = data.filter(~F.col("is_train"))
    return fitted.transform(test).select("transaction_id", "customer_id", F.col("label").cast("int").alias("label"),
                                         F.col("prediction").cast("int").alias("prediction"))


def backtest_unsupervised(split: DataFrame, params: Params = DEFAULT_PARAMS,
                          label: str = "is_laundering_ground_truth") -> DataFrame:
    """Forest on the test split; every row of a flagged customer is predicted 1; metrics as ``eval_binary``."""
    test = split.filter(~F.col("is_train"))
    hits = detect_anomaly(agg_customer_features(test), params).select("customer_id").withColumn("_h", F.lit(1))
    pred = (test.join(hits, "customer_id", "left")
            .select(F.col(label).cast("int").alias("label"), F.coalesce("_h", F.lit(0)).alias("prediction")))
    return eval_binary(pred)


def backtest_metrics(supervised_eval: DataFrame, unsupervised_eval: DataFrame) -> DataFrame:
    """The nested results document: one row, two metric structs."""
    s = supervised_eval.select(F.struct(F.lit("Gradient-boosted trees").alias("model_type"), "precision", "recall",
                                        "f1_score", F.array(F.array("tn", "fp"), F.array("fn", "tp"))
                                        .alias("confusion_matrix")).alias("supervised_model"),
                               F.col("total_samples").alias("total_test_samples"),
                               F.col("positives").alias("illicit_cases_in_test"))
    u = unsupervised_eval.select(F.struct(F.lit("Isolation forest").alias("model_type"), "precision", "recall",
                                          "f1_score").alias("unsupervised_model"))
    return attach_global(s, u)
