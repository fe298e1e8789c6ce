"""Registered queries: isolation forest, attribution, backtests, broad pipeline (rows-only checks)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerscope.functions.bounded import attach_global

from ledgerscope.operators.aggregates import agg_customer_features, agg_summary, eval_binary
from ledgerscope.operators.backtest import (backtest_metrics, backtest_unsupervised, split_features,
                                            train_supervised)
from ledgerscope.operators.consensus import compute_consensus
from ledgerscope.operators.features import compute_features
from ledgerscope.operators.filters import label_ground_truth
from ledgerscope.operators.forest import collect_forest, detect_anomaly, explain_forest, fit_forest, forest_scores, rank_attribution, score_forest
from ledgerscope.operators.scoring import minmax_scale
from ledgerscope.plans.pipelines import decide_consensus, flagship_items, model_evidence
from ledgerscope.plans.q_core import FIX, SUBS
from ledgerscope.plans.registry import register
from ledgerscope.plans.sqlviews import STRUCTURING_CTE, TXN_CTE, with_ctes
from ledgerscope.schemas import RULE_HIT
from ledgerscope.session import cut_lineage
from ledgerscope.sources.files import scratch_path, write_metrics
from ledgerscope.sources.tables import txn_view


def _hits(spark, sf):
    txn = txn_view(spark, sf)
    return txn, detect_anomaly(agg_customer_features(compute_features(txn, FIX)), FIX)


@register("detect_anomaly")
def q_detect_anomaly(spark, sf):
    """Isolation-forest hits per customer (score, tags)."""
    return _hits(spark, sf)[1].select("customer_id", "ml_score", "anomaly_flag",
                                      F.array_join("top_features", ",").alias("top_features"))


@register("anomaly_attribution")
def q_anomaly_attribution(spark, sf):
    """Per flagged customer and feature, the absolute contribution."""
    h = _hits(spark, sf)[1]
    return h.select("customer_id", F.explode("attribution").alias("feature", "contribution"))


@register("rank_attribution")
def q_rank_attribution(spark, sf):
    return rank_attribution(_hits(spark, sf)[1])


@register("pipeline_broad")
def q_pipeline_broad(spark, sf):
    """Summary + features + forest -> consensus (no rules) -> risk -> action -> explanation, with tags and attribution."""
    txn, ml = _hits(spark, sf)
    ml = cut_lineage(ml)
    no_rules = spark.createDataFrame([], RULE_HIT)
    cons = compute_consensus(no_rules, ml)
    out = decide_consensus(cons, model_evidence(txn, ml), FIX)
    out = out.join(ml.select("customer_id", F.array_join("top_features", ",").alias("top_features"), "attribution"), "customer_id", "left")
    summary = agg_summary(txn)  # one row, attached to each item
    return attach_global(out, summary).select(
        "customer_id", "agreement", "verdict", "pattern_matched", "risk_score", "risk_level", "recommended_action",
        "confidence", "evidence_count", "explanation", "top_features", F.to_json("attribution").alias("attribution"),
        "total_transactions", "median_amount")


@register("pipeline_broad_facts", with_ctes("""SELECT count(*) AS total_transactions, round(median(CAST(amount AS DOUBLE)), 2) AS median_amount,
  true AS evidence_is_all_rows, true AS score_decides FROM txn""", TXN_CTE))
def q_pipeline_broad_facts(spark, sf):
    """What must hold of the broad run: the summary, the evidence of each item, and a risk score that is the model's own."""
    items = cut_lineage(q_pipeline_broad(spark, sf))
    txn = txn_view(spark, sf)
    own = txn.groupBy("customer_id").agg(F.count(F.lit(1)).alias("rows"))
    held = items.join(own, "customer_id", "left").agg(
        F.coalesce(F.bool_and(F.col("evidence_count") == F.col("rows")), F.lit(True)).alias("evidence_is_all_rows"),
        F.coalesce(F.bool_and((F.col("agreement") == "Disagreement") & (F.col("risk_score") >= 100 * FIX.ml_score_threshold - 0.05)), F.lit(True)).alias("score_decides"))
    return attach_global(agg_summary(txn).select("total_transactions", "median_amount"), held)


def _forest_run(spark, sf):
    return flagship_items(txn_view(spark, sf), FIX, lambda customers: forest_scores(customers, FIX))


@register("flagship_forest")
def q_flagship_forest(spark, sf):
    """Rules and forest in one run: items with agreement, tags and attribution."""
    return _forest_run(spark, sf)[0].withColumn("attribution", F.to_json("attribution"))


@register("flagship_forest_rules", with_ctes("SELECT customer_id, rule_score FROM hits", TXN_CTE, STRUCTURING_CTE, **SUBS))
def q_flagship_forest_rules(spark, sf):
    """The rule side of the run with the forest: every structuring hit is an item, whatever the model says."""
    return _forest_run(spark, sf)[0].where("agreement <> 'Disagreement'").select("customer_id", "rule_score")


@register("detect_anomaly_facts", with_ctes("""SELECT count(DISTINCT customer_id) AS customers, 100 AS trees,
  CAST(100 * least(256, count(DISTINCT customer_id)) AS BIGINT) AS sampled, 0.0 AS lowest, 1.0 AS highest FROM txn""", TXN_CTE))
def q_detect_anomaly_facts(spark, sf):
    """What must hold of any forest run: one score a customer from 0 to 1, the trees, and the rows they were grown on."""
    customers = cut_lineage(agg_customer_features(compute_features(txn_view(spark, sf), FIX)))
    nodes = cut_lineage(fit_forest(customers, None, FIX))
    trees = nodes.groupBy("tree_id").agg(F.max("sample_size").alias("n")).agg(
        F.count(F.lit(1)).cast("int").alias("trees"), F.sum("n").cast("long").alias("sampled"))
    scored = minmax_scale(score_forest(customers, nodes, None, FIX), "raw_score", "score")
    s = scored.agg(F.count_distinct("customer_id").alias("customers"), F.min("score").alias("lowest"), F.max("score").alias("highest"))
    return attach_global(s, trees).select("customers", "trees", "sampled", "lowest", "highest")


def _explained(spark, sf):
    """Every customer, hit or not, with score, path and attribution."""
    customers = cut_lineage(agg_customer_features(compute_features(txn_view(spark, sf), FIX)))
    trees = collect_forest(fit_forest(customers, None, FIX), FIX)
    return explain_forest(score_forest(customers, trees, None, FIX), trees, None, FIX)


@register("rank_attribution_facts", with_ctes("SELECT r::INTEGER AS rank, (SELECT count(DISTINCT customer_id) FROM txn) AS customers, true AS falling "
                                              "FROM range(1, 8) AS x(r)", TXN_CTE))
def q_rank_attribution_facts(spark, sf):
    """Every customer has all seven features, ranked 1 to 7 by falling contribution."""
    ranked = rank_attribution(_explained(spark, sf))
    before = F.lag("contribution").over(Window.partitionBy("customer_id").orderBy("rank"))
    return ranked.withColumn("ok", F.coalesce(before >= F.col("contribution"), F.lit(True))).groupBy("rank").agg(
        F.count_distinct("customer_id").alias("customers"), F.bool_and("ok").alias("falling"))


@register("anomaly_attribution_facts", with_ctes(
    "SELECT count(DISTINCT customer_id) AS customers, count(DISTINCT customer_id) AS efficient, 1 AS expectations FROM txn", TXN_CTE))
def q_anomaly_attribution_facts(spark, sf):
    """Efficiency: each customer's signed parts sum to its path length less the expectation, which is the same for all."""
    parts = F.aggregate(F.map_values("shapley"), F.lit(0.0), lambda a, v: a + v)
    exact = F.abs(parts - (F.col("path_length") - F.col("expected_path"))) < 1e-9
    return _explained(spark, sf).agg(F.count_distinct("customer_id").alias("customers"), F.count_if(exact).alias("efficient"),
                                     F.count_distinct("expected_path").cast("int").alias("expectations"))


def _split(spark, sf):
    return split_features(label_ground_truth(txn_view(spark, sf)), FIX)


@register("train_supervised")
def q_train_supervised(spark, sf):
    """Boosted trees on the 70 % split; metrics on the 30 % test rows."""
    return eval_binary(train_supervised(_split(spark, sf)))


@register("backtest_unsupervised")
def q_backtest_unsupervised(spark, sf):
    return backtest_unsupervised(_split(spark, sf), FIX)


# The labelled test rows: the last 30 % by customer and time.
_TEST_ROWS = """(SELECT * FROM (
  SELECT customer_id, transaction_id, CAST(amount AS DOUBLE) AS amount, coalesce((amount >= 9000.0 AND amount < 10000.0 AND transaction_type = 'cash_deposit')
           OR (amount > 50000.0 AND transaction_type = 'transfer'), false) AS y,
         row_number() OVER (ORDER BY customer_id, timestamp, transaction_id) AS i, count(*) OVER () AS n FROM txn) WHERE i > floor(n * 0.7))"""


@register("train_supervised_facts", with_ctes(f"""SELECT customer_id, count(*) AS rows, count(*) FILTER (WHERE y) AS labelled, round(sum(amount), 2) AS amount,
  true AS predicted_once FROM {_TEST_ROWS} t GROUP BY customer_id""", TXN_CTE))
def q_train_supervised_facts(spark, sf):
    """The seeded model's predictions by customer: every test row once, with its label, and predictions of 0 or 1."""
    split = cut_lineage(_split(spark, sf))
    pred = train_supervised(split).join(split.select("transaction_id", F.col("amount").cast("double").alias("amount")), "transaction_id")
    return pred.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("label") == 1).alias("labelled"), F.round(F.sum("amount"), 2).alias("amount"),
        ((F.count_distinct("transaction_id") == F.count(F.lit(1))) & F.bool_and(F.col("prediction").isin(0, 1))).alias("predicted_once"))


@register("backtest_unsupervised_facts", with_ctes(f"""SELECT count(*) AS total, count(*) FILTER (WHERE y) AS labelled, true AS whole_customers FROM {_TEST_ROWS} t""", TXN_CTE))
def q_backtest_unsupervised_facts(spark, sf):
    """The confusion counts add up to the labelled test rows, and rows predicted 1 are those of whole flagged customers."""
    split = cut_lineage(_split(spark, sf))
    test = split.where("not is_train")
    hits = cut_lineage(detect_anomaly(agg_customer_features(test), FIX).select("customer_id"))
    flagged = test.join(hits, "customer_id", "left_semi").agg(F.count(F.lit(1)).alias("flagged"))
    r = attach_global(backtest_unsupervised(split, FIX), flagged)
    return r.select(F.col("total_samples").alias("total"), F.col("positives").alias("labelled"), (F.col("tp") + F.col("fp") == F.col("flagged")).alias("whole_customers"))


_BACKTEST_SQL = with_ctes("""SELECT count(*) AS total_test_samples, sum(y) AS illicit_cases_in_test, CAST(2 AS BIGINT) AS models FROM (
  SELECT CAST(coalesce((amount >= 9000.0 AND amount < 10000.0 AND transaction_type = 'cash_deposit')
           OR (amount > 50000.0 AND transaction_type = 'transfer'), false) AS BIGINT) AS y,
         row_number() OVER (ORDER BY customer_id, timestamp, transaction_id) AS i, count(*) OVER () AS n FROM txn) x
WHERE i > floor(n * 0.7)""", TXN_CTE)


@register("backtest_document", _BACKTEST_SQL)
def q_backtest_document(spark, sf):
    """The results document of both models, written as JSON and read back: the counts that any model must report."""
    split = cut_lineage(_split(spark, sf))
    document = backtest_metrics(eval_binary(train_supervised(split, "forest")), backtest_unsupervised(split, FIX))
    p = scratch_path(spark, "backtest")
    write_metrics(document, p)
    back = spark.read.schema(document.schema).json(p)
    models = F.size(F.filter(F.array("supervised_model.precision", "unsupervised_model.precision"), lambda x: x.between(0, 1)))
    return back.select("total_test_samples", "illicit_cases_in_test", models.cast("long").alias("models"))
