"""Isolation forest invariants, feedback tuning, evaluation, query-log tagging."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from ledgerscope.operators.aggregates import eval_binary
from ledgerscope.operators.feedback import tune_threshold
from ledgerscope.operators.forest import collect_forest, detect_anomaly, explain_forest, fit_forest, forest_scores, path_lengths, score_forest
from ledgerscope.operators.querylog import filter_in_domain, tag_queries
from ledgerscope.operators.scoring import minmax_scale
from ledgerscope.params import Params


def _customers(spark, n=60, outlier=True):
    rows = []
    for i in range(n):
        base = 100.0 + (i % 7)
        rows.append((f"C{i:03d}", base, base * 2, base * 10, 3.0, base * 20, 1.0 + (i % 3) * 0.1, 10.0))
    if outlier:
        rows.append(("OUT", 90000.0, 200000.0, 900000.0, 40.0, 1e6, 9.0, 0.01))
    return spark.createDataFrame(rows, "customer_id STRING, amount_mean DOUBLE, amount_max DOUBLE, amount_sum DOUBLE, "
                                       "max_rolling_7d_count DOUBLE, max_rolling_30d_sum DOUBLE, max_zscore DOUBLE, "
                                       "min_velocity_hours DOUBLE")


def test_forest_flags_planted_outlier_and_is_partition_invariant(spark):
    cf = _customers(spark)
    hits = {r.customer_id: r for r in detect_anomaly(cf).collect()}
    assert "OUT" in hits and hits["OUT"].ml_score == 1.0
    assert set(hits["OUT"].attribution) == {"amount_mean", "amount_max", "amount_sum", "max_rolling_7d_count",
                                            "max_rolling_30d_sum", "max_zscore", "min_velocity_hours"}
    a = score_forest(cf, fit_forest(cf)).toPandas().set_index("customer_id").raw_score
    b = score_forest(cf.repartition(7), fit_forest(cf.repartition(3))).toPandas().set_index("customer_id").raw_score
    assert (a - b.loc[a.index]).abs().max() < 1e-12
    s = minmax_scale(score_forest(cf, fit_forest(cf)), "raw_score").toPandas().score
    assert s.min() == 0.0 and s.max() == 1.0


def _set_value(tree, row, chosen, node=0, depth=0):
    """Path length when the splits on ``chosen`` follow the row and the others go both ways by their sampled rows."""
    f = int(tree["feature"][node])
    if f < 0:
        return depth + tree["leaf_c"][node]
    left, right = int(tree["left"][node]), int(tree["right"][node])
    if f in chosen:
        return _set_value(tree, row, chosen, left if row[f] < tree["threshold"][node] else right, depth + 1)
    share = tree["size"][left] / tree["size"][node]
    return share * _set_value(tree, row, chosen, left, depth + 1) + (1 - share) * _set_value(tree, row, chosen, right, depth + 1)


def test_attribution_is_the_shapley_value_of_every_subset(spark):
    rng = np.random.default_rng(3)
    names = ["amount_mean", "amount_max", "amount_sum", "max_rolling_7d_count", "max_rolling_30d_sum", "max_zscore", "min_velocity_hours"]
    x = np.round(rng.lognormal(size=(80, 7)), 1)  # rounded: ties with thresholds' neighbours and constant sub-samples
    x[:3] = np.nan
    rows = [(f"C{i:02d}", *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    cf = spark.createDataFrame(rows, "customer_id STRING, " + ", ".join(f"{n} DOUBLE" for n in names))
    p = Params(forest_trees=5, forest_sample=32)
    trees = collect_forest(fit_forest(cf.na.drop(), params=p), p)
    got = {r.customer_id: r for r in explain_forest(score_forest(cf, trees, params=p), trees, params=p).collect()}
    assert len(got) == 80
    for i in (0, 3, 11, 40, 79):
        value = {s: np.mean([_set_value(t, x[i], s) for t in trees]) for k in range(8) for s in map(frozenset, itertools.combinations(range(7), k))}
        r = got[f"C{i:02d}"]
        assert abs(r.expected_path - value[frozenset()]) < 1e-9 and abs(r.path_length - value[frozenset(range(7))]) < 1e-9
        for f, name in enumerate(names):
            want = sum(math.factorial(len(s)) * math.factorial(6 - len(s)) / math.factorial(7) * (value[s | {f}] - v) for s, v in value.items() if f not in s)
            assert abs(r.shapley[name] - want) < 1e-9 and abs(r.attribution[name] - abs(want)) < 1e-9
    for r in got.values():
        assert abs(sum(r.shapley.values()) - (r.path_length - r.expected_path)) < 1e-9


def test_only_hits_are_explained_and_the_planted_one_by_its_features(spark):
    scores = {r.customer_id: r for r in forest_scores(_customers(spark), Params()).collect()}
    assert all((r.attribution is not None) == (r.score >= Params().ml_score_threshold) for r in scores.values())
    out = detect_anomaly(_customers(spark)).where("customer_id = 'OUT'").first()
    assert out.attribution == scores["OUT"].attribution and min(out.attribution.values()) > 0
    assert path_lengths([], np.zeros((2, 7))).tolist() == [0.0, 0.0]


def test_a_feature_without_effect_has_no_attribution(spark):
    """Of features that are constant no split is made; the old split shares would still be zero, but a copy shares its part."""
    rows = [(f"C{i:03d}", float(i % 10), float(i % 10), 5.0, 1.0, 1.0, 1.0, 1.0) for i in range(60)] + [("OUT", 900.0, 900.0, 5.0, 1.0, 1.0, 1.0, 1.0)]
    cf = spark.createDataFrame(rows, _customers(spark).schema)
    hit = detect_anomaly(cf).where("customer_id = 'OUT'").first().attribution
    assert hit["amount_sum"] == hit["max_zscore"] == 0.0 and hit["amount_mean"] > 0 and hit["amount_max"] > 0


def test_few_customers_are_marked_not_dropped(spark):
    few = detect_anomaly(_customers(spark, 3)).collect()
    assert [r.customer_id for r in few] == ["OUT"] and not few[0].enough_customers
    assert detect_anomaly(_customers(spark)).where("enough_customers").count() >= 1


def test_tune_threshold_branches(spark):
    def fb(tp, fp):
        rows = [("t", "C", "True Positive", "s")] * tp + [("t", "C", "False Positive", "s")] * fp + [("t", "C", "x", "s")]
        return spark.createDataFrame(rows, "timestamp STRING, customer_id STRING, feedback STRING, session_id STRING")
    assert tune_threshold(fb(1, 3), 0.6).first().new_threshold == 0.65
    assert tune_threshold(fb(10, 0), 0.6).first().new_threshold == 0.55
    assert tune_threshold(fb(5, 1), 0.6).first().new_threshold == 0.6
    assert tune_threshold(fb(0, 5), 0.88).first().new_threshold == 0.9
    assert tune_threshold(fb(0, 0), 0.6).first().action == "no_feedback"


def test_eval_binary_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label INT, prediction INT")
    r = eval_binary(df).first()
    assert (r.precision, r.recall, r.f1_score, r.tn) == (0.0, 0.0, 0.0, 2)


def test_query_tagging(spark):
    q = spark.createDataFrame([(t,) for t in [
        "Find structuring patterns in the last 30 days", "Which customers made 10+ transactions under $10,000?",
        "Is customer ID 4521 suspicious?", "Is customer ID CUST999999 suspicious?", "Tell me about transaction trends",
        "What's the weather today?", "CUST4521 transactions"]], "text STRING")
    r = {x.text: x for x in tag_queries(q).collect()}
    f = r["Find structuring patterns in the last 30 days"]
    assert (f.intent_type, f.target_pattern, f.last_n_days) == ("pattern_search", "structuring", 30)
    a = r["Which customers made 10+ transactions under $10,000?"]
    assert (a.intent_type, a.min_transaction_count, a.amount_threshold) == ("aggregation_query", 10, 10000.0)
    assert (r["Is customer ID 4521 suspicious?"].intent_type, r["Is customer ID 4521 suspicious?"].entity_id) == \
        ("entity_lookup", "CUST4521")
    assert r["Is customer ID CUST999999 suspicious?"].entity_id == "CUST999999"  # matched by the 'cust' branch
    t = r["Tell me about transaction trends"]
    assert (t.intent_type, t.requires_full_eda, t.requires_ml_detection) == ("broad_exploration", True, True)
    assert r["What's the weather today?"].intent_type == "out_of_domain"
    long = tag_queries(spark.createDataFrame([("customer 1234567?",), ("customer 12, customer id: 77001",)], "text STRING")).collect()
    assert [x.entity_id for x in long] == [None, "CUST77001"]  # an id is never cut to six digits
    c = r["CUST4521 transactions"]
    assert (c.intent_type, c.min_transaction_count) == ("aggregation_query", 4521)  # kept order effect
    kept = {x.text for x in filter_in_domain(q).collect()}
    assert "What's the weather today?" not in kept and len(kept) == 6


def test_backtest_metrics_document(spark):
    from ledgerscope.operators.backtest import backtest_metrics
    sup = eval_binary(spark.createDataFrame([(1, 1), (0, 1), (1, 0), (0, 0)], "label INT, prediction INT"))
    uns = eval_binary(spark.createDataFrame([(1, 1), (0, 0)], "label INT, prediction INT"))
    doc = backtest_metrics(sup, uns).first()
    assert doc.supervised_model.precision == 0.5 and doc.supervised_model.confusion_matrix == [[1, 1], [1, 1]]
    assert doc.unsupervised_model.f1_score == 1.0 and doc.total_test_samples == 4 and doc.illicit_cases_in_test == 2


def test_forest_sample_is_exact_size_above_cutoff(spark):
    cf = _customers(spark, 2000, outlier=False)
    nodes = fit_forest(cf, params=Params(forest_trees=12))
    sizes = {r.tree_id: r.sample_size for r in nodes.select("tree_id", "sample_size").distinct().collect()}
    assert len(sizes) == 12 and set(sizes.values()) == {256}
    roots = nodes.filter("node_id = 0").select("size").collect()
    assert all(r.size == 256 for r in roots)
