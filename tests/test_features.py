"""Feature windows: half-open frames, ties, velocity, z-score; sliced windows equal a brute force."""

import random
import statistics

from pyspark.sql import functions as F

from ledgerscope.operators.features import compute_features, daily_txn_count, rolling_features
from ledgerscope.params import Params
from tests.conftest import day, make_txn


def brute(rows, days_short=7, days_long=30):
    out = {}
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    for cid, rs in by.items():
        amts = [float(r[3]) for r in rs]
        mean = statistics.mean(amts)
        std = statistics.stdev(amts) if len(amts) > 1 else None
        std = 1.0 if not std else std
        srt = sorted(rs, key=lambda r: (r[2], r[0]))
        prev = None
        for r in srt:
            t = r[2]
            c7 = sum(1 for x in rs if t - __import__("datetime").timedelta(days=days_short) < x[2] <= t)
            s30 = sum(float(x[3]) for x in rs if t - __import__("datetime").timedelta(days=days_long) < x[2] <= t)
            vel = 9999.0 if prev is None else (t - prev).total_seconds() / 3600.0
            prev = t
            out[r[0]] = (c7, round(s30, 2), round(vel, 6), round((float(r[3]) - mean) / (std + 1e-6), 6))
    return out


def check(df, rows):
    exp = brute(rows)
    got = {r.transaction_id: (r.rolling_7d_count, round(r.rolling_30d_sum, 2),
                              round(r.velocity_hours_since_last_txn, 6), round(r.amount_zscore_vs_customer_avg, 6))
           for r in df.collect()}
    assert got == exp


def test_boundaries_and_ties(spark):
    rows = [("a1", "C1", day(0), 100), ("a2", "C1", day(7), 200), ("a3", "C1", day(7), 300),
            ("a4", "C1", day(7), 50), ("a5", "C1", day(14), 10), ("b1", "C2", day(3), 9000),
            ("c1", "C3", day(1), 5), ("c2", "C3", day(31), 5), ("c3", "C3", day(60, 23), 5)]
    f = compute_features(make_txn(spark, rows))
    assert f.count() == len(rows)
    check(f, rows)
    d = {r.transaction_id: r for r in f.collect()}
    assert d["a2"].rolling_7d_count == 3  # t-7d itself is outside the frame, all peers inside
    assert d["b1"].velocity_hours_since_last_txn == 9999.0
    assert d["b1"].is_just_under_threshold and not d["a1"].is_just_under_threshold
    assert d["c1"].amount_zscore_vs_customer_avg == 0.0  # constant amounts: std -> 1


def test_slices_match_brute_force_with_hot_customer(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(600):
        cid = "HOT" if i % 3 == 0 else f"C{rnd.randrange(20)}"
        rows.append((f"t{i:04d}", cid, day(rnd.randrange(120), rnd.randrange(24)), rnd.randrange(1, 20000)))
    txn = make_txn(spark, rows)
    check(compute_features(txn), rows)
    # many small slices (5 context copies per row) give the same answer
    check(compute_features(txn, Params(time_slice_days=6.5)), rows)


def test_ties_ordered_matches_index_rolling(spark):
    rows = [("o1", "C1", day(1), 10), ("o2", "C1", day(8), 10), ("o3", "C1", day(8), 10), ("o4", "C1", day(8), 10),
            ("o5", "C1", day(15), 10)]
    r = rolling_features(make_txn(spark, rows), 7, ties="ordered")
    got = [x.rolling_count for x in r.orderBy("transaction_id").collect()]
    assert got == [1, 1, 2, 3, 1]  # the pandas index-rolling result for d1, d8, d8, d8, d15
    rows = [("o1", "C1", day(1), 1), ("o2", "C1", day(1), 2), ("o3", "C1", day(1), 4)]
    for strategy in ("slices", "prefix"):
        r = rolling_features(make_txn(spark, rows), 7, Params(rolling_strategy=strategy), ties="ordered").orderBy("transaction_id").collect()
        assert [x.rolling_sum for x in r] == [1, 3, 7] and [x.rolling_avg for x in r] == [1, 1.5, 7 / 3]


def test_daily_count(spark):
    rows = [("x1", "C1", day(1, 1), 1), ("x2", "C1", day(1, 23), 1), ("x3", "C1", day(2), 1)]
    got = {r.transaction_id: r.daily_txn_count for r in daily_txn_count(make_txn(spark, rows)).collect()}
    assert got == {"x1": 2, "x2": 2, "x3": 1}


def test_one_exchange_for_all_windows(spark):
    rows = [("a1", "C1", day(0), 100), ("a2", "C1", day(7), 200)]
    f = compute_features(make_txn(spark, rows)).select("rolling_7d_count", "rolling_30d_sum",
                                                       "velocity_hours_since_last_txn")
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window") >= 1
    windows = [ln for ln in plan.splitlines() if "Window [" in ln]
    assert all("_slice" in ln for ln in windows)


def test_prefix_strategy_matches_brute_force_for_a_dense_hot_customer(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(450):
        cid = "HOT" if i % 3 == 0 else f"C{rnd.randrange(12)}"
        rows.append((f"p{i:04d}", cid, day(rnd.randrange(75), rnd.randrange(4) * 6), rnd.randrange(1, 20000)))
    txn = make_txn(spark, rows)
    check(compute_features(txn, Params(rolling_strategy="prefix", time_slice_days=0.25)), rows)
    feats = compute_features(txn, Params(rolling_strategy="prefix"), structuring_count=True)
    base = compute_features(txn, Params(rolling_strategy="slices"), structuring_count=True)
    assert sorted(feats.select("transaction_id", "structuring_window_count").collect()) == \
        sorted(base.select("transaction_id", "structuring_window_count").collect())


def nulls_txn(spark):
    """Null ids, amounts, times and customers among ordinary rows."""
    from ledgerscope.schemas import TXN
    from pyspark.sql import types as T
    from decimal import Decimal
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in TXN.fields])
    rnd = random.Random(5)
    rows = []
    for i in range(160):
        rows.append((None if i % 9 == 0 else f"n{i:03d}", None if i % 31 == 0 else f"C{i % 4}", "A",
                     None if i % 17 == 0 else day(rnd.randrange(50), rnd.randrange(3) * 8), None if i % 5 == 0 else Decimal(rnd.randrange(1, 20000)),
                     "USD", "deposit", "branch", None, None, None))
    rows += [("z1", "EMPTY", "A", day(1), None, "USD", "deposit", "branch", None, None, None)]
    return spark.createDataFrame(rows, schema)


def test_nulls_give_the_same_values_under_both_strategies(spark):
    txn = nulls_txn(spark)
    one = compute_features(txn, Params(rolling_strategy="slices"), structuring_count=True)
    for slice_days in (None, 0.5):
        two = compute_features(txn, Params(rolling_strategy="prefix", time_slice_days=slice_days), structuring_count=True)
        cols = [c for c in one.columns if c != "velocity_hours_since_last_txn"]  # rows tied on time and null id have no order
        rounded = lambda d: sorted((repr([round(x, 6) if isinstance(x, float) else x for x in r]) for r in d.select(*cols).collect()))
        assert rounded(one) == rounded(two)
    assert one.count() == txn.count() and one.where("rolling_30d_sum is null or rolling_7d_count < 1").count() == 0
    a, b = (sorted(map(repr, rolling_features(txn, 7, Params(rolling_strategy=s)).select("transaction_id", "rolling_count", "rolling_sum").collect()))
            for s in ("slices", "prefix"))
    assert a == b and len(a) == txn.count()


def test_zscore_of_null_amounts_agrees_with_customer_stats(spark):
    from ledgerscope.operators.features import customer_amount_stats
    txn = nulls_txn(spark).where("customer_id is not null")
    stats = {r.customer_id: r for r in customer_amount_stats(txn).collect()}
    for r in compute_features(txn).collect():
        if r.amount is not None:
            s = stats[r.customer_id]
            assert abs(r.amount_zscore_vs_customer_avg - (float(r.amount) - s.amount_mean) / (s.amount_std + 1e-6)) < 1e-9


def test_rolling_features_and_bursts_same_under_both_strategies(spark):
    from ledgerscope.operators.features import burst_24h
    rnd = random.Random(4)
    rows = [(f"r{i:03d}", "HOT" if i % 2 else f"C{i % 5}", day(rnd.randrange(20), rnd.randrange(24)), 100 + i)
            for i in range(200)]
    txn = make_txn(spark, rows)
    a = rolling_features(txn, 7, Params(rolling_strategy="slices"))
    b = rolling_features(txn, 7, Params(rolling_strategy="prefix"))
    cols = ["transaction_id", "rolling_count", "rolling_sum", "rolling_avg"]
    assert sorted(a.select(*cols).collect()) == sorted(b.select(*cols).collect())
    assert sorted(burst_24h(txn, 4, Params(rolling_strategy="slices")).collect()) == \
        sorted(burst_24h(txn, 4, Params(rolling_strategy="prefix")).collect())


def test_a_rolling_sum_costs_one_running_total_a_row(spark):
    """60 000 rows of one customer within a frame (1.8 billion pairs): running totals, the same as counted by hand."""
    import time

    from ledgerscope.operators.windows import US_PER_DAY, rolling_sums
    from ledgerscope.params import Params
    n = 60_000
    df = spark.range(n).selectExpr("'C' customer_id", "timestamp_seconds(id * 20) ts", "concat('t', id) id", "CAST(id % 3 AS DECIMAL(18,2)) amount")
    day = US_PER_DAY
    began = time.time()
    got = rolling_sums(df, ["customer_id"], "ts", "id", [("n", 7 * day, F.lit(1)), ("s", 30 * day, F.col("amount"))], Params()).selectExpr(
        "count(*) rows", "sum(n) n", "sum(s) s").first()
    took = time.time() - began
    a = 7 * 86_400 // 20
    assert (got["rows"], got["n"]) == (n, sum(min(i + 1, a) for i in range(n)))
    assert int(got["s"]) == sum((n - i) * (i % 3) for i in range(n)) and took < 30


def test_running_totals_equal_frames_with_ties_nulls_and_edges(spark):
    from ledgerscope.operators.windows import US_PER_DAY, rolling_sums
    from ledgerscope.params import Params
    rnd, day = random.Random(5), US_PER_DAY
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, *range(-4, 75)]), f"t{i}", rnd.choice([None, 0, 7, -3])) for i in range(400)]
    df = spark.createDataFrame(rows, "k STRING, d INT, id STRING, v INT").selectExpr("k", "timestamp_seconds(d * 43200) ts", "id", "CAST(v AS DECIMAL(9,2)) v")
    for slices in (None, 3, 10):
        p = Params(time_slice_days=slices)
        got = {r.id: (r.n, float(r.s), r.f) for r in rolling_sums(df, ["k"], "ts", "id", [
            ("n", 2 * day, F.lit(1)), ("s", 7 * day, F.col("v")), ("f", 7 * day, F.col("v").cast("double"))], p).collect()}
        for k, d, i, _ in rows:
            def frame(length):
                return [v or 0 for k2, d2, _, v in rows if k2 == k and ((d is None and d2 is None) or (
                    d is not None and d2 is not None and d - 2 * length < d2 <= d))]
            assert got[i] == (len(frame(2)), sum(frame(7)), sum(frame(7)))
