"""Sources, sinks and input checks."""

import pytest
from pyspark.sql import functions as F

from ledgerscope.operators.quality import quarantine_txn, validate_txn
from ledgerscope.sources import files as io
from ledgerscope.sources.tables import feedback_view, txn_view
from tests.conftest import SF_SMALL, day, make_txn


def test_csv_round_trip_keeps_types_and_order(spark):
    t = txn_view(spark, SF_SMALL)
    p = io.scratch_path(spark, "t-csv")
    io.write_txn_csv(t, p)
    back = io.read_txn_csv(spark, p)
    assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in t.schema]
    assert sorted(back.collect()) == sorted(t.collect())
    ts = [r.timestamp for r in back.select("timestamp").collect()]
    assert ts == sorted(ts)


def test_bank_adapter_positions_and_fallbacks(spark):
    p = io.scratch_path(spark, "t-bank")
    with open(p + ".csv", "w") as f:
        f.write("Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,"
                "Payment Currency,Payment Format,Is Laundering\n")
        f.write("2022/09/01 00:20,010,8000EBD30,010,8000EBD30,3697.34,US Dollar,3697.34,US Dollar,Reinvestment,0\n")
        f.write("2022/09/01 00:21,03208,8000F4580,001,8000F5340,0.01,US Dollar,,US Dollar,Cheque,1\n")
    a = io.adapt_bank_csv(io.read_bank_csv(spark, p + ".csv")).orderBy("transaction_id").collect()
    assert [r.transaction_id for r in a] == ["IBM0000000", "IBM0000001"]
    assert a[1].customer_id == "03208_8000F4580"  # leading zero kept, duplicate header read by position
    assert a[1].counterparty_id == "001_8000F5340"
    assert a[1].amount is None  # the paid column is read; what is missing there is quarantined, not replaced
    assert float(a[0].amount) == 3697.34 and a[1].transaction_type == "cheque" and a[1].is_laundering_ground_truth == 1
    assert a[0].country is None and str(a[0].timestamp) == "2022-09-01 00:20:00"


def test_feedback_log_skips_blank_and_malformed_lines(spark):
    p = io.scratch_path(spark, "t-fb")
    io.append_jsonl(feedback_view(spark, SF_SMALL), p)
    spark.createDataFrame([("",), ("{oops",), ('{"customer_id": "X"}',)], "value STRING").write.mode("append").text(p)
    assert io.read_feedback(spark, p).count() == feedback_view(spark, SF_SMALL).count()


def test_audit_tail_of_missing_log_is_empty(spark):
    assert io.read_audit_tail(spark, io.scratch_path(spark, "missing"), 50).count() == 0


def test_validation_first_failure_and_quarantine(spark):
    good = make_txn(spark, [("t1", "C1", day(1), 10)])
    v = validate_txn(good).collect()
    assert all(r.passed for r in v) and v[0].valid
    bad = good.select(*[F.col(c).cast("string").alias(c) for c in good.columns]).union(
        spark.createDataFrame([("t2", "C1", "ACC_C1", "not a time", "-5", "USD", "x", "y", None, None, None),
                               ("t3", "C1", "ACC_C1", "2024-01-02", "abc", "USD", "x", "y", None, None, None)],
                              ", ".join(f"{c} STRING" for c in good.columns)))
    v = {r.check: r.passed for r in validate_txn(bad).collect()}
    assert v["amount_numeric"] is False and v["amount_non_negative"] is False and v["timestamp_parse"] is False
    q = {r.transaction_id: r.reasons for r in quarantine_txn(bad).collect()}
    assert q == {"t2": ["amount_negative", "timestamp_unparseable"], "t3": ["amount_not_numeric"]}
    missing = validate_txn(good.drop("channel")).collect()
    assert missing[0].check == "required_columns" and not missing[0].valid


def test_empty_table_is_valid(spark):
    assert validate_txn(make_txn(spark, [("t1", "C1", day(1), 10)]).limit(0)).first().valid


def test_checkpoint_dir_read_from_session_or_created_when_unset(spark, tmp_path, monkeypatch):
    from ledgerscope import session as S
    assert S.checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")

    class Unset:
        def __init__(self, master):
            self.master = master

        def get(self, k, default=None):
            return self.master if k == "spark.master" else default

    class Context:
        path = None

        def getCheckpointDir(self):
            return self.path

        def setCheckpointDir(self, path):
            self.path = path

    class Session:
        def __init__(self, master):
            self.conf, self.sparkContext = Unset(master), Context()

    monkeypatch.setenv("LEDGERSCOPE_SCRATCH", str(tmp_path))
    local = Session("local[4]")
    d = S.checkpoint_dir(local)
    assert d.startswith(str(tmp_path)) and S.checkpoint_dir(local) == d
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            S.checkpoint_dir(Session(master))


def test_scratch_is_removed_through_hadoop(spark, monkeypatch):
    import os
    from ledgerscope import session as S
    monkeypatch.setattr(S, "_WRITTEN", [])
    path = S.scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert os.path.exists(path)
    S.clear_scratch(spark)
    assert not os.path.exists(path) and S._WRITTEN == []


def test_ids_are_never_cut(spark):
    from ledgerscope.functions.exprs import zero_padded
    rows = spark.createDataFrame([(7,), (9_999_999,), (10_000_000,), (123_456_789,)], "n long")
    got = [r.s for r in rows.select(zero_padded(F.col("n"), 7).alias("s")).collect()]
    assert got == ["0000007", "9999999", "10000000", "123456789"]
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").limit(2).withColumn("user_id", F.lit(100000).cast("long") + F.monotonically_increasing_id())
    from ledgerscope.sources.tables import txn_from_events
    assert {r.customer_id for r in txn_from_events(ev, spark, SF_SMALL).collect()} == {"CUST100000", "CUST100001"}


def test_split_valid_keeps_every_row_once(spark):
    from ledgerscope.operators.quality import split_valid
    from tests.test_features import nulls_txn
    txn = nulls_txn(spark)
    clean, bad = split_valid(txn)
    assert clean.count() + bad.count() == txn.count() and bad.count() > 0
    assert clean.where("transaction_id is null or customer_id is null or timestamp is null or amount is null").count() == 0


def test_csv_tree_reads_all_files(spark):
    from ledgerscope.schemas import TXN_TEXT
    root = io.scratch_path(spark, "t-tree")
    t = txn_view(spark, SF_SMALL)
    io.write_txn_csv(t.repartition(3), f"{root}/a/x")
    io.write_txn_csv(t.limit(5), f"{root}/b")
    assert io.read_csv_tree(spark, root, TXN_TEXT).count() == t.count() + 5


def test_reports_of_equal_name_stay_apart(spark):
    p = io.scratch_path(spark, "t-reports")
    io.write_reports(spark.createDataFrame([("r1", "one"), ("r1", "two"), ("r2", "a\nb")], "report_name string, content string"), p)
    assert sorted(map(tuple, io.read_reports(spark, p).collect())) == [("r1", "one"), ("r1", "two"), ("r2", "a\nb")]


def test_broadcast_needs_a_plan_bound(spark):
    import pytest as _pytest
    from ledgerscope.functions.bounded import attach_global, bounded_broadcast, max_rows
    t = txn_view(spark, SF_SMALL)
    one = t.agg(F.count(F.lit(1)).alias("n"))
    assert max_rows(one) == 1 and attach_global(t, one).count() == t.count()
    with _pytest.raises(ValueError):
        bounded_broadcast(t.groupBy("customer_id").count(), 10)


def test_exact_median_matches_numpy_for_odd_and_even_counts(spark):
    import random
    import statistics
    from ledgerscope.operators.aggregates import exact_median
    rnd = random.Random(9)
    for n in (1, 2, 7, 40, 301):
        vals = [float(rnd.randrange(1000)) for _ in range(n)]  # ties included
        df = spark.createDataFrame([(v,) for v in vals], "amount DOUBLE").repartition(5)
        assert exact_median(df, "amount").first().median == statistics.median(vals)


def test_exact_median_shuffles_only_the_values_around_the_middle(spark, monkeypatch):
    """100 000 distinct values: what is written is a few dozen of them; a value that fills the middle is one group."""
    import statistics
    from ledgerscope import session
    from ledgerscope.operators import aggregates
    written = []
    keep = session.cut_lineage
    monkeypatch.setattr(session, "cut_lineage", lambda df, *a: written.append(keep(df, *a)) or written[-1])
    df = spark.range(100_001).selectExpr("(id * 7919 % 100003) * 1.5 v")
    vals = [r.v for r in df.collect()]
    assert aggregates.exact_median(df, "v").first().median == statistics.median(vals)
    assert max(w.count() for w in written) <= 100_001 * 8 // 10_000 + 4
    hot = spark.range(60_000).selectExpr("CASE WHEN id % 3 = 0 THEN 5.0 ELSE CAST(id % 11 AS DOUBLE) END v")
    assert aggregates.exact_median(hot, "v").first().median == statistics.median([r.v for r in hot.collect()])


def test_exact_median_survives_a_sketch_that_misses(spark, monkeypatch):
    from ledgerscope.operators import aggregates
    df = spark.createDataFrame([(float(v),) for v in (9, 1, 5, 3, 7, 100)] + [(None,)], "v DOUBLE")
    for bounds in ((50.0, 60.0), (-2.0, -1.0), (9.0, 9.0), (5.0, 5.0)):
        monkeypatch.setattr(aggregates, "middle_bounds", lambda values, accuracy, b=bounds: b)
        assert aggregates.exact_median(df, "v").first().median == 6.0


AUDIT = "timestamp STRING, event_type STRING, payload STRING"


def test_audit_tail_reads_the_newest_days_only(spark):
    path = io.scratch_path(spark, "audit-tail")
    rows = [(f"2024-{m:02d}-{d:02d}T{h:02d}:00:00.000000", f"E{h}", "{}") for m in (1, 2, 3) for d in range(1, 29) for h in (1, 5)]
    events = spark.createDataFrame(rows + [(None, "undated", "{}")], AUDIT)
    io.append_audit_log(events.where("timestamp < '2024-02' or timestamp is null"), path)
    io.append_audit_log(events.where("timestamp >= '2024-02'"), path)
    want = sorted((r for r in rows), reverse=True)
    for n in (1, 2, 3, 9, 50):
        tail = io.read_audit_tail(spark, path, n)
        assert [tuple(r) for r in tail.collect()] == want[:n]
        days = {f.split("day=")[1].split("/")[0] for f in tail.inputFiles()}
        assert len(days) < max(2, 2 * n) and max(days) == "2024-03-28"
    everything = io.read_audit_tail(spark, path, 1000).collect()
    assert [tuple(r) for r in everything[:-1]] == want and everything[-1].event_type == "undated"
    assert io.log_days(spark, path)[0] == "2024-03-28" and len(io.log_days(spark, path)) == 85


def test_audit_tail_of_a_log_without_days_reads_all(spark):
    path = io.scratch_path(spark, "audit-flat")
    io.append_jsonl(spark.createDataFrame([(f"2024-01-0{i}", "E", "{}") for i in range(1, 6)], AUDIT), path)
    assert [r.timestamp for r in io.read_audit_tail(spark, path, 2).collect()] == ["2024-01-05", "2024-01-04"]


def test_appended_lines_arrive_once_across_restarts(spark, tmp_path, monkeypatch):
    from ledgerscope.sources import lines
    from ledgerscope.streaming.jobs import run_available_now
    log, out = tmp_path / "log", str(tmp_path / "out")
    log.mkdir()

    def run():
        run_available_now(lines.appended_lines(spark, str(log), ".jsonl"), out, str(tmp_path / "c"))
        return sorted((r.file, r.position, r.value) for r in spark.read.schema("value string, file string, position long").parquet(out).collect())

    def want():  # whole lines only
        found = []
        for p in log.glob("*.jsonl"):
            at = 0
            for line in p.read_bytes().split(b"\n")[:-1]:
                found.append((p.name, at, line.removesuffix(b"\r").decode()))
                at += len(line) + 1
        return sorted(found)

    a, b = log / "a.jsonl", log / "b.jsonl"
    a.write_bytes(b"one\ntwo\r\n\nthree, still being wri")
    assert run() == want() and len(want()) == 3
    with a.open("ab") as f:
        f.write("tten é\nfour\n".encode())
    b.write_text("x\n" * 40)
    (log / "other.txt").write_text("not read\n")
    assert run() == want() and ("a.jsonl", 10, "three, still being written é") in want()
    assert run() == want()  # nothing new
    with b.open("a") as f:
        f.write("no line end")
    assert run() == want() and len(want()) == 45


def test_appended_lines_parts_meet_at_line_ends(tmp_path, monkeypatch):
    """Every part size gives each line once, whatever the read step."""
    from ledgerscope.sources import lines
    p = tmp_path / "l.jsonl"
    text = [("w" * (i * 7 % 23)) + str(i) for i in range(60)]
    p.write_text("\n".join(text) + "\nunfinished")
    for part in (1, 2, 5, 17, 64, 10_000):
        for step in (3, 50, 100_000):
            monkeypatch.setattr(lines, "PART_BYTES", part)
            monkeypatch.setattr(lines, "STEP_BYTES", step)
            reader = lines.AppendedLinesReader(str(tmp_path), "")
            end = reader.latestOffset()
            got = [v for q in reader.partitions(reader.initialOffset(), end) for v, _, _ in reader.read(q)]
            assert got == text
            half = {k: len("\n".join(text[:30])) + 1 for k in end}
            assert [v for q in reader.partitions(half, end) for v, _, _ in reader.read(q)] == text[30:]
    with pytest.raises(ValueError):
        reader.partitions({k: n + 1 for k, n in end.items()}, end)


def test_live_alerts_of_a_missing_log_are_none_then_all(spark, tmp_path):
    from ledgerscope.streaming.jobs import run_available_now
    path, out = str(tmp_path / "alerts.jsonl"), str(tmp_path / "o")
    run = lambda: run_available_now(io.alert_stream(spark, path), out, str(tmp_path / "c"))
    run()
    with open(path, "w") as f:
        f.write('{"timestamp": "t1", "customer_id": "C1", "amount": 5.0}\n\n{broken\n')
    run()
    got = [r.customer_id for r in spark.read.parquet(out).collect()]
    assert sorted(got, key=str) == ["C1", None]
