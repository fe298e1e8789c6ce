"""Registered queries: sources, sinks and input checks (write to the shared scratch folder, read back)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerscope.operators.aggregates import eval_binary
from ledgerscope.operators.feedback import params_from_override, tune_threshold
from ledgerscope.operators.filters import label_ground_truth
from ledgerscope.operators.quality import quarantine_txn, validate_txn
from ledgerscope.plans.registry import register
from ledgerscope.plans.sqlviews import TXN_CTE, with_ctes
from ledgerscope.schemas import TXN_TEXT
from ledgerscope.sources import files as io
from ledgerscope.sources.tables import feedback_view, table, txn_view

_TXN_OUT_SQL = ("SELECT transaction_id, customer_id, CAST(timestamp AS TIMESTAMP) AS timestamp, "
                "CAST(amount AS DOUBLE) AS amount, transaction_type, counterparty_id, country FROM txn")


def _txn_out(df):
    return df.select("transaction_id", "customer_id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
                     F.col("amount").cast("double").alias("amount"), "transaction_type", "counterparty_id", "country")


@register("src_txn_csv", with_ctes(_TXN_OUT_SQL, TXN_CTE))
def q_src_txn_csv(spark, sf):
    p = io.scratch_path(spark, "txn-csv")
    io.write_txn_csv(txn_view(spark, sf), p)
    return _txn_out(io.read_txn_csv(spark, p))


@register("src_txn_parquet", with_ctes(_TXN_OUT_SQL, TXN_CTE))
def q_src_txn_parquet(spark, sf):
    p = io.scratch_path(spark, "txn-parquet")
    txn_view(spark, sf).write.mode("overwrite").parquet(p)
    return _txn_out(io.read_txn_parquet(spark, p))


@register("sink_txn_csv", with_ctes(
    "SELECT transaction_id, CAST(amount AS VARCHAR) AS amount, coalesce(counterparty_id, '') AS counterparty_id "
    "FROM txn", TXN_CTE))
def q_sink_txn_csv(spark, sf):
    p = io.scratch_path(spark, "txn-csv-raw")
    io.write_txn_csv(txn_view(spark, sf), p)
    raw = spark.read.option("header", True).csv(p)  # all columns as text
    return raw.select("transaction_id", "amount", F.coalesce("counterparty_id", F.lit("")).alias("counterparty_id"))


@register("src_csv_capped", with_ctes(
    "SELECT transaction_id, CAST(amount AS DOUBLE) AS amount FROM txn", TXN_CTE))
def q_src_csv_capped(spark, sf):
    """All rows of a tree of CSV files (the key keeps its name; nothing is cut)."""
    root = io.scratch_path(spark, "csv-tree")
    t = txn_view(spark, sf)
    io.write_txn_csv(t.filter(F.col("transaction_type").eqNullSafe("fee")), f"{root}/a/fees")
    io.write_txn_csv(t.filter(~F.col("transaction_type").eqNullSafe("fee")), f"{root}/b/rest")
    return io.typed_txn(io.read_csv_tree(spark, root, TXN_TEXT)).select("transaction_id", F.col("amount").cast("double").alias("amount"))


def _bank_fixture(spark, sf):
    """Bank-benchmark layout rows from ``txn`` (stand-in input; the adapter does the work)."""
    t = label_ground_truth(txn_view(spark, sf))
    return t.orderBy("transaction_id").select(
        F.date_format("timestamp", "yyyy/MM/dd HH:mm").alias("Timestamp"), F.lit("010").alias("From Bank"),
        F.expr("substring(customer_id, 5)").alias("Account"), F.lit("020").alias("To Bank"),
        F.expr("coalesce(substring(counterparty_id, 9), substring(customer_id, 5))").alias("Account2"),
        F.col("amount").cast("string").alias("Amount Received"), F.lit("US Dollar").alias("Receiving Currency"),
        F.when(F.col("channel") == "atm", F.lit(None)).otherwise(F.col("amount").cast("string")).alias("Amount Paid"),
        F.lit("US Dollar").alias("Payment Currency"), F.initcap("channel").alias("Payment Format"),
        F.col("is_laundering_ground_truth").cast("string").alias("Is Laundering"))


_BANK_SQL = with_ctes("""SELECT 'IBM' || printf('%07d', row_number() OVER (ORDER BY transaction_id) - 1)
    AS transaction_id, '010_' || substr(customer_id, 5) AS customer_id, substr(customer_id, 5) AS account_id,
  CAST(strftime(CAST(timestamp AS TIMESTAMP), '%Y-%m-%d %H:%M') || ':00' AS TIMESTAMP) AS timestamp,
  CASE WHEN channel = 'atm' THEN NULL ELSE CAST(amount AS DOUBLE) END AS amount, 'US Dollar' AS currency, channel AS transaction_type,
  '020_' || coalesce(substr(counterparty_id, 9), substr(customer_id, 5)) AS counterparty_id,
  CAST(coalesce((amount >= 9000.0 AND amount < 10000.0 AND transaction_type = 'cash_deposit')
    OR (amount > 50000.0 AND transaction_type = 'transfer'), false) AS INTEGER) AS is_laundering_ground_truth
FROM txn""", TXN_CTE)


@register("adapt_bank_csv", _BANK_SQL)
def q_adapt_bank_csv(spark, sf):
    p = io.scratch_path(spark, "bank-csv")
    _bank_fixture(spark, sf).write.mode("overwrite").option("header", True).csv(p)
    a = io.adapt_bank_csv(io.read_bank_csv(spark, p))
    return a.select("transaction_id", "customer_id", "account_id",
                    F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
                    F.col("amount").cast("double").alias("amount"), "currency", "transaction_type",
                    "counterparty_id", "is_laundering_ground_truth")


def _audit(spark, sf):
    ev = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    p = io.scratch_path(spark, "audit")
    io.append_jsonl(io.audit_events(ev, "event_type", ["event_id", "value", "props"], "ts"), p)
    return p


@register("sink_audit_jsonl", """SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, event_type,
  event_id, props FROM events""")
def q_sink_audit_jsonl(spark, sf):
    p = _audit(spark, sf)
    a = spark.read.schema("timestamp STRING, event_type STRING, payload STRING").json(p)
    return a.select("timestamp", "event_type", F.get_json_object("payload", "$.event_id").cast("long").alias("event_id"),
                    F.get_json_object("payload", "$.props").alias("props"))


@register("src_audit_tail", """SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, event_type FROM events
  ORDER BY ts DESC LIMIT 50""")
def q_src_audit_tail(spark, sf):
    """The last events of a log with a folder a day, of which the newest are read."""
    ev = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    p = io.scratch_path(spark, "audit-days")
    io.append_audit_log(io.audit_events(ev, "event_type", ["event_id", "value", "props"], "ts"), p)
    return io.read_audit_tail(spark, p, 50).select("timestamp", "event_type")


_FEEDBACK_SQL = ("SELECT 'CUST' || printf('%05d', doc_id) AS customer_id, "
                 "CASE WHEN quality = 1 THEN 'True Positive' ELSE 'False Positive' END AS feedback, "
                 "'S' || CAST(doc_id AS VARCHAR) AS session_id FROM labels")


@register("sink_feedback_jsonl", _FEEDBACK_SQL)
def q_sink_feedback(spark, sf):
    p = io.scratch_path(spark, "feedback")
    io.append_jsonl(feedback_view(spark, sf), p)
    return spark.read.schema("timestamp STRING, customer_id STRING, feedback STRING, session_id STRING").json(p) \
        .select("customer_id", "feedback", "session_id")


@register("src_feedback_jsonl", _FEEDBACK_SQL)
def q_src_feedback(spark, sf):
    p = io.scratch_path(spark, "feedback-log")
    io.append_jsonl(feedback_view(spark, sf), p)
    # A later writer appends blank and malformed lines to the same log.
    spark.createDataFrame([("",), ("{not json",), ('{"customer_id": "X"}',)], "value STRING") \
        .write.mode("append").text(p)
    return io.read_feedback(spark, p).select("customer_id", "feedback", "session_id")


def _alerts(spark, sf):
    t = txn_view(spark, sf).filter(F.col("amount") > 10000)
    alerts = t.select(F.date_format("timestamp", io.TS_FORMAT).alias("timestamp"), "customer_id",
                      F.lit("STREAM_ALERT").alias("event_type"), F.col("amount").cast("double").alias("amount"),
                      F.lit("Sudden volume spike detected in stream").alias("reason"))
    p = io.scratch_path(spark, "alerts")
    io.append_jsonl(alerts, p)
    return io.read_alerts(spark, p)


_ALERT_SQL = ("SELECT strftime(CAST(timestamp AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, customer_id, "
              "CAST(amount AS DOUBLE) AS amount FROM txn WHERE amount > 10000")


@register("src_alert_stream", with_ctes(f"SELECT count(*) AS alerts, count(DISTINCT customer_id) AS customers "
                                        f"FROM ({_ALERT_SQL}) a", TXN_CTE))
def q_src_alert_stream(spark, sf):
    a = _alerts(spark, sf)
    return a.agg(F.count(F.lit(1)).alias("alerts"), F.count_distinct("customer_id").alias("customers"))


@register("src_alert_stream_live", with_ctes(_ALERT_SQL, TXN_CTE))
def q_src_alert_stream_live(spark, sf):
    """The alert log read as a live stream, started after each of two deliveries on one checkpoint; every line arrives once."""
    from ledgerscope.streaming.jobs import run_available_now
    t = txn_view(spark, sf).filter(F.col("amount") > 10000)
    alerts = t.select(F.date_format("timestamp", io.TS_FORMAT).alias("timestamp"), "customer_id", F.lit("STREAM_ALERT").alias("event_type"),
                      F.col("amount").cast("double").alias("amount"), F.lit("Sudden volume spike detected in stream").alias("reason"))
    log, out = io.scratch_path(spark, "alert-log"), io.scratch_path(spark, "alerts-live")
    early = F.dayofmonth(F.to_timestamp("timestamp")) <= 15
    for part in (alerts.where(early), alerts.where(~early)):
        io.append_jsonl(part, log)
        run_available_now(io.alert_stream(spark, log), f"{out}/data", f"{out}/_checkpoint")
    return spark.read.parquet(f"{out}/data").select("timestamp", "customer_id", "amount")


@register("latest_alerts", with_ctes(f"{_ALERT_SQL} ORDER BY timestamp DESC, customer_id LIMIT 20", TXN_CTE))
def q_latest_alerts(spark, sf):
    return io.latest_alerts(_alerts(spark, sf), 20).select("timestamp", "customer_id", "amount")


_REPORT_SQL = ("SELECT 'SAR_' || customer_id || '_1706745600' AS report_name, printf(" + "'"
               + io.REPORT_TEMPLATE.replace("'", "''") + "'"
               + ", '2024-02-01 00:00:00', customer_id, customer_id, coalesce(session_id, 'N/A')) AS content FROM ("
               + _FEEDBACK_SQL + ") f WHERE feedback = 'True Positive'")


@register("sink_report_text", f"SELECT report_name, content, length(content) AS n_chars FROM ({_REPORT_SQL}) r")
def q_sink_report_text(spark, sf):
    """The report documents, written and read back."""
    p = io.scratch_path(spark, "report-sink")
    io.write_reports(io.report_texts(feedback_view(spark, sf)), p)
    return spark.read.parquet(p).select("report_name", "content", F.length("content").cast("long").alias("n_chars"))


@register("fn_report_text", _REPORT_SQL.replace("SELECT 'SAR_' || customer_id || '_1706745600' AS report_name,",
                                                 "SELECT customer_id,"))
def q_fn_report_text(spark, sf):
    return io.report_texts(feedback_view(spark, sf)).select("customer_id", "content")


@register("src_report_list", _REPORT_SQL)
def q_src_report_list(spark, sf):
    p = io.scratch_path(spark, "reports")
    io.write_reports(io.report_texts(feedback_view(spark, sf)), p)
    return io.read_reports(spark, p)


_PRED = """SELECT CAST(coalesce((amount >= 9000.0 AND amount < 10000.0 AND transaction_type = 'cash_deposit')
    OR (amount > 50000.0 AND transaction_type = 'transfer'), false) AS INTEGER) AS label,
  CASE WHEN amount >= 8000.0 THEN 1 ELSE 0 END AS prediction FROM txn"""


@register("sink_metrics_json", with_ctes("""SELECT round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 3)
  AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 3) AS recall, tn + fp + fn + tp AS total
FROM (SELECT count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn, count(*) FILTER (WHERE label = 0 AND
  prediction = 1) AS fp, count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn, count(*) FILTER (WHERE
  label = 1 AND prediction = 1) AS tp FROM p)""", TXN_CTE, f"p AS ({_PRED})"))
def q_sink_metrics_json(spark, sf):
    t = label_ground_truth(txn_view(spark, sf))
    pred = t.select(F.col("is_laundering_ground_truth").alias("label"),
                    F.when(F.col("amount") >= 8000.0, 1).otherwise(0).alias("prediction"))
    m = eval_binary(pred).select(F.struct("precision", "recall", "total_samples").alias("model"))
    p = io.scratch_path(spark, "metrics")
    io.write_metrics(m, p)
    back = spark.read.json(p)
    return back.select(F.col("model.precision").alias("precision"), F.col("model.recall").alias("recall"),
                       F.col("model.total_samples").alias("total"))


_TUNE_SQL = """SELECT tp AS true_positives, fpc AS false_positives, tp + fpc AS total,
  CASE WHEN tp + fpc > 0 THEN round(fpc / (tp + fpc), 6) END AS fp_ratio, 0.6 AS previous_threshold,
  round(CASE WHEN tp + fpc = 0 THEN 0.6 WHEN fpc / (tp + fpc) > 0.5 THEN least(0.9, 0.6 + 0.05)
             WHEN fpc / (tp + fpc) < 0.1 THEN greatest(0.1, 0.6 - 0.05) ELSE 0.6 END, 3) AS new_threshold,
  CASE WHEN tp + fpc = 0 THEN 'no_feedback' WHEN fpc / (tp + fpc) > 0.5 THEN 'raise'
       WHEN fpc / (tp + fpc) < 0.1 THEN 'lower' ELSE 'keep' END AS action
FROM (SELECT count(*) FILTER (WHERE {confirmed}) AS tp, count(*) FILTER (WHERE NOT ({confirmed})) AS fpc FROM labels) c"""


@register("tune_threshold", _TUNE_SQL.format(confirmed="quality = 1"))
def q_tune_threshold(spark, sf):
    return tune_threshold(feedback_view(spark, sf), 0.6)


def _verdicts(spark, sf, confirmed):
    """All labels as verdicts, confirmed by another column than quality."""
    verdict = F.when(confirmed, F.lit("True Positive")).otherwise(F.lit("False Positive"))
    return table(spark, sf, "labels").select(F.lit("2024-02-01T00:00:00").alias("timestamp"), F.col("doc_id").cast("string").alias("customer_id"),
                                             verdict.alias("feedback"), F.lit("S").alias("session_id"))


@register("tune_threshold_toxic", _TUNE_SQL.format(confirmed="toxic = 1"))
def q_tune_threshold_toxic(spark, sf):
    """All verdicts, confirmed where toxic: mostly false positives, so the threshold rises."""
    return tune_threshold(_verdicts(spark, sf, F.col("toxic") == 1), 0.6)


@register("tune_threshold_confirmed", _TUNE_SQL.format(confirmed="quality = 1 OR toxic = 0"))
def q_tune_threshold_confirmed(spark, sf):
    """All verdicts, confirmed where of quality or not toxic: few false positives, so the threshold falls."""
    return tune_threshold(_verdicts(spark, sf, (F.col("quality") == 1) | (F.col("toxic") == 0)), 0.6)


@register("params_override", """SELECT round(CASE WHEN tp + fpc = 0 THEN 0.6 WHEN fpc / (tp + fpc) > 0.5 THEN 0.65
  WHEN fpc / (tp + fpc) < 0.1 THEN 0.55 ELSE 0.6 END, 3) AS ml_score_threshold, 10000.0 AS structuring_threshold
FROM (SELECT count(*) FILTER (WHERE quality = 1) AS tp, count(*) FILTER (WHERE quality <> 1) AS fpc FROM labels) c""")
def q_params_override(spark, sf):
    t = tune_threshold(feedback_view(spark, sf), 0.6)
    p = io.scratch_path(spark, "params")
    t.select(F.col("new_threshold").alias("ML_ANOMALY_SCORE_THRESHOLD")).coalesce(1).write.mode("overwrite").json(p)
    ov = spark.read.json(p).withColumnRenamed("ML_ANOMALY_SCORE_THRESHOLD", "ml_score_threshold")
    return params_from_override(ov, {"ml_score_threshold": 0.6, "structuring_threshold": 10000.0})


_VALIDATE_SQL = with_ctes("""SELECT check_order, "check", passed, message, bool_and(passed) OVER () AS valid FROM (
  SELECT 1 AS check_order, 'required_columns' AS "check", true AS passed, '' AS message
  UNION ALL SELECT 2, 'critical_transaction_id', count(transaction_id) > 0 OR count(*) = 0,
    'Critical column ''transaction_id'' is entirely null.' FROM txn
  UNION ALL SELECT 3, 'critical_customer_id', count(customer_id) > 0 OR count(*) = 0,
    'Critical column ''customer_id'' is entirely null.' FROM txn
  UNION ALL SELECT 4, 'critical_timestamp', count(timestamp) > 0 OR count(*) = 0,
    'Critical column ''timestamp'' is entirely null.' FROM txn
  UNION ALL SELECT 5, 'critical_amount', count(amount) > 0 OR count(*) = 0,
    'Critical column ''amount'' is entirely null.' FROM txn
  UNION ALL SELECT 6, 'amount_numeric', count(*) FILTER (WHERE amount IS NULL) = 0 OR count(*) = 0,
    'Column ''amount'' contains non-numeric values.' FROM txn
  UNION ALL SELECT 7, 'amount_non_negative', count(*) FILTER (WHERE amount < 0) = 0,
    'Column ''amount'' contains negative values.' FROM txn
  UNION ALL SELECT 8, 'timestamp_parse', true, 'Column ''timestamp'' contains invalid datetime values.' FROM txn
    LIMIT 1000) v""", TXN_CTE)


@register("validate_txn", _VALIDATE_SQL.replace("FROM txn\n    LIMIT 1000) v", "FROM (SELECT 1) one) v"))
def q_validate_txn(spark, sf):
    return validate_txn(txn_view(spark, sf))


def _txn_text(spark, sf):
    """Text form of the transactions as a CSV would deliver it; fees arrive as signed debits."""
    t = txn_view(spark, sf)
    return t.select(*[F.col(c).cast("string").alias(c) for c in t.columns]).withColumn(
        "amount", F.when(F.col("transaction_type") == "fee", F.concat(F.lit("-"), F.col("amount")))
        .when((F.col("channel") == "atm") & (F.col("amount").cast("double") < 100), F.lit("n/a"))
        .otherwise(F.col("amount")))


@register("quarantine_txn", with_ctes("""SELECT transaction_id,
  CASE WHEN transaction_type = 'fee' THEN 'amount_negative' ELSE 'amount_not_numeric' END AS reasons FROM txn
  WHERE transaction_type = 'fee' OR (channel = 'atm' AND amount < 100)""", TXN_CTE))
def q_quarantine_txn(spark, sf):
    q = quarantine_txn(_txn_text(spark, sf))
    return q.select("transaction_id", F.array_join("reasons", ",").alias("reasons"))


_TEXT_CTE = """tx AS (
  SELECT transaction_id, customer_id, CAST(timestamp AS VARCHAR) AS timestamp,
         CASE WHEN transaction_type = 'fee' THEN '-' || CAST(amount AS VARCHAR)
              WHEN channel = 'atm' AND amount < 100 THEN 'n/a' ELSE CAST(amount AS VARCHAR) END AS amount FROM txn)"""


@register("validate_txn_text", with_ctes("""SELECT check_order, "check", passed, message,
  bool_and(passed) OVER () AS valid FROM (
  SELECT 1 AS check_order, 'required_columns' AS "check", true AS passed, '' AS message
  UNION ALL SELECT 2, 'critical_transaction_id', count(transaction_id) > 0 OR count(*) = 0,
    'Critical column ''transaction_id'' is entirely null.' FROM tx
  UNION ALL SELECT 3, 'critical_customer_id', count(customer_id) > 0 OR count(*) = 0,
    'Critical column ''customer_id'' is entirely null.' FROM tx
  UNION ALL SELECT 4, 'critical_timestamp', count(timestamp) > 0 OR count(*) = 0,
    'Critical column ''timestamp'' is entirely null.' FROM tx
  UNION ALL SELECT 5, 'critical_amount', count(amount) > 0 OR count(*) = 0,
    'Critical column ''amount'' is entirely null.' FROM tx
  UNION ALL SELECT 6, 'amount_numeric', count(*) FILTER (WHERE TRY_CAST(amount AS DOUBLE) IS NULL) = 0 OR count(*) = 0,
    'Column ''amount'' contains non-numeric values.' FROM tx
  UNION ALL SELECT 7, 'amount_non_negative', count(*) FILTER (WHERE TRY_CAST(amount AS DOUBLE) < 0) = 0,
    'Column ''amount'' contains negative values.' FROM tx
  UNION ALL SELECT 8, 'timestamp_parse', count(*) FILTER (WHERE timestamp IS NOT NULL
    AND TRY_CAST(timestamp AS TIMESTAMP) IS NULL) = 0, 'Column ''timestamp'' contains invalid datetime values.' FROM tx
) v""", TXN_CTE, _TEXT_CTE))
def q_validate_txn_text(spark, sf):
    """Validation of the text form with bad amounts."""
    return validate_txn(_txn_text(spark, sf))
