"""File sources and sinks: CSV / Parquet transactions, JSON-lines logs, report texts, metrics.

Scratch outputs of the registered queries go below the shared checkpoint
folder (``spark.checkpoint.dir``), never a machine-local temporary folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.schemas import ALERT, AUDIT_EVENT, BANK_CSV, FEEDBACK, TXN, TXN_TEXT
from ledgerscope.functions.exprs import zero_padded
from ledgerscope.session import scratch_path  # noqa: F401  (re-exported for the registered queries)

TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def typed_txn(raw: DataFrame) -> DataFrame:
    """Cast the text form to the transaction schema (bad values become null; see quarantine)."""
    out = []
    for f in TXN.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.TimestampType):
            c = F.expr(f"try_to_timestamp(`{f.name}`)")
        elif isinstance(f.dataType, T.DecimalType):
            c = F.expr(f"try_cast(`{f.name}` AS DECIMAL(18,2))")
        out.append(c.alias(f.name))
    return raw.select(*out)


def read_txn_csv(spark: SparkSession, path: str, ordered: bool = True) -> DataFrame:
    """Transactions from CSV with a header, explicit schema (no inference pass over the data)."""
    raw = spark.read.schema(TXN_TEXT).option("header", True).csv(path)
    df = typed_txn(raw)
    return df.orderBy(F.col("timestamp").asc_nulls_last(), "transaction_id") if ordered else df


def read_txn_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_txn_csv(df: DataFrame, path: str) -> None:
    (df.select(*[F.date_format(c, TS_FORMAT).alias(c) if c == "timestamp" else F.col(c).cast("string").alias(c)
                 for c in df.columns])
     .write.mode("overwrite").option("header", True).csv(path))


def global_row_index(df: DataFrame, order: list[str], name: str = "row_index", start: int = 0) -> DataFrame:
    """Consecutive positions in ``order`` without a single-task window.

    Range partitioning + local numbering (``monotonically_increasing_id``) +
    per-partition offsets (one row per partition, a bounded table). The
    numbered rows are written once to the shared folder first: range bounds are
    sampled per evaluation, so offsets and numbers must come from the same
    materialised rows (this also survives executor loss).
    """
    from ledgerscope.session import cut_lineage

    numbered = cut_lineage(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_pid", F.spark_partition_id().cast("long"))
        .withColumn("_local", F.monotonically_increasing_id() - F.shiftleft(F.col("_pid"), 33)))
    sizes = numbered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offs = sizes.select("_pid", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return (numbered.join(F.broadcast(offs), "_pid")
            .withColumn(name, F.col("_off") + F.col("_local") + F.lit(start))
            .drop("_pid", "_local", "_off"))


def read_csv_tree(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """All rows of all CSV files (with a header line each) under a directory tree."""
    return (spark.read.option("header", True).schema(schema).option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.csv").csv(root))


def adapt_bank_csv(raw: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Map bank-benchmark rows to the transaction schema.

    ``order``: columns giving the row position (default: file, position in file as added by ``read_bank_csv``).
    id = ``IBM`` + row position, zero-padded to 7 digits or longer; customer = ``FromBank_Account``;
    amount = the paid column if the table has it, else the received column, else 0 for all rows. A row whose
    value is missing or not a number keeps a null amount, so that the input check quarantines it.
    Currency default USD; type = channel = lower(format), default ``wire``; counterparty = ``ToBank_Account2``; no
    country / segment; label kept as ``is_laundering_ground_truth``.
    """
    cols = set(raw.columns)

    def col(name, default):
        return F.col(f"`{name}`") if name in cols else F.lit(default)

    idx = global_row_index(raw, order or ["_file", "_pos"])
    fmt = F.lower(col("Payment Format", "wire"))
    source = next((c for c in ("Amount Paid", "Amount Received") if c in cols), None)
    amount = F.expr(f"try_cast(`{source}` AS DECIMAL(18,2))") if source else F.lit(0).cast("decimal(18,2)")
    out = idx.select(
        F.concat(F.lit("IBM"), zero_padded(F.col("row_index"), 7)).alias("transaction_id"),
        F.concat_ws("_", col("From Bank", "B0"), col("Account", "A0")).alias("customer_id"),
        col("Account", "A0").alias("account_id"),
        F.expr("try_to_timestamp(`Timestamp`, 'yyyy/MM/dd HH:mm')").alias("timestamp"),
        amount.alias("amount"),
        col("Payment Currency", "USD").alias("currency"),
        fmt.alias("transaction_type"), fmt.alias("channel"),
        F.concat_ws("_", col("To Bank", "B0"), col("Account2", "A0")).alias("counterparty_id"),
        F.lit(None).cast("string").alias("country"), F.lit(None).cast("string").alias("customer_segment"),
        *([F.expr("try_cast(`Is Laundering` AS INT)").alias("is_laundering_ground_truth")]
          if "Is Laundering" in cols else []))
    return out


def read_bank_csv(spark: SparkSession, path: str) -> DataFrame:
    """Bank CSV with an explicit positional schema (the header repeats ``Account``; bank codes keep zeros)."""
    return (spark.read.schema(BANK_CSV).option("header", True).csv(path)
            .withColumn("_file", F.input_file_name()).withColumn("_pos", F.monotonically_increasing_id()))


# ------------------------------------------------------------------ JSON-lines logs
def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def audit_events(events: DataFrame, event_type_col: str, payload_cols: list[str], ts_col: str) -> DataFrame:
    """Rows ``{timestamp, event_type, payload}`` with the payload as a JSON string."""
    return events.select(F.date_format(F.col(ts_col), TS_FORMAT).alias("timestamp"),
                         F.col(event_type_col).alias("event_type"),
                         F.to_json(F.struct(*payload_cols)).alias("payload"))


def append_audit_log(events: DataFrame, path: str) -> None:
    """Appends audit events to a log with one folder a day (``day=<date of the timestamp>``)."""
    events.withColumn("day", F.to_date("timestamp")).write.mode("append").partitionBy("day").json(path)


def log_days(spark: SparkSession, path: str) -> list[str] | None:
    """The day folders of a log, newest first, undated last (a listing: no file is read); None if there is no log."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()]
    days = [n.removeprefix("day=") for n in names if n.startswith("day=")]
    return sorted([d for d in days if d[:1].isdigit()], reverse=True) + [d for d in days if not d[:1].isdigit()]


def read_audit_tail(spark: SparkSession, path: str, limit: int = 50) -> DataFrame:
    """Last ``limit`` events, newest first (ties by type and payload); a missing log gives an empty table.

    The log's days are listed, and the newest are read, twice as many at each step, until they hold ``limit`` events: what is
    read depends on the last days, not on the log's age. A log without day folders is read as a whole.
    """
    days = log_days(spark, path)
    if days is None:
        return spark.createDataFrame([], AUDIT_EVENT)
    newest = [F.col("timestamp").desc_nulls_last(), "event_type", "payload"]
    if not days:
        return spark.read.schema(AUDIT_EVENT).json(path).orderBy(*newest).limit(limit)
    taken, held = 1, 0
    while True:
        df = spark.read.schema(AUDIT_EVENT).json([f"{path.rstrip('/')}/day={d}" for d in days[:taken]])
        if taken >= len(days):
            break
        held += df.limit(limit).count()
        if held >= limit:
            break
        held, taken = 0, min(2 * taken, len(days))
    return df.orderBy(*newest).limit(limit)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """Verdict log: blank and malformed lines are skipped (parsed from text, not DROPMALFORMED)."""
    txt = spark.read.text(path).filter(F.trim("value") != "")
    parsed = txt.select(F.from_json("value", FEEDBACK, {"mode": "PERMISSIVE"}).alias("j"))
    return parsed.filter(F.col("j").isNotNull() & F.col("j.feedback").isNotNull()).select("j.*")


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ALERT).json(path)


def alert_stream(spark: SparkSession, path: str) -> DataFrame:
    """The alert log as a live stream: lines that a writer appends, to old files or new ones, arrive once each."""
    from ledgerscope.sources.lines import appended_json
    return appended_json(spark, path, ALERT, ".json" if not path.endswith((".json", ".jsonl")) else "")


def latest_alerts(alerts: DataFrame, n: int = 20) -> DataFrame:
    return alerts.orderBy(F.col("timestamp").desc_nulls_last(), F.col("customer_id")).limit(n)


# ------------------------------------------------------------------ reports and metrics
# Fixed value: the report document layout (date, customer twice, session). One line does not match the
# original: the reporting-system line is worded neutrally.
REPORT_TEMPLATE = """# Suspicious Activity Report (SAR)

**Date of Report:** %s
**Subject:** Customer %s
**Reported By:** Automated AML detection system (Confirmed via HITL Analyst Feedback)

## 1. Subject Information
- **Customer ID:** %s

## 2. Suspicious Activity Details
- **Reason for Filing:** This customer was automatically flagged by the ML anomaly detection and/or rule engine, and subsequently confirmed as highly suspicious by an internal investigator.
- **Session Reference ID:** %s

## 3. Recommended Actions
- Freeze transactions pending further manual review.
- Request enhanced due diligence (EDD) documents from the customer.

---
*This is an automatically generated SAR summary produced by the internal AML Agent. Please attach supporting transaction logs before submitting to regulatory bodies.*
"""


def report_texts(feedback: DataFrame) -> DataFrame:
    """One filled report per True Positive verdict; name = customer and epoch seconds."""
    tp = feedback.filter(F.col("feedback") == "True Positive")
    ts = F.to_timestamp("timestamp")
    return tp.select("customer_id",
                     F.concat(F.lit("SAR_"), F.col("customer_id"), F.lit("_"),
                              F.unix_timestamp(ts).cast("string")).alias("report_name"),
                     F.format_string(REPORT_TEMPLATE, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"),
                                     F.col("customer_id"), F.col("customer_id"),
                                     F.coalesce(F.col("session_id"), F.lit("N/A"))).alias("content"))


def write_reports(reports: DataFrame, path: str) -> None:
    """Report documents, many a file: each row keeps its name and its text, so equal names stay apart."""
    reports.select("report_name", "content").write.mode("append").parquet(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Report documents, newest name first."""
    return spark.read.schema("report_name string, content string").parquet(path).orderBy(F.col("report_name").desc())


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(path)  # one small row
