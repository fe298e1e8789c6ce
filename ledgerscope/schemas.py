"""Spark schemas of the data model."""

from pyspark.sql import types as T

TXN = T.StructType([
    T.StructField("transaction_id", T.StringType(), False),
    T.StructField("customer_id", T.StringType(), False),
    T.StructField("account_id", T.StringType(), True),
    T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("amount", T.DecimalType(18, 2), False),
    T.StructField("currency", T.StringType(), True),
    T.StructField("transaction_type", T.StringType(), True),
    T.StructField("channel", T.StringType(), True),
    T.StructField("counterparty_id", T.StringType(), True),
    T.StructField("country", T.StringType(), True),
    T.StructField("customer_segment", T.StringType(), True),
])

TXN_COLUMNS = [f.name for f in TXN.fields]

# The required and critical column lists of the input check.
REQUIRED_COLUMNS = ["transaction_id", "customer_id", "account_id", "timestamp", "amount", "currency",
                    "transaction_type", "channel", "counterparty_id", "country", "customer_segment"]
CRITICAL_COLUMNS = ["transaction_id", "customer_id", "timestamp", "amount"]

# Raw text form of the transaction table (CSV as it arrives; types checked later).
TXN_TEXT = T.StructType([T.StructField(c, T.StringType(), True) for c in REQUIRED_COLUMNS])

RULE_HIT = T.StructType([
    T.StructField("customer_id", T.StringType()),
    T.StructField("rule_fired", T.StringType()),
    T.StructField("txn_count", T.LongType()),
    T.StructField("total_amount", T.DoubleType()),
    T.StructField("rule_score", T.DoubleType()),
])

ML_HIT = T.StructType([
    T.StructField("customer_id", T.StringType()),
    T.StructField("ml_score", T.DoubleType()),
    T.StructField("anomaly_flag", T.BooleanType()),
])

AUDIT_EVENT = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("payload", T.StringType()),
])

FEEDBACK = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("feedback", T.StringType()),
    T.StructField("session_id", T.StringType()),
])

ALERT = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("reason", T.StringType()),
])

# Bank benchmark CSV layout (the header repeats "Account"; read positionally).
BANK_CSV = T.StructType([
    T.StructField("Timestamp", T.StringType()),
    T.StructField("From Bank", T.StringType()),
    T.StructField("Account", T.StringType()),
    T.StructField("To Bank", T.StringType()),
    T.StructField("Account2", T.StringType()),
    T.StructField("Amount Received", T.StringType()),
    T.StructField("Receiving Currency", T.StringType()),
    T.StructField("Amount Paid", T.StringType()),
    T.StructField("Payment Currency", T.StringType()),
    T.StructField("Payment Format", T.StringType()),
    T.StructField("Is Laundering", T.StringType()),
])
