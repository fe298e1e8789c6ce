"""Input checks of the transaction table: table-level verdict and row-level quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.bounded import attach_global

from ledgerscope.schemas import CRITICAL_COLUMNS, REQUIRED_COLUMNS


def _amount_num(df: DataFrame) -> F.Column:
    return F.expr("try_cast(amount AS DOUBLE)") if dict(df.dtypes).get("amount") == "string" \
        else F.col("amount").cast("double")


def _ts_ok(df: DataFrame) -> F.Column:
    if dict(df.dtypes).get("timestamp") == "string":
        return F.expr("try_to_timestamp(timestamp)").isNotNull()
    return F.col("timestamp").isNotNull()


def validate_txn(df: DataFrame) -> DataFrame:
    """One row per check in order with its result; the first failing check decides ``valid``.

    Missing required columns is decided from the schema (no job). All other
    checks run as one aggregation pass: critical columns entirely null,
    amount non-numeric, amount negative, unparseable timestamps. An empty table
    is valid.
    """
    spark = df.sparkSession
    missing = [c for c in REQUIRED_COLUMNS if c not in df.columns]
    if missing:
        return spark.createDataFrame([(1, "required_columns", False, f"Missing required columns: {missing}")],
                                     "check_order INT, check STRING, passed BOOLEAN, message STRING") \
            .withColumn("valid", F.lit(False))
    amt = _amount_num(df)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [F.count(F.col(c)).alias(f"_nn_{c}") for c in CRITICAL_COLUMNS]
    aggs += [F.count_if(F.col("amount").isNotNull() & amt.isNull()).alias("_non_numeric"),
             F.count_if(F.col("amount").isNull()).alias("_amount_null"),
             F.count_if(amt < 0).alias("_negative"),
             F.count_if(F.col("timestamp").isNotNull() & ~_ts_ok(df)).alias("_bad_ts")]
    s = df.agg(*aggs)
    checks = [("critical_" + c, f"_nn_{c} > 0 OR _rows = 0", f"Critical column '{c}' is entirely null.")
              for c in CRITICAL_COLUMNS]
    checks += [("amount_numeric", "(_non_numeric + _amount_null) = 0 OR _rows = 0",
                "Column 'amount' contains non-numeric values."),
               ("amount_non_negative", "_negative = 0", "Column 'amount' contains negative values."),
               ("timestamp_parse", "_bad_ts = 0", "Column 'timestamp' contains invalid datetime values.")]
    stack = ", ".join(f"{i + 2}, '{name}', {cond}, \"{msg}\"" for i, (name, cond, msg) in enumerate(checks))
    rows = s.selectExpr(f"stack({len(checks)}, {stack}) AS (check_order, check, passed, message)")
    ok_all = rows.agg(F.bool_and("passed").alias("valid"))
    first = spark.createDataFrame([(1, "required_columns", True, "")],
                                  "check_order INT, check STRING, passed BOOLEAN, message STRING")
    return first.unionByName(rows.withColumn("check_order", F.col("check_order").cast("int"))) \
        .transform(lambda d: attach_global(d, ok_all))


def with_reasons(df: DataFrame) -> DataFrame:
    """All rows with ``reasons``: the row-level checks that a row fails (empty for a clean one)."""
    amt = _amount_num(df)
    reasons = F.array_compact(F.array(
        *[F.when(F.col(c).isNull(), F.lit(f"null_{c}")) for c in CRITICAL_COLUMNS],
        F.when(F.col("amount").isNotNull() & amt.isNull(), F.lit("amount_not_numeric")),
        F.when(amt < 0, F.lit("amount_negative")),
        F.when(F.col("timestamp").isNotNull() & ~_ts_ok(df), F.lit("timestamp_unparseable"))))
    return df.withColumn("reasons", reasons)


def quarantine_txn(df: DataFrame) -> DataFrame:
    """Rows failing row-level checks, with an array of reasons; the rest is the clean output."""
    return with_reasons(df).filter(F.size("reasons") > 0)


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean rows, quarantined rows with reasons); together every row of ``df`` once."""
    return with_reasons(df).filter(F.size("reasons") == 0).drop("reasons"), quarantine_txn(df)
