"""Filters and row-level predicates of the transaction table."""

from __future__ import annotations

import datetime as dt
import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.exprs import just_under
from ledgerscope.params import DEFAULT_PARAMS, Params


@dataclass(frozen=True)
class Filters:
    """Optional filter fields; empty strings and a zero limit count as absent."""
    date_start: dt.date | None = None
    date_end: dt.date | None = None
    country: str | None = None
    transaction_type: str | None = None
    customer_segment: str | None = None
    amount_threshold: float | None = None
    min_transaction_count: int | None = None
    limit: int | None = None


def date_range_predicate(date_start: dt.date | None, date_end: dt.date | None,
                         lookback_days: int = DEFAULT_PARAMS.default_lookback_days) -> Column:
    """``start <= ts <= end + 1 day``; end only -> start = end - look-back; start only -> open end."""
    ts = F.col("timestamp")
    preds = []
    start = date_start or (date_end - dt.timedelta(days=lookback_days) if date_end else None)
    if start:
        preds.append(ts >= F.lit(dt.datetime.combine(start, dt.time())))
    if date_end:
        preds.append(ts <= F.lit(dt.datetime.combine(date_end + dt.timedelta(days=1), dt.time())))
    return functools.reduce(lambda a, b: a & b, preds, F.lit(True))


def filters_predicate(f: Filters | None, params: Params = DEFAULT_PARAMS) -> Column:
    """Conjunction of the given filters; none -> all rows. Literal predicates push down to the scan."""
    if f is None:
        return F.lit(True)
    preds = [date_range_predicate(f.date_start, f.date_end, params.default_lookback_days)]
    if f.country:
        preds.append(F.lower(F.col("country")) == F.lower(F.lit(f.country)))
    if f.transaction_type:
        preds.append(F.lower(F.col("transaction_type")).contains(f.transaction_type.lower()))
    if f.customer_segment:
        preds.append(F.lower(F.col("customer_segment")) == F.lower(F.lit(f.customer_segment)))
    if f.amount_threshold is not None:
        preds.append(F.col("amount") < F.lit(f.amount_threshold))
    return functools.reduce(lambda a, b: a & b, preds)


def filter_txn(txn: DataFrame, f: Filters | None, params: Params = DEFAULT_PARAMS) -> DataFrame:
    return txn.filter(filters_predicate(f, params))


def filter_last_n_days(txn: DataFrame, n: int, as_of: dt.date) -> DataFrame:
    """Relative look-back ``[as_of - n, as_of + 1 day]``; ``as_of`` is explicit, never the wall clock."""
    return txn.filter(date_range_predicate(as_of - dt.timedelta(days=n), as_of))


def flag_just_under(df: DataFrame, params: Params = DEFAULT_PARAMS) -> DataFrame:
    return df.withColumn("is_just_under_threshold", just_under(F.col("amount"), params))


def filter_transfers(txn: DataFrame) -> DataFrame:
    return txn.filter((F.lower(F.col("transaction_type")) == "transfer") & F.col("counterparty_id").isNotNull())


def normalize_entity_id(c: Column) -> Column:
    """Upper-case, trim, and prefix ``CUST`` to an all-digit id."""
    u = F.upper(F.trim(c))
    return F.when(~u.startswith("CUST") & u.rlike("^[0-9]+$"), F.concat(F.lit("CUST"), u)).otherwise(u)


def label_ground_truth(txn: DataFrame, params: Params = DEFAULT_PARAMS, typed: bool = True) -> DataFrame:
    """1 for a just-under cash deposit or a transfer above the large amount; untyped variant: just-under only."""
    ju = just_under(F.col("amount"), params)
    if typed:
        lab = ((ju & (F.col("transaction_type") == "cash_deposit"))
               | ((F.col("amount") > F.lit(params.large_amount)) & (F.col("transaction_type") == "transfer")))
    else:
        lab = ju
    return txn.withColumn("is_laundering_ground_truth", F.coalesce(lab, F.lit(False)).cast("int"))


def extract_evidence_rows(txn: DataFrame, evidence: DataFrame) -> DataFrame:
    """Transactions whose id is in any flagged evidence set (left semi join)."""
    return txn.join(evidence.select("transaction_id").distinct(), "transaction_id", "left_semi")
