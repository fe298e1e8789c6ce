"""Operators by name, with the columns and kinds of column that each reads, checked before anything runs.

An operator maps one table to one table; those that join a second table take it as an argument of that name. ``apply``
compares the input's schema, which Spark knows at analysis time, with the contract: a missing column, or one of another
kind, raises ``ContractError`` and no job starts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.operators.aggregates import agg_customer, agg_customer_features, agg_daily, agg_entity_profile, agg_histogram, agg_summary
from ledgerscope.operators.consensus import compute_consensus
from ledgerscope.operators.decide import classify_risk, explain_template, recommend_action
from ledgerscope.operators.features import compute_features
from ledgerscope.operators.filters import Filters, filter_txn
from ledgerscope.operators.forest import detect_anomaly
from ledgerscope.operators.graph import build_transfer_graph, detect_layering
from ledgerscope.operators.structuring import detect_structuring

#: Kinds of column, by the Spark types that serve as one.
KINDS: dict[str, tuple[type[T.DataType], ...]] = {
    "text": (T.StringType,), "time": (T.TimestampType, T.TimestampNTZType), "flag": (T.BooleanType,),
    "number": (T.DecimalType, T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.ShortType, T.ByteType)}


class ContractError(ValueError):
    """The input lacks columns that the operator reads, or has them of another kind."""


@dataclass(frozen=True)
class Operator:
    """``run(df, **arguments)``; ``columns``: name -> kind; ``tables``: further inputs, each with its own columns."""
    run: Callable[..., DataFrame]
    says: str
    columns: dict[str, str]
    tables: dict[str, dict[str, str]] = field(default_factory=dict)


ID, TIME, AMOUNT = {"customer_id": "text"}, {"timestamp": "time"}, {"amount": "number"}
ROW = {"transaction_id": "text", **ID, **TIME, **AMOUNT}
HIT = {**ID, "rule_fired": "text", "rule_score": "number", "txn_count": "number", "total_amount": "number"}


def _features_to_hits(features: DataFrame, **kw) -> DataFrame:
    return detect_anomaly(agg_customer_features(features), **kw)


def _chart_rows(txn: DataFrame, bins: int = 30) -> DataFrame:
    """The numbers behind the charts, long: (chart, position, value)."""
    daily = agg_daily(txn).select(F.lit("daily_amount").alias("chart"), F.col("date").cast("string").alias("position"), F.col("amount").alias("value"))
    bars = agg_histogram(txn, bins).select(F.lit("amount_histogram").alias("chart"), F.col("bin").cast("string").alias("position"), F.col("n").cast("double").alias("value"))
    return daily.unionByName(bars)


OPERATORS: dict[str, Operator] = {
    "data_loader": Operator(lambda df, filters=None, **kw: filter_txn(df, filters or Filters(), **kw), "Transactions that meet the filters.",
                            {**ROW, "country": "text", "transaction_type": "text", "customer_segment": "text"}),
    "eda": Operator(agg_summary, "Count, volume, mean and median of the amounts.", AMOUNT),
    "feature_engineering": Operator(compute_features, "Rolling counts and sums, velocity, z-score, just-under flag.", ROW),
    "aggregation_rule": Operator(agg_customer, "Transactions and amounts per customer, from a least number on.", {"transaction_id": "text", **ID, **AMOUNT}),
    "structuring_rule": Operator(detect_structuring, "Customers with many just-under amounts in one window.", ROW),
    "graph_layering": Operator(lambda df, **kw: detect_layering(build_transfer_graph(df), **kw), "Customers that start a chain of transfers.",
                               {**ROW, "account_id": "text", "counterparty_id": "text", "transaction_type": "text"}),
    "ml_anomaly": Operator(_features_to_hits, "Isolation-forest hits with their attribution, from the feature table.",
                           {"transaction_id": "text", **ID, **AMOUNT, "rolling_7d_count": "number", "rolling_30d_sum": "number",
                            "amount_zscore_vs_customer_avg": "number", "velocity_hours_since_last_txn": "number"}),
    "entity_lookup": Operator(agg_entity_profile, "Profile of requested customers.", {"transaction_id": "text", **ID, **AMOUNT}, {"customers": ID}),
    "consensus": Operator(compute_consensus, "Rule hits and model hits weighed per customer.", HIT,
                          {"ml_hits": {**ID, "ml_score": "number", "anomaly_flag": "flag"}}),
    "risk_classifier": Operator(classify_risk, "Risk score and level of a combined score.", {"combined_score": "number", "pattern_matched": "text"}),
    "explanation": Operator(lambda df, count_col="evidence_count", total_col="rule_total_amount": explain_template(df, count_col, total_col),
                            "A templated explanation of each item.",
                            {**ID, "pattern_matched": "text", "risk_level": "text", "evidence_count": "number", "rule_total_amount": "number"}),
    "escalation": Operator(recommend_action, "The recommended action of a risk level.", {"risk_level": "text"}),
    "charts": Operator(_chart_rows, "The rows behind the charts: amounts by day and their histogram.", {**TIME, **AMOUNT}),
}


def check(name: str, df: DataFrame, columns: dict[str, str], table: str = "input") -> None:
    """Raises ``ContractError`` that lists every missing or ill-typed column; looks at the schema alone."""
    types = {f.name: f.dataType for f in df.schema.fields}
    faults = [f"{c} is missing" for c in columns if c not in types]
    faults += [f"{c} is {types[c].simpleString()}, not a {kind}" for c, kind in columns.items() if c in types and not isinstance(types[c], KINDS[kind])]
    if faults:
        raise ContractError(f"{name}, {table}: {'; '.join(faults)}")


def apply(name: str, df: DataFrame, **arguments: Any) -> DataFrame:
    """The named operator on ``df``, after its contract has been checked against every table it reads."""
    if name not in OPERATORS:
        raise KeyError(f"no operator {name}; there are {', '.join(OPERATORS)}")
    op = OPERATORS[name]
    check(name, df, op.columns)
    for table, columns in op.tables.items():
        if table not in arguments:
            raise ContractError(f"{name}: the table {table} is missing")
        check(name, arguments[table], columns, table)
    return op.run(df, **arguments)


def catalogue() -> list[tuple[str, str, dict[str, str]]]:
    """(name, what it does, columns) of every operator."""
    return [(name, op.says, dict(op.columns)) for name, op in OPERATORS.items()]
