"""Operator contracts: what is missing raises before any job; what is listed is enough."""

import pytest
from pyspark.sql import types as T

from ledgerscope.operators.contracts import KINDS, OPERATORS, ContractError, apply, catalogue

SAMPLE = {"text": T.StringType(), "time": T.TimestampType(), "flag": T.BooleanType(), "number": T.DoubleType()}
WRONG = {"text": T.DateType(), "time": T.StringType(), "flag": T.StringType(), "number": T.StringType()}


def empty(spark, columns):
    return spark.createDataFrame([], T.StructType([T.StructField(c, SAMPLE[k]) for c, k in columns.items()]))


def tables(spark, op):
    return {name: empty(spark, columns) for name, columns in op.tables.items()}


@pytest.fixture
def jobs_started(spark):
    """Jobs of the block, counted in a job group of its own."""
    spark.sparkContext.setJobGroup("contracts", "contracts")
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup("contracts"))
    yield lambda: len(set(tracker.getJobIdsForGroup("contracts")) - before)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_there_are_thirteen_operators():
    assert len(OPERATORS) == 13 and len(catalogue()) == 13
    assert all(says and set(columns.values()) <= set(KINDS) for _, says, columns in catalogue())


@pytest.mark.parametrize("name", OPERATORS)
def test_each_missing_or_ill_typed_column_raises_before_any_job(spark, jobs_started, name):
    op = OPERATORS[name]
    assert op.columns
    for c in op.columns:
        rest = {k: v for k, v in op.columns.items() if k != c}
        with pytest.raises(ContractError, match=f"{c} is missing"):
            apply(name, empty(spark, rest), **tables(spark, op))
        odd = T.StructType([T.StructField(k, WRONG[v] if k == c else SAMPLE[v]) for k, v in op.columns.items()])
        with pytest.raises(ContractError, match=f"{c} is .*, not a"):
            apply(name, spark.createDataFrame([], odd), **tables(spark, op))
    for t, columns in op.tables.items():
        with pytest.raises(ContractError, match=f"table {t} is missing"):
            apply(name, empty(spark, op.columns))
        for c in columns:
            short = {**tables(spark, op), t: empty(spark, {k: v for k, v in columns.items() if k != c})}
            with pytest.raises(ContractError, match=f"{t}: {c} is missing"):
                apply(name, empty(spark, op.columns), **short)
    assert jobs_started() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_the_listed_columns_are_enough(spark, name):
    op = OPERATORS[name]
    out = apply(name, empty(spark, op.columns), **tables(spark, op))
    assert out.columns and len(out.collect()) <= 30  # empty input: nothing, one summary row, or empty bins


def test_unknown_names_and_extra_columns(spark):
    with pytest.raises(KeyError):
        apply("nothing", spark.range(1))
    df = spark.createDataFrame([("High", 1)], "risk_level STRING, other INT")
    assert apply("escalation", df).first().other == 1
