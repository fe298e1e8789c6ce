"""Scalar column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerscope.params import FORCED_MEDIUM_PATTERNS, Params


def dbl(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def just_under(amount: Column, p: Params) -> Column:
    """``lower <= amount < threshold``."""
    return (amount >= F.lit(p.structuring_lower_bound)) & (amount < F.lit(p.structuring_threshold))


def risk_level(score: Column, p: Params) -> Column:
    return (F.when(score <= F.lit(p.risk_low_max), F.lit("Low"))
             .when(score <= F.lit(p.risk_medium_max), F.lit("Medium"))
             .when(score <= F.lit(p.risk_high_max), F.lit("High"))
             .otherwise(F.lit("Critical")))


def forced_pattern(pattern: Column) -> Column:
    return F.coalesce(pattern.isin(*FORCED_MEDIUM_PATTERNS), F.lit(False))


def action_for(level: Column) -> Column:
    lv = F.lower(level)
    return (F.when(lv == "low", F.lit("monitor"))
             .when(lv == "medium", F.lit("review"))
             .when(lv.isin("high", "critical"), F.lit("report"))
             .otherwise(F.lit("review")))


def money(c: Column) -> Column:
    """``1234.5 -> 1,234.50``."""
    return F.format_number(c.cast("double"), 2)


def currency_short(c: Column) -> Column:
    """``$1.23B / $4.56M / $7.89K / $12.34``."""
    x = c.cast("double")
    return (F.when(x >= 1e9, F.format_string("$%.2fB", x / 1e9))
             .when(x >= 1e6, F.format_string("$%.2fM", x / 1e6))
             .when(x >= 1e3, F.format_string("$%.2fK", x / 1e3))
             .otherwise(F.format_string("$%.2f", x)))


# Fixed value: the reporting threshold quoted verbatim by the structuring template.
TEMPLATE_THRESHOLD = 10000.0

# Fixed value: the dollar-amount pattern used to fact-check explanation texts.
DOLLAR_PATTERN = r"\$([\d,]+(?:\.\d+)?)"


def dollar_amounts(text: Column) -> Column:
    """All ``$1,234.56`` amounts in a text, as an array of doubles."""
    return F.transform(F.regexp_extract_all(text, F.lit(DOLLAR_PATTERN), 1),
                       lambda s: F.regexp_replace(s, ",", "").cast("double"))


# Explanation templates by pattern (structuring, layering, statistical outlier, any other),
# the not-found text of the entity lookup, in the reference's wording.
EXPLAIN_STRUCTURING = ("Customer %s exhibited a structuring pattern with %d transactions totaling $%s positioned just "
                       "under the $10,000 reporting threshold within a short window.")
EXPLAIN_LAYERING = ("Customer %s initiated a sequence of rapid inter-account transfers (%d transactions) indicative "
                    "of money layering across account chains.")
EXPLAIN_OUTLIER = ("Customer %s was flagged as a statistical outlier with %d transactions showing significant "
                   "volume deviation from typical historical activity.")
EXPLAIN_OTHER = "Customer %s was flagged for %s with risk level %s across %d evidence transactions."
NOT_FOUND_TEXT = "Customer ID %s was not found in the transaction dataset."


def explanation(customer: Column, pattern: Column, level: Column, n_txn: Column, total: Column) -> Column:
    """Template explanation by pattern."""
    return (
        F.when(pattern.isin("structuring", "smurfing"),
               F.format_string(EXPLAIN_STRUCTURING, customer, n_txn, money(total)))
        .when(pattern == "layering", F.format_string(EXPLAIN_LAYERING, customer, n_txn))
        .when(pattern.isin("statistical_anomaly", "high_amount_zscore"),
              F.format_string(EXPLAIN_OUTLIER, customer, n_txn))
        .otherwise(F.format_string(EXPLAIN_OTHER, customer, F.coalesce(pattern, F.lit("suspicious activity")),
                                   level, n_txn))
    )


def zero_padded(number: Column, width: int) -> Column:
    """Decimal digits with leading zeros up to ``width``; longer numbers keep all their digits."""
    digits = number.cast("string")
    return F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0"))
