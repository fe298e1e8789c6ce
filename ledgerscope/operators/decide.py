"""Risk level, action, explanation, verification and bias audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.bounded import attach_global

from ledgerscope.functions.exprs import (TEMPLATE_THRESHOLD, action_for, dollar_amounts, explanation,
                                         forced_pattern, risk_level)
from ledgerscope.params import DEFAULT_PARAMS, Params


def flag_gate(consensus: DataFrame) -> DataFrame:
    """Keep consensus rows that are not Normal or score above 30."""
    return consensus.filter((F.col("verdict") != "Normal") | (F.col("combined_score") > 30.0))


def classify_risk(df: DataFrame, params: Params = DEFAULT_PARAMS, score_col: str = "combined_score",
                  pattern_col: str = "pattern_matched") -> DataFrame:
    """Adds ``risk_score`` and ``risk_level``; structuring / smurfing / layering at Low -> Medium, >= 45."""
    lvl = risk_level(F.col(score_col), params)
    forced = forced_pattern(F.col(pattern_col)) & (lvl == "Low")
    return (df.withColumn("risk_score", F.round(F.when(forced, F.greatest(F.col(score_col), F.lit(45.0)))
                                                .otherwise(F.col(score_col)), 1))
              .withColumn("risk_level", F.when(forced, F.lit("Medium")).otherwise(lvl)))


def recommend_action(df: DataFrame, level_col: str = "risk_level") -> DataFrame:
    return df.withColumn("recommended_action", action_for(F.col(level_col)))


def explain_template(df: DataFrame, count_col: str, total_col: str, pattern_col: str = "pattern_matched",
                     level_col: str = "risk_level") -> DataFrame:
    return df.withColumn("explanation", explanation(
        F.col("customer_id"), F.col(pattern_col), F.col(level_col),
        F.coalesce(F.col(count_col), F.lit(0)).cast("long"),
        F.coalesce(F.col(total_col).cast("double"), F.lit(0.0))))


def verify_results(flagged: DataFrame, evidence: DataFrame, params: Params = DEFAULT_PARAMS, strict: bool = False,
                   keys: tuple[str, ...] = ("customer_id",)) -> DataFrame:
    """Re-derive and repair level and action; fact-check every ``$`` amount of the explanation.

    ``evidence``: rows with ``keys``, transaction_id and amount (a decimal). An amount passes if it equals the
    amount of one evidence row of the item or the sum of them, compared as decimals with two places, so the order of
    the rows cannot change a verdict. Items without evidence rows are not fact-checked. ``strict=False`` also accepts
    the reporting threshold the structuring template quotes verbatim ($10,000); ``strict=True`` does not.
    The evidence is aggregated once per item, and only quoted amounts are looked up among its rows.
    """
    keys, money2 = list(keys), "decimal(18,2)"
    lvl = risk_level(F.col("risk_score"), params)
    expected = F.when(forced_pattern(F.lower(F.coalesce(F.col("pattern_matched"), F.lit("")))) & (lvl == "Low"),
                      F.lit("Medium")).otherwise(lvl)
    base = flagged.withColumn("_expected_level", expected)
    amounts = evidence.select(*keys, F.col("amount").cast(money2).alias("_amt"))
    quoted = (base.select(*keys, F.explode(F.array_distinct(dollar_amounts(F.col("explanation")))).alias("_q"))
              .withColumn("_q", F.col("_q").cast("decimal(28,2)")))
    # one pass over the evidence, joined to the few quoted amounts of its item: the sum and, per quoted amount, a hit
    pairs = amounts.groupBy(*keys, "_amt").agg(F.count(F.lit(1)).alias("_n"))
    per_quote = (quoted.join(pairs, keys).groupBy(*keys, "_q")
                 .agg(F.sum(F.col("_amt") * F.col("_n")).alias("_sum"), F.max((F.col("_amt") == F.col("_q")).cast("int")).alias("_hit")))
    ok = (F.col("_hit") == 1) | (F.col("_q") == F.col("_sum"))
    if not strict:
        ok = ok | (F.col("_q") == F.lit(TEMPLATE_THRESHOLD).cast("decimal(28,2)"))
    bad_amounts = per_quote.filter(~ok).select(*keys).distinct().withColumn("_bad_amount", F.lit(True))
    out = base.join(bad_amounts, keys, "left")
    level_ok = F.col("risk_level") == F.col("_expected_level")
    fixed_level = F.col("_expected_level")
    action = F.col("recommended_action")
    fixed_action = (F.when(fixed_level.isin("High", "Critical") & (action == "monitor"), F.lit("report"))
                     .when((fixed_level == "Low") & (action == "report"), F.lit("monitor")).otherwise(action))
    return out.select(
        *[c for c in flagged.columns if c not in ("risk_level", "recommended_action")],
        fixed_level.alias("risk_level"), fixed_action.alias("recommended_action"),
        level_ok.alias("level_ok"), (fixed_action == action).alias("action_ok"),
        (~F.coalesce(F.col("_bad_amount"), F.lit(False))).alias("amounts_ok"),
    ).withColumn("item_passed", F.col("level_ok") & F.col("action_ok") & F.col("amounts_ok"))


def verification_status(verified: DataFrame) -> DataFrame:
    """One row: Passed iff every item passed (an empty result passes)."""
    return verified.agg(F.count(F.lit(1)).alias("items_audited"),
                        F.coalesce(F.bool_and("item_passed"), F.lit(True)).alias("all_passed")) \
        .withColumn("status", F.when(F.col("all_passed"), "Passed").otherwise("Needs Review"))


def segment_shares(flagged_ids: DataFrame, txn: DataFrame) -> DataFrame:
    """Population and flagged shares per country and per segment.

    Denominators as in the reference: distinct (customer, country, segment) rows
    for the population, distinct flagged customer ids for the flagged share.
    Both dimensions are computed in one aggregation over an exploded
    (dimension, group) pair.
    """
    demo = txn.select("customer_id", "country", "customer_segment").distinct()
    flagged = flagged_ids.select("customer_id").distinct().withColumn("_f", F.lit(1))
    n_flagged = flagged.agg(F.count(F.lit(1)).alias("_n_flagged"))
    tagged = demo.join(flagged, "customer_id", "left")
    total = demo.agg(F.count(F.lit(1)).alias("_n_pop"))
    pairs = tagged.select(F.explode(F.array(
        F.struct(F.lit("country").alias("dimension"), F.col("country").alias("group"), F.col("_f").alias("f")),
        F.struct(F.lit("customer_segment").alias("dimension"), F.col("customer_segment").alias("group"),
                 F.col("_f").alias("f")))).alias("p")).select("p.*")
    per_group = (pairs.filter(F.col("group").isNotNull()).groupBy("dimension", "group")
                 .agg(F.count(F.lit(1)).alias("population"), F.coalesce(F.sum("f"), F.lit(0)).alias("flagged")))
    # The two one-row totals are single global aggregates: broadcasting them is bounded.
    return (attach_global(attach_global(per_group, total), n_flagged)
            .select("dimension", "group", "population", "flagged", "_n_pop", "_n_flagged",
                    (F.col("population") / F.col("_n_pop")).alias("pop_share"),
                    F.when(F.col("_n_flagged") > 0, F.col("flagged") / F.col("_n_flagged"))
                     .otherwise(F.lit(0.0)).alias("flag_share")))


def bias_audit(flagged_ids: DataFrame, txn: DataFrame, min_pop_share: float = 0.05,
               ratio: float = 2.0) -> DataFrame:
    """Warnings for groups flagged more than ``ratio`` times their population share."""
    s = segment_shares(flagged_ids, txn)
    # Percentages and the ratio are rounded half-up from the exact integer fractions (same in every engine).
    def half_up(num, den, scale):
        return F.floor((F.lit(2 * scale) * num + den) / (F.lit(2) * den)) / F.lit(float(scale))

    pop, npop = F.col("population"), F.col("_n_pop")
    flg, nflg = F.col("flagged"), F.col("_n_flagged")
    return (s.filter((F.col("pop_share") > min_pop_share) & (F.col("flag_share") > ratio * F.col("pop_share")))
            .select("dimension", "group",
                    half_up(pop * 100, npop, 10).alias("population_share"),
                    half_up(flg * 100, nflg, 10).alias("flagged_share"),
                    half_up(flg * npop, nflg * pop, 100).alias("ratio")))
