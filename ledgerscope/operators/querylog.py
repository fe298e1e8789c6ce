"""Query-log jobs: tagging query texts, pairing queries with responses, session context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.operators.windows import last_marker_at_or_before, top_n_per_key

# Patterns and vocabularies of the reference's keyword parser and capability check.
ENTITY_PATTERN = r"(?i)(?:customer\s*(?:id)?\s*[:#]?\s*|cust\s*)([0-9]{3,6})(?![0-9])"
DAYS_PATTERN = r"last\s+(\d+)\s+days?"
COUNT_PATTERN = r"(\d+)\+?\s*transactions?"
AMOUNT_PATTERN = r"under\s*\$?([\d,]+)"
LIMIT_PATTERN = r"(?:top|limit)\s+(\d+)"
PARSER_DOMAIN_WORDS = ["transaction", "customer", "money", "laundering", "bank", "account", "structuring",
                       "smurfing", "layering", "deposit", "withdrawal", "transfer", "fraud", "suspicious", "check",
                       "eda", "summary", "overview", "txns", "aml"]
CAPABILITY_WORDS = ["transaction", "customer", "money", "laundering", "bank", "account", "structuring", "smurfing",
                    "layering", "deposit", "withdrawal", "transfer", "fraud", "suspicious", "check", "eda",
                    "summary", "overview", "txns", "aml", "flag", "risk", "data", "dataset", "table", "csv",
                    "pattern", "activity"]
EDA_WORDS = ["chart", "graph", "plot", "visual", "eda", "summary", "overview"]


def _has(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 0) != ""


def _any_word(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def _num(text: Column, pattern: str, to: str = "long") -> Column:
    g = F.regexp_extract(text, pattern, 1)
    return F.when(g != "", F.regexp_replace(g, ",", "").try_cast(to))


def tag_queries(queries: DataFrame, text_col: str = "text") -> DataFrame:
    """Entity id, look-back days, minimum count, amount limit, top-n, intent, pattern and flags per query."""
    raw = F.col(text_col)
    low = F.lower(raw)
    ent = F.regexp_extract(raw, ENTITY_PATTERN, 1)
    has_ent = ent != ""
    days = _num(low, DAYS_PATTERN)
    cnt = _num(low, COUNT_PATTERN)
    amt_s = F.regexp_extract(low, AMOUNT_PATTERN, 1)
    amt = _num(low, AMOUNT_PATTERN, "double")
    lim = _num(low, LIMIT_PATTERN)
    structuring = low.contains("structur") | low.contains("smurf")
    layering = low.contains("layer")
    cash_dep = low.contains("cash") & low.contains("deposit")
    intent = F.lit("broad_exploration")
    intent = F.when(has_ent, F.lit("entity_lookup")).otherwise(intent)
    intent = F.when((F.regexp_extract(low, COUNT_PATTERN, 0) != "") | (amt_s != ""), F.lit("aggregation_query")).otherwise(intent)
    intent = F.when(lim.isNotNull(), F.lit("aggregation_query")).otherwise(intent)
    intent = F.when(structuring | layering | cash_dep, F.lit("pattern_search")).otherwise(intent)
    pattern = F.when(structuring, "structuring").when(layering, "layering").when(cash_dep, "structuring") \
        .otherwise("none")
    ood = ~_any_word(low, PARSER_DOMAIN_WORDS) & (intent == "broad_exploration") & ~has_ent
    eda_kw = low.contains("eda") | low.contains("summary") | low.contains("overview")
    full = ~ood & ((intent == "broad_exploration") | eda_kw)
    return queries.select(
        "*",
        F.when(has_ent, F.concat(F.lit("CUST"), ent)).alias("entity_id"),
        days.alias("last_n_days"), cnt.alias("min_transaction_count"), amt.alias("amount_threshold"),
        lim.alias("limit"),
        F.when(ood, F.lit("out_of_domain")).otherwise(intent).alias("intent_type"),
        pattern.alias("target_pattern"),
        (full | _any_word(low, EDA_WORDS)).alias("requires_full_eda"),
        full.alias("requires_ml_detection"),
    )


def filter_in_domain(queries: DataFrame, text_col: str = "text") -> DataFrame:
    """Queries the capability check accepts: any domain word, or a customer id."""
    low = F.lower(F.col(text_col))
    return queries.filter(_any_word(low, CAPABILITY_WORDS) | _has(F.col(text_col), ENTITY_PATTERN))


def pair_queries_responses(log: DataFrame, session: str, order_col: str, is_query: Column, is_response: Column,
                           text: str, match: bool = False, block: int = 1024) -> DataFrame:
    """Pair each query with the first later response before the next query of its session.

    ``match=True`` also requires the response text to equal the query text
    (the audit-log form). Unmatched queries are kept with a null response.
    Newest query first.
    """
    seg = last_marker_at_or_before(log, [session], order_col, is_query, "_seg", block)
    queries = seg.filter(is_query).select(session, F.col(order_col).alias("query_pos"),
                                          F.col(text).alias("query_text"))
    resp = seg.filter(is_response & F.col("_seg").isNotNull())
    if match:
        qtext = queries.select(session, F.col("query_pos").alias("_seg"), F.col("query_text").alias("_qt"))
        resp = resp.join(qtext, [session, "_seg"]).filter(F.col(text) == F.col("_qt"))
    first = (resp.groupBy(session, "_seg")
             .agg(F.min_by(F.struct(F.col(order_col).alias("response_pos"), F.col(text).alias("response_text")),
                           F.col(order_col)).alias("_r"))
             .select(session, F.col("_seg").alias("query_pos"), "_r.response_pos", "_r.response_text"))
    return (queries.join(first, [session, "query_pos"], "left")
            .orderBy(F.col(session).desc(), F.col("query_pos").desc()))


def session_context(messages: DataFrame, session: str, order_col: str, role: str, text: str,
                    keep: int = 10, context: int = 3) -> DataFrame:
    """Per session: the last ``keep`` messages kept, the last ``context`` joined as ``Role: content`` lines."""
    last = top_n_per_key(messages, [session], [F.col(order_col).desc()], keep, block_col=order_col)
    ctx = (last.filter(F.col("rank") <= context)
           .groupBy(session)
           .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order_col, role, text))),
                                         lambda s: F.concat(F.initcap(s[role]), F.lit(": "), s[text])), "\n")
                .alias("context_text"),
                F.count(F.lit(1)).alias("context_messages")))
    kept = last.groupBy(session).agg(F.count(F.lit(1)).alias("kept_messages"))
    return kept.join(ctx, session)
