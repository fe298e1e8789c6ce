"""Registered queries: query-log tagging, query/response pairing, session context."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerscope.operators.querylog import filter_in_domain, pair_queries_responses, session_context, tag_queries
from ledgerscope.plans.registry import register
from ledgerscope.sources.tables import table

# The official example questions plus edge cases, added to the user turns of the log.
EXAMPLE_QUERIES = [
    "Find structuring patterns in the last 30 days",
    "Which customers made 10+ transactions under $10,000?",
    "Is customer ID 4521 suspicious?",
    "Is customer ID CUST999999 suspicious?",
    "Tell me about transaction trends",
    "Show me the top 5 customers by volume",
    "CUST4521 transactions",
    "Any layering through wire transfers? limit 3",
    "What's the weather today?",
    "cash deposit overview chart",
    "What about customer 1234567?",
    "customer 12 or customer id: 77001",
]


def _example_sql() -> str:
    rows = ", ".join("('" + q.replace("'", "''") + "')" for q in EXAMPLE_QUERIES)
    return f"SELECT text FROM conversations WHERE role = 'user' UNION ALL SELECT * FROM (VALUES {rows}) v(text)"


def _queries(spark, sf):
    conv = table(spark, sf, "conversations").filter(F.col("role") == "user").select("text")
    return conv.unionByName(spark.createDataFrame([(q,) for q in EXAMPLE_QUERIES], "text STRING"))


# A number of 3 to 6 digits after the word; written out, since DuckDB's expressions have no look-ahead.
_ENT = ("list_filter(regexp_extract_all(text, '(?i)(?:customer\\s*(?:id)?\\s*[:#]?\\s*|cust\\s*)([0-9]+)', 1), "
        "lambda x: length(x) BETWEEN 3 AND 6)[1]")


@register("tag_entity_id", f"""SELECT text, 'CUST' || {_ENT} AS entity_id FROM ({_example_sql()}) q""")
def q_tag_entity_id(spark, sf):
    return tag_queries(_queries(spark, sf)).select("text", "entity_id")


def _num_sql(pattern: str, typ: str = "BIGINT") -> str:
    g = f"regexp_extract(lower(text), '{pattern}', 1)"
    return f"CASE WHEN {g} <> '' THEN TRY_CAST(replace({g}, ',', '') AS {typ}) END"


# Patterns and words of the statements below are written out here, apart from the library's own.
_DAYS, _COUNT, _AMOUNT, _LIMIT = "last\\s+([0-9]+)\\s+days?", "([0-9]+)\\+?\\s*transactions?", "under\\s*\\$?([0-9,]+)", "(?:top|limit)\\s+([0-9]+)"


@register("tag_limits", f"""SELECT text, {_num_sql(_DAYS)} AS last_n_days,
  {_num_sql(_COUNT)} AS min_transaction_count,
  {_num_sql(_AMOUNT, 'DOUBLE')} AS amount_threshold,
  {_num_sql(_LIMIT)} AS "limit" FROM ({_example_sql()}) q""")
def q_tag_limits(spark, sf):
    return tag_queries(_queries(spark, sf)).select("text", "last_n_days", "min_transaction_count",
                                                   "amount_threshold", "limit")


_PARSER_WORDS = ("transaction customer money laundering bank account structuring smurfing layering deposit withdrawal transfer fraud "
                 "suspicious check eda summary overview txns aml").split()
_CAP_WORDS = _PARSER_WORDS + "flag risk data dataset table csv pattern activity".split()
_EDA = "chart graph plot visual eda summary overview".split()


def _any(words):
    return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


_INTENT_SQL = f"""SELECT text,
  CASE WHEN ood THEN 'out_of_domain' ELSE intent END AS intent_type, target_pattern,
  (NOT ood AND (intent = 'broad_exploration' OR eda_kw)) OR {_any(_EDA)} AS requires_full_eda,
  (NOT ood AND (intent = 'broad_exploration' OR eda_kw)) AS requires_ml_detection
FROM (SELECT *, (NOT {_any(_PARSER_WORDS)} AND intent = 'broad_exploration' AND NOT has_ent) AS ood FROM (
  SELECT text, has_ent, eda_kw,
    CASE WHEN st OR ly OR cd THEN 'pattern_search' WHEN lim OR cnt OR amt THEN 'aggregation_query'
         WHEN has_ent THEN 'entity_lookup' ELSE 'broad_exploration' END AS intent,
    CASE WHEN st THEN 'structuring' WHEN ly THEN 'layering' WHEN cd THEN 'structuring' ELSE 'none' END
      AS target_pattern
  FROM (SELECT text, {_ENT} IS NOT NULL AS has_ent,
          regexp_extract(lower(text), '{_COUNT}', 0) <> '' AS cnt,
          regexp_extract(lower(text), '{_AMOUNT}', 1) <> '' AS amt,
          regexp_extract(lower(text), '{_LIMIT}', 1) <> '' AS lim,
          contains(lower(text), 'structur') OR contains(lower(text), 'smurf') AS st,
          contains(lower(text), 'layer') AS ly,
          contains(lower(text), 'cash') AND contains(lower(text), 'deposit') AS cd,
          contains(lower(text), 'eda') OR contains(lower(text), 'summary') OR contains(lower(text), 'overview')
            AS eda_kw
        FROM ({_example_sql()}) q) a) b) c"""


@register("tag_intent", _INTENT_SQL)
def q_tag_intent(spark, sf):
    return tag_queries(_queries(spark, sf)).select("text", "intent_type", "target_pattern", "requires_full_eda",
                                                   "requires_ml_detection")


@register("filter_in_domain", f"""SELECT text FROM ({_example_sql()}) q
  WHERE {_any(_CAP_WORDS)} OR {_ENT} IS NOT NULL""")
def q_filter_in_domain(spark, sf):
    return filter_in_domain(_queries(spark, sf)).select("text")


@register("win_query_pairs", """WITH c AS (
  SELECT conv_id, turn, role, text,
         max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg FROM conversations),
q AS (SELECT conv_id, turn AS query_pos, text AS query_text FROM c WHERE role = 'user'),
r AS (SELECT conv_id, seg AS query_pos, arg_min(turn, turn) AS response_pos, arg_min(text, turn) AS response_text
      FROM c WHERE role = 'assistant' AND seg IS NOT NULL GROUP BY 1, 2)
SELECT q.conv_id, q.query_pos, q.query_text, r.response_pos, r.response_text
FROM q LEFT JOIN r ON q.conv_id = r.conv_id AND q.query_pos = r.query_pos""")
def q_win_query_pairs(spark, sf):
    c = table(spark, sf, "conversations")
    return pair_queries_responses(c, "conv_id", "turn", F.col("role") == "user", F.col("role") == "assistant",
                                  "text").select("conv_id", "query_pos", "query_text", "response_pos",
                                                 "response_text")


@register("win_query_pairs_equal", """WITH l AS (
  SELECT conv_id, 2 * turn AS pos, 'query' AS kind, text FROM conversations WHERE role = 'user'
  UNION ALL SELECT conv_id, 2 * turn + 1, 'response', CASE WHEN turn % 4 = 0 THEN text ELSE 'other' END FROM conversations WHERE role = 'user')
SELECT q.conv_id, q.pos AS query_pos, q.text AS query_text, min(r.pos) AS response_pos FROM l q
LEFT JOIN l r ON r.conv_id = q.conv_id AND r.kind = 'response' AND r.text = q.text AND r.pos > q.pos
  AND NOT EXISTS (SELECT 1 FROM l x WHERE x.conv_id = q.conv_id AND x.kind = 'query' AND x.pos > q.pos AND x.pos < r.pos)
WHERE q.kind = 'query' GROUP BY 1, 2, 3""")
def q_win_query_pairs_equal(spark, sf):
    """The audit-log form: a response is of a query if it repeats the query's text (stand-in log of user turns)."""
    c = table(spark, sf, "conversations").where("role = 'user'")
    log = c.select("conv_id", F.explode(F.array(
        F.struct((F.col("turn") * 2).alias("pos"), F.lit("query").alias("kind"), "text"),
        F.struct((F.col("turn") * 2 + 1).alias("pos"), F.lit("response").alias("kind"),
                 F.when(F.col("turn") % 4 == 0, F.col("text")).otherwise(F.lit("other")).alias("text")))).alias("e")).select("conv_id", "e.*")
    return pair_queries_responses(log, "conv_id", "pos", F.col("kind") == "query", F.col("kind") == "response", "text", match=True).select(
        "conv_id", "query_pos", "query_text", "response_pos")


@register("last_n_per_key", """WITH r AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rk FROM conversations)
SELECT conv_id, count(*) AS kept_messages,
  string_agg(CASE WHEN rk <= 3 THEN upper(substr(role, 1, 1)) || lower(substr(role, 2)) || ': ' || text END, '\n'
             ORDER BY turn) AS context_text,
  count(*) FILTER (WHERE rk <= 3) AS context_messages
FROM r WHERE rk <= 10 GROUP BY conv_id""")
def q_last_n_per_key(spark, sf):
    c = table(spark, sf, "conversations")
    return session_context(c, "conv_id", "turn", "role", "text").select(
        "conv_id", "kept_messages", "context_text", "context_messages")
