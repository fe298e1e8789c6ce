"""Registered graph queries, over all transfers."""

from __future__ import annotations

from ledgerscope.operators.graph import (build_transfer_graph, detect_cycles, detect_layering, distinct_nodes, enumerate_chains,
                                         hop_summary, least_chains)
from ledgerscope.plans.registry import register
from ledgerscope.plans.sqlviews import ORDERS_TRANSFER_CTE, TXN_CTE, with_ctes
from ledgerscope.sources.tables import orders_transfer_view, txn_view

GRAPH_CTE = """own AS (
  SELECT account_id, customer_id AS owner FROM (
    SELECT account_id, customer_id, row_number() OVER (PARTITION BY account_id
           ORDER BY timestamp DESC, transaction_id DESC) AS rn FROM txn) WHERE rn = 1),
tr AS (
  SELECT t.transaction_id, t.timestamp, t.amount, coalesce(o1.owner, t.account_id) AS src,
         coalesce(o2.owner, t.counterparty_id) AS dst
  FROM txn t LEFT JOIN own o1 ON o1.account_id = t.account_id LEFT JOIN own o2 ON o2.account_id = t.counterparty_id
  WHERE lower(t.transaction_type) = 'transfer' AND t.counterparty_id IS NOT NULL),
edges AS (
  SELECT src, dst, transaction_id AS txn_id, CAST(amount AS DOUBLE) AS amount FROM (
    SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY timestamp DESC, transaction_id DESC) AS rn
    FROM tr WHERE src <> dst) WHERE rn = 1)"""

LAYERING_SELECT = """, p2 AS (
  SELECT e1.src AS a, e1.dst AS b, e2.dst AS c, e1.txn_id AS t1, e2.txn_id AS t2
  FROM edges e1 JOIN edges e2 ON e1.dst = e2.src WHERE e2.dst <> e1.src),
best AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY b, c) AS rn FROM p2)
SELECT a AS customer_id, 'layering' AS rule_fired, a || '->' || b || '->' || c AS chain,
       t1 || ',' || t2 AS supporting_txn_ids, CAST(2 AS BIGINT) AS txn_count, CAST(NULL AS DOUBLE) AS total_amount,
       85.0 AS rule_score FROM best WHERE rn = 1"""


#: Transfers above this amount make the sparser graph of ``cycle_members``, most of which lies outside its cyclic core.
LARGE_TRANSFER = 300_000.0


def _graph_sql(select: str, txn: str = TXN_CTE, min_amount: float | None = None) -> str:
    s = with_ctes("SELECT 1", txn, GRAPH_CTE)
    if min_amount is not None:
        s = s.replace("AND t.counterparty_id IS NOT NULL", f"AND t.counterparty_id IS NOT NULL AND t.amount >= {min_amount}")
    return s[: -len("SELECT 1")].rstrip() + select


def _order_edges(spark, sf, min_amount=None):
    return build_transfer_graph(orders_transfer_view(spark, sf), min_amount)


def _edges(spark, sf):
    return build_transfer_graph(txn_view(spark, sf))


@register("build_transfer_graph", _graph_sql("\nSELECT * FROM edges"))
def q_build_graph(spark, sf):
    return _edges(spark, sf)


@register("filter_transfers", with_ctes(
    "SELECT transaction_id, customer_id, counterparty_id, CAST(amount AS DOUBLE) AS amount FROM txn "
    "WHERE lower(transaction_type) = 'transfer' AND counterparty_id IS NOT NULL", TXN_CTE))
def q_filter_transfers(spark, sf):
    from pyspark.sql import functions as F
    from ledgerscope.operators.filters import filter_transfers
    return filter_transfers(txn_view(spark, sf)).select("transaction_id", "customer_id", "counterparty_id",
                                                        F.col("amount").cast("double").alias("amount"))


@register("join_account_owner", _graph_sql("\nSELECT account_id, owner FROM own"))
def q_account_owner(spark, sf):
    from ledgerscope.operators.graph import account_owners
    return account_owners(txn_view(spark, sf))


@register("detect_layering", _graph_sql(LAYERING_SELECT))
def q_detect_layering(spark, sf):
    return detect_layering(_edges(spark, sf))


@register("distinct_nodes", _graph_sql("\nSELECT src AS node FROM edges UNION SELECT dst FROM edges"))
def q_distinct_nodes(spark, sf):
    return distinct_nodes(_edges(spark, sf))


CHAINS_SELECT = """, p2 AS (
  SELECT e1.src AS n0, e1.dst AS n1, e2.dst AS n2, e1.txn_id AS t1, e2.txn_id AS t2
  FROM edges e1 JOIN edges e2 ON e1.dst = e2.src WHERE e2.dst <> e1.src),
b2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n0 ORDER BY n1, n2) AS rn FROM p2) WHERE rn = 1),
b3 AS (
  SELECT b2.*, x.dst AS n3, x.txn_id AS t3 FROM b2 LEFT JOIN (
    SELECT b.n0 AS k, min(e.dst) AS dst, arg_min(e.txn_id, e.dst) AS txn_id FROM b2 b JOIN edges e ON e.src = b.n2
    WHERE e.dst NOT IN (b.n0, b.n1, b.n2) GROUP BY b.n0) x ON x.k = b2.n0),
b4 AS (
  SELECT b3.*, x.dst AS n4, x.txn_id AS t4 FROM b3 LEFT JOIN (
    SELECT b.n0 AS k, min(e.dst) AS dst, arg_min(e.txn_id, e.dst) AS txn_id FROM b3 b JOIN edges e ON e.src = b.n3
    WHERE e.dst NOT IN (b.n0, b.n1, b.n2, b.n3) GROUP BY b.n0) x ON x.k = b3.n0)
SELECT n0 AS originator, coalesce(n4, n3, n2) AS target, 2 + (n3 IS NOT NULL)::INTEGER + (n4 IS NOT NULL)::INTEGER AS hops,
  concat_ws('->', n0, n1, n2, n3, n4) AS chain, concat_ws(',', t1, t2, t3, t4) AS txn_ids FROM b4"""


@register("least_chains", _graph_sql(CHAINS_SELECT))
def q_least_chains(spark, sf):
    return least_chains(_edges(spark, sf))


# Every simple path of two to four transfers, then counted by its edges.
PATHS_SELECT = """, p2 AS (
  SELECT a.src AS n0, a.dst AS n1, b.dst AS n2 FROM edges a JOIN edges b ON b.src = a.dst WHERE b.dst <> a.src),
p3 AS (SELECT p2.*, e.dst AS n3 FROM p2 JOIN edges e ON e.src = n2 WHERE e.dst NOT IN (n0, n1)),
p4 AS (SELECT p3.*, e.dst AS n4 FROM p3 JOIN edges e ON e.src = n3 WHERE e.dst NOT IN (n0, n1, n2))"""
CHAIN_RELATION_SELECT = PATHS_SELECT + """, hops AS (
  SELECT 1 AS hop, n0 AS src, n1 AS dst, count(*) AS paths FROM p2 GROUP BY n0, n1 UNION ALL
  SELECT 2, n1, n2, count(*) FROM p2 GROUP BY n1, n2 UNION ALL
  SELECT 1, n0, n1, count(*) FROM p3 GROUP BY n0, n1 UNION ALL
  SELECT 2, n1, n2, count(*) FROM p3 GROUP BY n1, n2 UNION ALL
  SELECT 3, n2, n3, count(*) FROM p3 GROUP BY n2, n3 UNION ALL
  SELECT 1, n0, n1, count(*) FROM p4 GROUP BY n0, n1 UNION ALL
  SELECT 2, n1, n2, count(*) FROM p4 GROUP BY n1, n2 UNION ALL
  SELECT 3, n2, n3, count(*) FROM p4 GROUP BY n2, n3 UNION ALL
  SELECT 4, n3, n4, count(*) FROM p4 GROUP BY n3, n4)
SELECT hop, src, dst, any_value(txn_id) AS txn_id, sum(paths)::BIGINT AS paths FROM hops JOIN edges USING (src, dst) GROUP BY hop, src, dst"""


@register("enumerate_chains", _graph_sql(CHAIN_RELATION_SELECT, ORDERS_TRANSFER_CTE))
def q_enumerate_chains(spark, sf):
    """All simple paths of two to four transfers, as paths through each edge and hop."""
    return enumerate_chains(_order_edges(spark, sf))


HOPS_SELECT = PATHS_SELECT + """
SELECT customer_id, receivers, coalesce(x2, 0) AS two_hop_paths, coalesce(x3, 0) AS three_hop_paths, coalesce(x4, 0) AS four_hop_paths
FROM (SELECT src AS customer_id, count(*) AS receivers FROM edges GROUP BY src)
LEFT JOIN (SELECT n0, count(*) AS x2 FROM p2 GROUP BY n0) a ON a.n0 = customer_id
LEFT JOIN (SELECT n0, count(*) AS x3 FROM p3 GROUP BY n0) b ON b.n0 = customer_id
LEFT JOIN (SELECT n0, count(*) AS x4 FROM p4 GROUP BY n0) c ON c.n0 = customer_id"""


@register("self_join_hops", _graph_sql(HOPS_SELECT))
def q_self_join_hops(spark, sf):
    return hop_summary(_edges(spark, sf))


@register("self_join_hops_orders", _graph_sql(HOPS_SELECT, ORDERS_TRANSFER_CTE))
def q_self_join_hops_orders(spark, sf):
    """The same over the denser graph, where reciprocal transfers, triangles and cycles of four occur."""
    return hop_summary(_order_edges(spark, sf))


MEMBERS_SELECT = """, k AS (
  SELECT 3 AS length, e1.src AS n0, e1.dst AS n1, e2.dst AS n2, NULL AS n3, e1.txn_id AS t1, e2.txn_id AS t2, e3.txn_id AS t3, NULL AS t4
  FROM edges e1 JOIN edges e2 ON e1.dst = e2.src JOIN edges e3 ON e2.dst = e3.src AND e3.dst = e1.src
  UNION ALL
  SELECT 4, e1.src, e1.dst, e2.dst, e3.dst, e1.txn_id, e2.txn_id, e3.txn_id, e4.txn_id
  FROM edges e1 JOIN edges e2 ON e1.dst = e2.src JOIN edges e3 ON e2.dst = e3.src JOIN edges e4 ON e3.dst = e4.src AND e4.dst = e1.src
  WHERE e2.dst <> e1.src AND e3.dst <> e1.dst)
SELECT n0 AS cycle_start, length, concat_ws('->', n0, n1, n2, n3, n0) AS cycle, concat_ws(',', t1, t2, t3, t4) AS txn_ids
FROM (SELECT *, row_number() OVER (PARTITION BY n0 ORDER BY length, n1, n2, n3) AS rn FROM k) WHERE rn = 1"""


@register("detect_cycles", _graph_sql(MEMBERS_SELECT, ORDERS_TRANSFER_CTE))
def q_detect_cycles(spark, sf):
    """Every member of a closed cycle of three or four, with its least one."""
    return detect_cycles(_order_edges(spark, sf))


@register("cycle_members", _graph_sql(MEMBERS_SELECT.replace("n0 AS cycle_start", "n0 AS customer_id"), ORDERS_TRANSFER_CTE, LARGE_TRANSFER))
def q_cycle_members(spark, sf):
    """The same among large transfers only, named by customer."""
    return detect_cycles(_order_edges(spark, sf, LARGE_TRANSFER)).withColumnRenamed("cycle_start", "customer_id")


_PATTERN_LAYERING_SELECT = LAYERING_SELECT.replace(
    "SELECT a AS customer_id, 'layering' AS rule_fired", ", lay AS (SELECT a AS customer_id, 'layering' AS rule_fired"
).rstrip() + ")"


def _pipeline_layering_sql():
    from ledgerscope.plans.sqlparts import action_sql, explanation_sql, risk_level_sql, risk_score_sql
    lvl = risk_level_sql("75.0 + 10.0", "'layering'")
    return _graph_sql(_PATTERN_LAYERING_SELECT + f"""
SELECT customer_id, 'Partial' AS agreement, 'Rule Violation' AS verdict, 'layering' AS pattern_matched,
  round(rule_score, 1) AS rule_score, {risk_score_sql('greatest(rule_score, 75.0)', "'layering'")} AS risk_score,
  {risk_level_sql('greatest(rule_score, 75.0)', "'layering'")} AS risk_level,
  {action_sql(risk_level_sql('greatest(rule_score, 75.0)', "'layering'"))} AS recommended_action,
  85.0 AS confidence, 80.0 AS trust_score, CAST(2 AS BIGINT) AS evidence_count,
  {explanation_sql('customer_id', "'layering'", lvl, '2', 'NULL')} AS explanation FROM lay""")


@register("pipeline_layering", _pipeline_layering_sql())
def q_pipeline_layering(spark, sf):
    """Pattern query for layering: transfer chains -> consensus (rule only) -> risk -> action -> explanation."""
    from ledgerscope.plans.pipelines import pipeline_pattern
    return pipeline_pattern(txn_view(spark, sf), "layering")
