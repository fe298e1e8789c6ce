"""DuckDB SQL of the stand-in views, used by the oracle statements.

The same column expressions as ``ledgerscope.sources.tables``; see FIXTURES.md B1.
"""

TXN_CTE = """txn AS (
  SELECT 'TXN' || printf('%09d', e.event_id) AS transaction_id,
         'CUST' || printf('%05d', e.user_id) AS customer_id,
         'ACC_CUST' || printf('%05d', e.user_id) AS account_id,
         CAST(e.ts AS TIMESTAMP) AS timestamp,
         CAST(CAST(e.value AS DECIMAL(18,2)) * 200 AS DECIMAL(18,2)) AS amount,
         'USD' AS currency,
         CASE e.event_type WHEN 'purchase' THEN 'transfer' WHEN 'click' THEN 'cash_deposit'
              WHEN 'view' THEN 'deposit' WHEN 'signup' THEN 'withdrawal' WHEN 'error' THEN 'fee' END
           AS transaction_type,
         ['branch','atm','wire','online'][CAST((e.event_id % 4) + 1 AS INTEGER)] AS channel,
         CASE WHEN e.event_type = 'purchase'
              THEN 'ACC_CUST' || printf('%05d', (e.event_id * 31 + 7) % (SELECT count(*) FROM customer)) END AS counterparty_id,
         n.n_name AS country,
         c.c_mktsegment AS customer_segment
  FROM events e
  LEFT JOIN customer c ON c.c_custkey = e.user_id
  LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey)"""

ORDERS_TXN_CTE = """otxn AS (
  SELECT 'ORD' || printf('%09d', o.o_orderkey) AS transaction_id,
         'CUST' || printf('%05d', o.o_custkey) AS customer_id,
         CAST(o.o_orderdate AS TIMESTAMP) AS timestamp,
         CAST(o.o_totalprice AS DECIMAL(18,2)) AS amount,
         n.n_name AS country, c.c_mktsegment AS customer_segment
  FROM orders o
  LEFT JOIN customer c ON c.c_custkey = o.o_custkey
  LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey)"""

ORDERS_TRANSFER_CTE = """txn AS (
  SELECT 'ORD' || printf('%09d', o_orderkey) AS transaction_id,
         'CUST' || printf('%05d', o_custkey) AS customer_id,
         'ACC_CUST' || printf('%05d', o_custkey) AS account_id,
         CAST(o_orderdate AS TIMESTAMP) AS timestamp,
         CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
         'transfer' AS transaction_type,
         'ACC_CUST' || printf('%05d', (o_orderkey * 31 + 7) % (SELECT count(*) FROM customer)) AS counterparty_id
  FROM orders)"""

FEATURES_CTE = """stats AS (
  SELECT customer_id, avg(CAST(amount AS DOUBLE)) AS amount_mean,
         CASE WHEN stddev_samp(CAST(amount AS DOUBLE)) IS NULL OR stddev_samp(CAST(amount AS DOUBLE)) = 0
              THEN 1.0 ELSE stddev_samp(CAST(amount AS DOUBLE)) END AS amount_std
  FROM {src} GROUP BY customer_id),
feat AS (
  SELECT t.*,
         (t.amount >= {lo} AND t.amount < {hi}) AS is_just_under_threshold,
         (CAST(t.amount AS DOUBLE) - s.amount_mean) / (s.amount_std + 1e-6) AS amount_zscore_vs_customer_avg,
         coalesce(CAST(epoch_us(t.timestamp) - epoch_us(lag(t.timestamp) OVER (PARTITION BY t.customer_id
                  ORDER BY t.timestamp, t.transaction_id)) AS DOUBLE) / 3600000000.0, 9999.0)
           AS velocity_hours_since_last_txn,
         count(t.transaction_id) OVER (PARTITION BY t.customer_id ORDER BY epoch_us(t.timestamp)
           RANGE BETWEEN 604799999999 PRECEDING AND CURRENT ROW) AS rolling_7d_count,
         CAST(sum(t.amount) OVER (PARTITION BY t.customer_id ORDER BY epoch_us(t.timestamp)
           RANGE BETWEEN 2591999999999 PRECEDING AND CURRENT ROW) AS DOUBLE) AS rolling_30d_sum
  FROM {src} t JOIN stats s USING (customer_id))"""

STRUCTURING_CTE = """ju AS (
  SELECT customer_id, transaction_id, amount, timestamp FROM {src} WHERE amount >= {lo} AND amount < {hi}),
juw AS (
  SELECT *, count(transaction_id) OVER (PARTITION BY customer_id ORDER BY epoch_us(timestamp)
            RANGE BETWEEN {win_us_m1} PRECEDING AND CURRENT ROW) AS window_count FROM ju),
hits AS (
  SELECT customer_id, 'structuring' AS rule_fired, count(transaction_id) AS txn_count,
         CAST(round(sum(amount), 2) AS DOUBLE) AS total_amount,
         round(least(100.0, 70.0 + max(window_count) * 3.0), 1) AS rule_score,
         max(window_count) AS max_window_count
  FROM juw GROUP BY customer_id HAVING max(window_count) >= {min_count})"""


def with_ctes(select: str, *ctes: str, src: str = "txn", **subs) -> str:
    subs = {"src": src, **subs}
    parts = []
    for c in ctes:
        for k, v in subs.items():
            c = c.replace("{" + k + "}", str(v))
        parts.append(c)
    return "WITH " + ",\n".join(parts) + "\n" + select


def structuring_subs(p) -> dict:
    return {"lo": p.structuring_lower_bound, "hi": p.structuring_threshold,
            "win_us_m1": p.structuring_window_days * 86_400_000_000 - 1, "min_count": p.structuring_min_count}
