"""SQL for the queries of edge_queries."""

from __future__ import annotations

from ledgerloom import edge_queries
from ledgerloom.functions import text
from ledgerloom.oracles import KEYWORD, ORACLES, TXN, _list, _money, _pick, _r
from ledgerloom.sources import lenses

_NATURE = f"""f AS ({ORACLES["c8_find_recurring"]}), n AS (SELECT p_name || ' ' || p_partkey AS m, {_pick(("subscription", "bill", "habitual", "nonsense"), "p_partkey // 2")} AS v FROM part WHERE p_partkey % 2 = 0),
g AS (SELECT f.merchant, f.category, f.annual_cost, CASE f.category WHEN 'Subscriptions' THEN 'subscription' WHEN 'Utilities' THEN 'bill' WHEN 'Housing' THEN 'bill'
  WHEN 'Food & Drink' THEN 'habitual' WHEN 'Groceries' THEN 'habitual' WHEN 'Transportation' THEN 'habitual' WHEN 'Shopping' THEN 'habitual'
  ELSE coalesce(nullif(n.v, 'nonsense'), 'unclear') END AS nature FROM f LEFT JOIN n ON f.merchant = n.m)"""
_PART = f"p AS (SELECT CASE WHEN p_partkey % 9 = 0 THEN 'Cheque ' ELSE '' END || 'm' || p_partkey AS merchant, {_pick(text.CATEGORIES, 'p_partkey')} AS category FROM part)"
_KNOWN = _list(lenses.DESCRIPTIONS[::3])
_LAYERS = f"""{TXN}, x AS (SELECT * REPLACE (CASE WHEN pos % 4 = 0 THEN 'ITEM ' || (pos // 4) % 12 ELSE description END AS description, CASE WHEN pos % 8 <> 0 THEN merchant END AS merchant) FROM txn),
says(description, said, sure) AS (VALUES ('ITEM 0', 'Food & Drink', true), ('ITEM 1', 'Transportation', false), ('ITEM 2', 'Entertainment', true), ('ITEM 4', 'Health', false), ('ITEM 6', 'Utilities', false)),
w AS (SELECT x.* EXCLUDE (category), TRY_CAST(replace(merchant, 'Shop ', '') AS INT) AS shop, said, coalesce(sure, false) AS sure, {KEYWORD} AS word,
  CASE WHEN pos % 5 = 0 THEN ['Health', 'Transportation', NULL, 'Other'][CAST(pos // 20 % 4 + 1 AS INT)] END AS opinion FROM x LEFT JOIN says USING (description)),
e AS (SELECT *, CASE WHEN merchant <> '' THEN first_value(coalesce(word, CASE WHEN sure THEN said END) IGNORE NULLS) OVER (PARTITION BY merchant ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS earlier FROM w),
l AS (SELECT *, CASE WHEN shop < 25 THEN ['dict', 'Shopping', '1'] WHEN shop < 45 THEN ['cache', 'Travel', '0.9'] WHEN earlier IS NOT NULL THEN ['cache', earlier, '0.9'] WHEN word IS NOT NULL THEN ['keyword', word, '0.95']
  WHEN sure THEN ['enriched', said, '0.85'] WHEN opinion = said THEN ['agreed', said, '0.85'] WHEN opinion IS NOT NULL THEN ['arbitrated', opinion, '0.75'] WHEN said IS NOT NULL THEN ['enriched_low', said, '0.5'] ELSE ['fallback', 'Other', '0'] END AS a FROM e)"""

ORACLES.update({
    "c4_all_layers": f"WITH {_LAYERS} SELECT id, a[2] AS category, CAST(a[3] AS DOUBLE) AS confidence, a[1] AS layer FROM l",
    "c13_dashboard_lists": f"""WITH {_NATURE}, h AS (SELECT g.*, f.price_change_pct FROM g JOIN f USING (merchant))
  SELECT CASE WHEN nature IN ('subscription', 'bill') THEN 'subscriptions' ELSE 'repeated' END AS block, merchant AS key, annual_cost AS value FROM h
  UNION ALL SELECT 'recurring_totals', nature, {_r(_money("annual_cost"))} FROM h GROUP BY 2
  UNION ALL SELECT 'price_increases', merchant, price_change_pct FROM h WHERE price_change_pct > 0
  UNION ALL SELECT 'payoff', key || ' ' || label, total_interest FROM ({ORACLES["c11_payoff_scenarios"]})""",
    "g10_account_numbers": """SELECT c_custkey AS page, CASE c_custkey % 3 WHEN 0 THEN '12-' || lpad(CAST(c_custkey AS VARCHAR), 7, '0')
  WHEN 1 THEN '005-' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') ELSE '987654321' END AS account_number FROM customer""",
    "f13_odd_keys": """SELECT s_suppkey AS statement_id, 'Bank ' || s_suppkey AS bank_name, CASE WHEN s_suppkey % 4 = 0 THEN 'EUR' ELSE 'GBP' END AS currency, '2024-01-05' AS statement_period_start,
  '2024-02-04' AS statement_period_end, '2024-01-14' AS date, s_name AS description, CASE WHEN s_suppkey % 2 = 0 THEN abs(s_acctbal) END AS withdrawal, CASE WHEN s_suppkey % 2 = 1 THEN abs(s_acctbal) END AS deposit FROM supplier""",
    "s4_page_lists": """SELECT c_custkey AS key, u AS unit, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 3 END AS pages, CASE WHEN c_custkey % 2 = 0 THEN u + 1 ELSE 6 END AS rows
  FROM (SELECT c_custkey, unnest(CASE WHEN c_custkey % 2 = 0 THEN [0, 1, 2] ELSE [0] END) AS u FROM customer)""",
    "p16_card_rates": """SELECT 'c' || k AS statement_id, CASE k % 5 WHEN 0 THEN 'checking' WHEN 1 THEN 'credit' WHEN 2 THEN 'savings' WHEN 3 THEN 'checking' ELSE 'unknown' END AS account_type,
  CASE WHEN k % 5 = 1 THEN CAST(k % 25 + 4.99 AS DOUBLE) END AS apr FROM (SELECT DISTINCT o_custkey AS k FROM orders)""",
    "c9_natures": f"WITH {_NATURE} SELECT merchant, category, nature FROM g",
    "o9_repeated_spending": f"WITH {_NATURE} SELECT merchant, annual_cost FROM g WHERE nature NOT IN ('subscription', 'bill')",
    "c19_natures_to_ask": f"WITH {_PART} SELECT merchant, category FROM p WHERE category IN ('Health', 'Entertainment', 'Education', 'Travel', 'Other') AND merchant NOT LIKE 'Cheque %' AND merchant NOT LIKE '%5'",
    "c19_learned_natures": f"""WITH n AS (SELECT 'm' || n_nationkey AS merchant, 'bill' AS nature FROM nation),
  p AS (SELECT 'm' || (p_partkey % 700) AS merchant, {_pick(("subscription", "bill", "unclear", "habitual", "?"), "p_partkey")} AS nature FROM part)
  SELECT * FROM n UNION ALL SELECT merchant, min(nature) FROM p WHERE nature IN ('subscription', 'bill', 'habitual') AND merchant NOT IN (SELECT merchant FROM n) GROUP BY merchant""",
    "a18_descriptions_to_ask": f"WITH {TXN} SELECT DISTINCT description FROM txn WHERE NOT list_contains({_KNOWN}, description)",
    "c19_learned_aliases": f"""SELECT unnest({_KNOWN}) AS raw_description, 'M' AS merchant, 'c' AS category, '90' AS confidence, 'enrichment' AS source UNION ALL
  SELECT 'd' || k, CASE WHEN k % 3 <> 0 THEN 'm' || k ELSE '' END, 'shop', CAST(k % 100 AS VARCHAR), CASE WHEN k % 3 <> 0 THEN 'enrichment' ELSE 'nomerchant' END
  FROM (SELECT DISTINCT o_orderkey % 500 AS k FROM orders) WHERE k % 7 <> 0""",
    "o1_page_total": f"WITH {TXN} SELECT 'all' AS page, count(*) AS total FROM txn UNION ALL SELECT 'urgent', count(*) FROM txn WHERE category = '1-URGENT'",
    "o8_top_categories": f"SELECT * FROM ({ORACLES['a2_by_category']}) ORDER BY amount DESC, category LIMIT 8",
    "w9_month_over_month": f"""WITH m AS ({ORACLES["a3_by_month"]}) SELECT a.month, a.amount, b.amount AS previous, {_r("a.amount - b.amount")} AS change,
  CASE WHEN b.amount <> 0 THEN {_r("(a.amount - b.amount) / b.amount * 100", 1)} END AS change_pct
  FROM m a LEFT JOIN m b ON a.month = strftime(CAST(b.month || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m')""",
    "f33_row_dates": """SELECT o_orderkey AS key, CASE WHEN o_orderkey % 7 < 6 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date,
  CASE o_orderkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 3 WHEN 4 THEN 2 WHEN 5 THEN 2 ELSE 0 END AS used FROM orders""",
    "g4_header_rows": "SELECT o_orderkey AS page, 1 AS row, CASE WHEN o_orderkey % 2 = 0 THEN 'balance,date,description,withdrawal' ELSE 'balance,date,deposit,description' END AS roles FROM orders",
    "g5_column_labels": """SELECT o_orderkey AS page, CASE WHEN o_orderkey % 3 <> 0 THEN 2 ELSE 1 END AS n, CASE WHEN o_orderkey % 3 <> 0 THEN 503.0::DOUBLE ELSE 301.0::DOUBLE END AS last_edge,
  CASE WHEN o_orderkey % 3 = 0 THEN 'balance' WHEN o_orderkey % 2 = 0 THEN 'withdrawal,balance' ELSE 'deposit,balance' END AS labels FROM orders""",
    "f21_generated_statements": ORACLES["c1_adapt_rows"],
    "q1_refusals": "SELECT * FROM (VALUES " + ", ".join("('" + s.replace("'", "''") + f"', {str(r).lower()})" for s, r in edge_queries.STATEMENTS) + ") t(statement, refused)",
    "st2_doubled_stream": ORACLES["st2_deduplicated_stream"],
})
