"""SQL for the ledger queries, written apart from their DataFrame code, for an engine that reads the same tables."""

from __future__ import annotations

from ledgerloom.functions import text
from ledgerloom.operators import categorize, payoff, recurring
from ledgerloom.sources import lenses


def _r(x: str, digits: int = 2) -> str:
    return f"(CAST(printf('%.{digits}f', {x}) AS DOUBLE) + 0.0)"


def _list(values: tuple) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in values) + "]"


def _pick(values: tuple, index: str) -> str:
    return f"{_list(values)}[CAST(({index}) % {len(values)} + 1 AS INT)]"


def _money(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(18,2))) AS DOUBLE)"


TXN = f"""txn AS (SELECT o_orderkey AS pos, 't' || o_orderkey AS id, 'c' || o_custkey AS account_id, CAST(o_orderdate AS DATE) AS date,
  {_pick(lenses.DESCRIPTIONS, "o_orderkey")} AS description,
  CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE 'Shop ' || (o_custkey % 400) END AS merchant,
  CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS category,
  CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END AS amount,
  CASE WHEN o_orderkey % 3 <> 0 THEN lpad(CAST(o_orderkey % 100 AS VARCHAR), 4, '0') END AS reference,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 5 = 0 END AS is_transfer FROM orders)"""
SPENT = "NOT coalesce(is_transfer, false)"
KIND = "CASE k % 5 WHEN 0 THEN 'checking' WHEN 1 THEN 'credit' WHEN 2 THEN 'savings' WHEN 3 THEN 'checking' ELSE 'unknown' END"
ACC = f"""acc AS (SELECT c_custkey AS key, 'c' || c_custkey AS id, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS bank_name,
  {KIND.replace("k %", "c_custkey %")} AS account_type, lpad(CAST(c_custkey AS VARCHAR), 7, '0')[-4:] AS account_last4,
  c_acctbal AS closing_balance, CASE WHEN c_custkey % 5 = 1 THEN c_custkey % 25 + CAST(4.99 AS DOUBLE) END AS apr FROM customer)"""
LINES = f"""s0 AS (SELECT 'c' || o_custkey AS statement_id, o_custkey AS key, o_orderkey AS row_key, CAST(o_orderdate AS DATE) AS date,
  CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS deposit, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS withdrawal,
  {_pick(lenses.DESCRIPTIONS, "o_orderkey")} AS description,
  CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END AS amount,
  CASE WHEN o_custkey % 5 = 1 THEN -1 ELSE 1 END AS sign FROM orders),
s1 AS (SELECT *, CAST(row_number() OVER w AS INT) - 1 AS pos, CAST(1000 + sum(CAST(amount AS DECIMAL(18,2)) * sign) OVER w AS DOUBLE) AS running
  FROM s0 WINDOW w AS (PARTITION BY statement_id ORDER BY date, row_key)),
lines AS (SELECT *, CASE WHEN row_key % 89 = 0 THEN NULL WHEN row_key % 97 = 0 THEN running + 1.0 ELSE running END AS balance FROM s1)"""
HEADS = f"""h0 AS (SELECT o_custkey AS key, coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'F'), 0) AS inward,
  coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus <> 'F'), 0) AS outward, CAST(min(o_orderdate) AS DATE) AS first_day,
  CAST(max(o_orderdate) AS DATE) AS last_day FROM orders GROUP BY o_custkey),
heads AS (SELECT 'c' || key AS statement_id, key, {KIND.replace("k %", "key %")} AS account_type, CAST(1000 AS DOUBLE) AS opening_balance,
  CASE WHEN key % 31 = 0 THEN NULL ELSE CAST(1000 + (inward - outward) * CASE WHEN key % 5 = 1 THEN -1 ELSE 1 END AS DOUBLE) + CASE WHEN key % 23 = 0 THEN 5.0 ELSE 0.0 END END AS closing_balance,
  CASE WHEN key % 6 <> 0 THEN CAST(outward AS DOUBLE) END AS total_withdrawals, CASE WHEN key % 7 <> 0 THEN CAST(inward AS DOUBLE) END AS total_deposits,
  first_day, last_day FROM h0)"""
CENT = "0.01 + 1e-9"
STEPS = f"""steps AS (SELECT l.statement_id, l.row_key, l.pos, l.amount, l.balance, l.sign,
  lag(l.balance, 1, CAST(1000 AS DOUBLE)) OVER (PARTITION BY l.statement_id ORDER BY l.pos) AS prior FROM lines l),
judged AS (SELECT *, abs(balance - prior - amount * sign) <= {CENT} AS step_ok FROM steps)"""
VERDICTS = f"""v0 AS (SELECT statement_id, {_money("amount")} AS net, bool_and(step_ok) AS check_running,
  string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (NOT step_ok) AS flagged, count(*) FILTER (NOT step_ok) AS rows_flagged FROM judged GROUP BY statement_id),
v1 AS (SELECT h.statement_id, CASE WHEN account_type = 'credit' THEN -1 ELSE 1 END AS sg, closing_balance - opening_balance AS expected,
  total_deposits - total_withdrawals AS moved, v0.* EXCLUDE (statement_id) FROM heads h JOIN v0 USING (statement_id)),
v2 AS (SELECT *, abs({_r("net * sg")} - expected) <= {CENT} AS check_balance, abs(moved * sg - expected) <= {CENT} AS check_totals,
  CASE WHEN expected IS NULL THEN 0.0 ELSE {_r("abs(" + _r("net * sg") + " - expected)")} END AS delta FROM v1),
verdicts AS (SELECT *, CAST((check_balance IS NOT NULL)::INT + (check_totals IS NOT NULL)::INT + (check_running IS NOT NULL)::INT AS BIGINT) AS checks_run FROM v2),
final AS (SELECT statement_id, checks_run > 0 AND coalesce(check_balance, true) AND coalesce(check_totals, true) AND coalesce(check_running, true) AS reconciled,
  CAST(delta AS DOUBLE) AS delta, check_balance, check_totals, check_running, coalesce(flagged, '') AS flagged, checks_run, rows_flagged FROM verdicts)"""
# statement rows as their documents give them
DOC_ROWS = """doc_rows AS (SELECT l.*, h.first_day, h.last_day, row_key % 5 = 4 AS undated, row_key % 53 = 0 AS nothing FROM lines l JOIN heads h USING (statement_id) WHERE row_key % 59 <> 0),
dated AS (SELECT *, try_cast(year(first_day) || '-' || month(date) || '-' || day(date) AS DATE) AS d1, try_cast(year(last_day) || '-' || month(date) || '-' || day(date) AS DATE) AS d2 FROM doc_rows),
adapted AS (SELECT statement_id, CAST(pos AS BIGINT) AS pos, CASE WHEN NOT undated THEN date WHEN d1 BETWEEN first_day AND last_day THEN d1 WHEN d2 BETWEEN first_day AND last_day THEN d2 ELSE first_day END AS date,
  CASE WHEN undated THEN strftime(date, '%m/%d') || ' ' ELSE '' END || description AS description, amount, deposit, withdrawal, balance, key FROM dated WHERE NOT nothing)"""
GAP = _pick(lenses.GAPS, "p_partkey")
BILLS = f"""b0 AS (SELECT *, unnest(range(0, 6)) AS i, CAST(5 AS DOUBLE) + p_retailprice % 97 AS base FROM part),
bills AS (SELECT p_partkey * 6 + i AS pos, 'v' || (p_partkey % 30) AS account_id, p_name || ' ' || p_partkey AS merchant,
  DATE '2020-01-01' + CAST(CASE WHEN p_partkey % 10 = 3 THEN {_pick(lenses.OFFSETS_OUT_OF_STEP, "i")}
    ELSE i * {GAP} + CASE WHEN p_partkey % 9 = 0 AND i >= 3 THEN {GAP} ELSE 0 END + (p_partkey + i) % 2 END AS INT) AS date,
  -{_r("CASE WHEN p_partkey % 4 = 0 AND i = 5 THEN base * 1.1::DOUBLE WHEN p_partkey % 6 = 5 THEN base * (1 + i * 0.3::DOUBLE) ELSE base END")} AS amount,
  CASE WHEN p_partkey % 8 = 0 AND i < 3 THEN 'Groceries' ELSE {_pick(lenses.BILL_CATEGORIES, "p_partkey")} END AS category, p_partkey % 29 = 0 AS is_transfer FROM b0)"""
NATURE = "CASE category " + " ".join(f"WHEN '{c}' THEN '{n}'" for c, n in recurring.NATURE_OF.items()) + " ELSE 'unclear' END"
RECURRING = f"""{BILLS},
g0 AS (SELECT *, date - lag(date) OVER (PARTITION BY merchant ORDER BY date, pos) AS gap FROM bills WHERE NOT is_transfer AND amount < 0),
g1 AS (SELECT g0.merchant, c.cadence, gap / greatest(1, round_even(gap / CAST(c.cadence AS DOUBLE), 0)) AS g, greatest(1, round_even(gap / CAST(c.cadence AS DOUBLE), 0)) AS p, gap
  FROM g0, (VALUES {", ".join(f"({c})" for c in recurring.PER_YEAR)}) c(cadence) WHERE gap IS NOT NULL),
g2 AS (SELECT merchant, cadence, stddev_pop(g) / median(g) AS ratio, sum(p - 1) AS missed FROM g1 GROUP BY merchant, cadence
  HAVING min(gap) > 0 AND max(p) <= 3 AND bool_and(abs(g - cadence) <= 0.15 * cadence) AND count(*) >= 2),
g3 AS (SELECT merchant, cadence FROM g2 WHERE ratio < 0.25 QUALIFY row_number() OVER (PARTITION BY merchant ORDER BY missed, ratio, cadence) = 1),
m0 AS (SELECT merchant, median(-amount) AS med, stddev_pop(-amount) / avg(-amount) AS spread, count(*) AS occurrences, min(date) AS first_date, max(date) AS last_date,
  (arg_max(-amount, date) - arg_min(-amount, date)) / arg_min(-amount, date) * 100 AS change, arg_max(account_id, date) AS account_id FROM g0 GROUP BY merchant),
modes AS (SELECT merchant, category FROM (SELECT merchant, category, count(*) AS n, min(date) AS seen FROM g0 GROUP BY merchant, category)
  QUALIFY row_number() OVER (PARTITION BY merchant ORDER BY n DESC, seen) = 1),
found AS (SELECT merchant, CAST(cadence AS BIGINT) AS cadence_days, {_r("med")} AS amount, CASE WHEN spread < 0.15 THEN 'fixed' ELSE 'variable' END AS kind, occurrences,
  strftime(first_date, '%Y-%m-%d') AS first_date, strftime(last_date, '%Y-%m-%d') AS last_date, strftime(last_date + CAST(cadence AS INT), '%Y-%m-%d') AS next_expected,
  CASE WHEN abs(change) >= 2 THEN {_r("change", 1)} END AS price_change_pct,
  {_r("med * CASE cadence " + " ".join(f"WHEN {c} THEN {n}" for c, n in recurring.PER_YEAR.items()) + " END")} AS annual_cost, account_id, category, {NATURE} AS nature
  FROM g3 JOIN m0 USING (merchant) JOIN modes USING (merchant))"""
DEBTS = "debts AS (SELECT s_suppkey AS key, s_acctbal AS b, s_suppkey % 30 + CAST(4.99 AS DOUBLE) AS apr, (s_suppkey % 30 + CAST(4.99 AS DOUBLE)) / 100 / 12 AS r FROM supplier)"


def _level(months: int) -> str:
    return f"ceil(b * r / (1 - pow(1 + r, -{months})) * 100) / 100"


LEAST = _r("greatest(25.0::DOUBLE, b * r + 0.01::DOUBLE * b)")


def _runs(plans: str) -> str:
    """plans: key, label, b, r, pay"""
    return f"""run AS (SELECT key, label, r, pay, 0 AS n, b AS rem, CAST(0 AS DOUBLE) AS paid FROM {plans} WHERE pay > {_r("b * r")} AND b > 0
  UNION ALL SELECT key, label, r, pay, n + 1, greatest(0.0::DOUBLE, {_r("rem + " + _r("rem * r") + " - pay")}), paid + {_r("rem * r")} FROM run WHERE rem > 0 AND n < {payoff.MONTHS}),
cleared AS (SELECT key, label, pay, n AS months, paid FROM run WHERE rem <= 0)"""


SCENARIOS = f"""WITH RECURSIVE {DEBTS},
wanted AS (SELECT key, b, r, unnest([{{'i': 0, 'label': 'minimum', 'pay': {LEAST}}}, {{'i': 1, 'label': '36 months', 'pay': {_level(36)}}},
  {{'i': 2, 'label': 'minimum plus 100', 'pay': {_r(LEAST + " + 100")}}}, {{'i': 3, 'label': '12 months', 'pay': {_level(12)}}}], recursive := true) FROM debts WHERE b > 0),
{_runs("wanted")},
c AS (SELECT cleared.*, i FROM cleared JOIN wanted USING (key, label)),
p AS (SELECT key, max(pay) FILTER (i = 0) AS p0, max(pay) FILTER (i = 1) AS p1, max(pay) FILTER (i = 2) AS p2 FROM c GROUP BY key),
k AS (SELECT key, p0, CASE WHEN p0 IS NOT NULL AND abs(p1 - p0) < 1 THEN NULL ELSE p1 END AS k1, p2 FROM p),
k2 AS (SELECT key, p0, k1, CASE WHEN coalesce(abs(p2 - p0) < 1, false) OR coalesce(abs(p2 - k1) < 1, false) THEN NULL ELSE p2 END AS k2 FROM k),
kept AS (SELECT c.* FROM c JOIN k2 USING (key) WHERE i = 0 OR (i = 1 AND k1 IS NOT NULL) OR (i = 2 AND k2 IS NOT NULL)
  OR (i = 3 AND NOT (coalesce(abs(pay - p0) < 1, false) OR coalesce(abs(pay - k1) < 1, false) OR coalesce(abs(pay - k2) < 1, false))))"""
LEGS = """l0 AS (SELECT *, CASE WHEN o_orderkey % 50 = 0 THEN floor(o_totalprice / 50000) * 500 + 500 ELSE o_totalprice END AS price, CAST(o_orderdate AS DATE) AS day FROM orders),
legs AS (SELECT o_orderkey * 2 AS pos, 'c' || (o_custkey % 90) AS account_id, -price AS amount, day AS date, 'memo' AS description FROM l0 UNION ALL
  SELECT o_orderkey * 2 + 1, 'c' || ((o_custkey + o_orderkey % 3) % 90), price + CASE WHEN o_orderkey % 7 = 0 THEN 0.01::DOUBLE WHEN o_orderkey % 17 = 0 THEN 0.02::DOUBLE ELSE 0 END,
  day + CAST(o_orderkey % 6 AS INT), CASE WHEN o_orderkey % 3 = 0 THEN 'ONLINE PMT' WHEN o_orderkey % 50 = 25 THEN 'Zelle' ELSE 'memo' END FROM l0)"""
KEYWORD = "CASE " + " ".join(
    f"WHEN regexp_matches(lower(description), '{p}')" + (" AND amount > 0" if c == "Income" else "") + f" THEN {'NULL' if c == 'Other' else repr(c)}" for p, c in text.KEYWORDS
) + " END"
CATEGORIZED = f"""{TXN},
dict AS (SELECT 'Shop ' || n_nationkey AS merchant, {_pick(text.CATEGORIES, "n_nationkey")} AS dc FROM nation),
cache AS (SELECT DISTINCT 'Shop ' || (s_suppkey % 60 + 20) AS merchant, {_pick(text.CATEGORIES, "s_suppkey % 60")} AS cc FROM supplier),
w AS (SELECT t.* EXCLUDE (category), dc, cc, {KEYWORD} AS word FROM txn t LEFT JOIN dict USING (merchant) LEFT JOIN cache USING (merchant)),
e AS (SELECT *, CASE WHEN merchant <> '' THEN first_value(word IGNORE NULLS) OVER (PARTITION BY merchant ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS earlier FROM w),
cat AS (SELECT pos, id, merchant, coalesce(dc, cc, earlier, word, 'Other') AS category,
  CASE WHEN dc IS NOT NULL THEN 'dict' WHEN coalesce(cc, earlier) IS NOT NULL THEN 'cache' WHEN word IS NOT NULL THEN 'keyword' ELSE 'fallback' END AS layer FROM e)"""
IDS = """i0 AS (SELECT o_orderkey AS pos, 'c' || (o_custkey % 50) AS account_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, ['coffee', 'rent', 'fuel'][CAST(o_orderkey % 3 + 1 AS INT)] AS description,
  floor(o_totalprice / 100000) * CAST(-12.25 AS DOUBLE) AS amount, CASE WHEN o_orderkey % 4 <> 0 THEN '0064' END AS reference FROM orders),
occ AS (SELECT *, row_number() OVER (PARTITION BY account_id, date, description, amount, reference ORDER BY pos) - 1 AS occurrence FROM i0),
ids AS (SELECT pos, date, occurrence, sha256(concat_ws('|', account_id, strftime(date, '%Y-%m-%d'), description, regexp_replace(printf('%.2f', amount), '0$', ''), coalesce(reference, 'None'), occurrence))[:16] AS id FROM occ)"""
RAW = f"""raw AS (SELECT p_partkey AS key, {_pick(("SQ *", "TST* ", "POS DEBIT ", "PAYPAL *", "CHECKCARD 0907 ", "", "1126 "), "p_partkey")} || upper(p_name)
  || CASE WHEN p_partkey % 3 = 0 THEN ' #' || (p_partkey % 1000) ELSE '' END || CASE WHEN p_partkey % 4 = 0 THEN ' 555-018-2233' ELSE '' END || CASE WHEN p_partkey % 8 = 0 THEN ' 7Q2WZ9' ELSE '' END
  || CASE WHEN p_partkey % 6 = 0 THEN ' MON' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN ' CA' ELSE '' END || CASE WHEN p_partkey % 25 = 1 THEN ' 00098760' ELSE '' END AS description, p_name FROM part)"""


def _title(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all(lower({x}), '[a-z]+|[^a-z]+'), lambda w: upper(w[1]) || w[2:]), '')"


BOXES = """box AS (SELECT l_orderkey AS page, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 480 ELSE 400 END + (l_suppkey % 4) AS x2, l_extendedprice AS value, l_quantity * 2 AS conf FROM lineitem)"""
COLUMNS = """c0 AS (SELECT page, CAST(x2 AS DOUBLE) AS x2, x2 - lag(x2) OVER (PARTITION BY page ORDER BY x2) AS gap FROM box),
c1 AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 12 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY x2 ROWS UNBOUNDED PRECEDING) AS c FROM c0),
cols AS (SELECT page, c, avg(x2) AS edge FROM c1 GROUP BY page, c HAVING count(*) >= 2)"""



def _warnings(b: str, closing: str) -> str:
    """b: lines with `bad`"""
    return f"""WITH {LINES}, {HEADS}, {STEPS}, {b},
        s AS (SELECT statement_id, {_money("deposit")} AS di, {_money("withdrawal")} AS wo, count(*) FILTER (bad) AS bads, {_money("amount * sign")} AS moved, arg_max(balance, pos) FILTER (balance IS NOT NULL) AS last_balance FROM b GROUP BY 1)
        SELECT statement_id, concat_ws(',', CASE WHEN abs(total_deposits - coalesce(di, 0)) > {CENT} THEN 'deposits' END, CASE WHEN abs(total_withdrawals - coalesce(wo, 0)) > {CENT} THEN 'withdrawals' END,
        CASE WHEN bads > 0 THEN 'running balance' END, CASE WHEN abs(opening_balance + moved - ({closing})) > {CENT} THEN 'closing balance' END) AS warnings FROM heads JOIN s USING (statement_id)"""


ORACLES: dict[str, str] = {
    "a1_summary": f"""WITH {TXN} SELECT {_r("abs(coalesce(" + _money("CASE WHEN amount < 0 THEN amount END") + ", 0))")} AS total_spent, {_r("coalesce(" + _money("CASE WHEN amount > 0 THEN amount END") + ", 0)")} AS total_income,
        {_r("coalesce(" + _money("amount") + ", 0)")} AS net, count(*) AS txn_count, strftime(min(date), '%Y-%m-%d') AS date_from, strftime(max(date), '%Y-%m-%d') AS date_to FROM txn WHERE {SPENT}""",
    "a2_by_category": f"WITH {TXN} SELECT coalesce(nullif(category, ''), 'Other') AS category, {_r('abs(' + _money('amount') + ')')} AS amount, count(*) AS count FROM txn WHERE {SPENT} AND amount < 0 GROUP BY 1",
    "a3_by_month": f"WITH {TXN} SELECT strftime(date, '%Y-%m') AS month, {_r('abs(' + _money('amount') + ')')} AS amount FROM txn WHERE {SPENT} AND amount < 0 GROUP BY 1",
    "a4_account_counts": f"WITH {TXN} SELECT account_id, count(*) AS txn_count FROM txn GROUP BY ALL",
    "a5_transfers_excluded": f"WITH {TXN} SELECT count(*) AS count, {_r('coalesce(' + _money('abs(amount)') + ', 0)')} AS amount FROM txn WHERE is_transfer",
    "j1_accounts_with_counts": f"WITH {TXN}, {ACC} SELECT a.id, a.bank_name, a.closing_balance, count(t.id) AS txn_count FROM acc a LEFT JOIN txn t ON t.account_id = a.id GROUP BY ALL",
    "o1_recent_transactions": f"WITH {TXN} SELECT id, account_id, strftime(date, '%Y-%m-%d') AS date, amount FROM (SELECT * FROM txn ORDER BY txn.date DESC, id LIMIT 100)",
    "p9_filtered_transactions": f"WITH {TXN} SELECT id, account_id, category, amount FROM txn WHERE category = '1-URGENT' AND account_id = 'c7'",
    "p11_distinct_merchants": f"WITH {TXN} SELECT DISTINCT merchant FROM txn WHERE merchant IS NOT NULL",
    "p15_merchant_contains": f"WITH {TXN} SELECT merchant, abs({_money('amount')}) AS spent FROM txn WHERE merchant ILIKE '%shop 12%' AND amount < 0 GROUP BY 1",
    "p17_rounded_averages": f"WITH {TXN} SELECT account_id, {_r(_money('amount') + ' / count(*)')} AS mean_amount, {_r('max(amount)')} AS largest FROM txn GROUP BY 1",
    "p18_empty_results": "SELECT * FROM (VALUES ('all', (SELECT count(*) = 0 FROM orders)), ('no rows', true), ('only nulls', true)) t(name, is_empty)",
    "f36_weekend_spending": f"WITH {TXN} SELECT dayofweek(date) IN (0, 6) AS weekend, strftime(date_trunc('week', date), '%Y-%m-%d') AS week, abs({_money('amount')}) AS spent, count(*) AS n FROM txn WHERE {SPENT} AND amount < 0 GROUP BY 1, 2",
    "f1_merchant_key": f"WITH {RAW} SELECT key, description, {_title('p_name')} AS merchant FROM raw",
    "f2_title": f"WITH {TXN} SELECT id, {_title(chr(39) + chr(39) + ' || merchant || ' + chr(39) + '-x.' + chr(39) + ' || lower(description)')} AS titled FROM txn",
    "f3_account_identity": f"WITH {ACC} SELECT key, account_type, account_last4, lower(bank_name) || '-' || account_last4 AS account_id FROM acc",
    "f7_keyword_category": f"WITH {TXN} SELECT id, {KEYWORD} AS category FROM txn",
    "f8_transfer_word": f"WITH {TXN} SELECT description, bool_or(regexp_matches(upper(description), '{'|'.join(text.TRANSFER_WORDS)}')) AS has_word, bool_or(regexp_matches(lower(description), '^(cheque|check)\\b|\\bcheque no\\b|atm withdrawal|cash withdrawal|funds transfer|e-?transfer')) AS no_subscription FROM txn GROUP BY 1",
    "f20_to_number": "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 7 IN (1, 2) THEN -o_totalprice WHEN o_orderkey % 7 <> 4 THEN o_totalprice END AS value FROM orders",
    "f30_parse_date": "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 41 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date, CASE WHEN o_orderkey % 41 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders",
    "f31_recover_date": "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 10 > 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders",
    "w2_occurrence": f"WITH {IDS} SELECT pos, occurrence FROM occ",
    "f6_transaction_id": f"WITH {IDS} SELECT pos, id FROM ids",
    "c5_insert_new": f"WITH {IDS}, two AS (SELECT * FROM ids UNION ALL SELECT * FROM ids) SELECT DISTINCT pos, id FROM two WHERE id NOT IN (SELECT id FROM ids WHERE date < DATE '1998-01-01')",
    "j11_upsert_accounts": f"""WITH {ACC}, new AS (SELECT 'c' || (s_suppkey * 7) AS id, CASE WHEN s_suppkey % 3 = 0 THEN s_name END AS bank_name, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS closing_balance FROM supplier)
        SELECT coalesce(a.id, n.id) AS id, coalesce(n.bank_name, a.bank_name) AS bank_name, coalesce(n.closing_balance, a.closing_balance) AS closing_balance, a.apr FROM acc a FULL JOIN new n ON a.id = n.id""",
    "j9_update_flags": f"WITH {TXN} SELECT id, CASE WHEN o_orderstatus = 'P' THEN true ELSE is_transfer END AS is_transfer, o_orderstatus = 'P' AND o_orderkey % 2 = 0 AS is_recurring FROM txn JOIN orders ON pos = o_orderkey",
    "c2_reconcile": f"WITH {LINES}, {HEADS}, {STEPS}, {VERDICTS} SELECT * FROM final",
    "w1_running_balance": f"WITH {LINES}, {STEPS} SELECT row_key, CAST(pos AS BIGINT) AS pos, prior, step_ok FROM judged",
    "a6_extraction_summary": f"""WITH {LINES}, {HEADS}, {STEPS}, {VERDICTS} SELECT count(*) AS statements, count(*) FILTER (reconciled) AS reconciled_statements, CAST(sum(checks_run) AS BIGINT) AS checks_run,
        CAST(sum(rows_flagged) AS BIGINT) AS rows_flagged, count(*) > 0 AND count(*) = count(*) FILTER (reconciled) AND sum(checks_run) > 0 AS reconciled FROM final""",
    "a19_parser_warnings": _warnings("""q AS (SELECT *, balance - cum AS d FROM (SELECT *, CAST(sum(CAST(amount * sign AS DECIMAL(18,2))) OVER (PARTITION BY statement_id ORDER BY pos) AS DOUBLE) AS cum FROM lines)),
        b AS (SELECT *, abs(d - coalesce(last_value(d IGNORE NULLS) OVER (PARTITION BY statement_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1000)) > """ + CENT + " AS bad FROM q)", "closing_balance"),
    "a19_parser_warnings_broken_chain": _warnings(f"b AS (SELECT *, abs(balance - prior - amount * sign) > {CENT} AS bad FROM lines JOIN (SELECT row_key, prior FROM steps) USING (row_key))", "coalesce(closing_balance, last_balance)"),
    "c1_adapt_rows": f"WITH {LINES}, {HEADS}, {DOC_ROWS} SELECT statement_id, pos, strftime(date, '%Y-%m-%d') AS date, description, amount, balance FROM adapted",
    "c1_adapt_accounts": f"""WITH {LINES}, {HEADS}, {DOC_ROWS}, sums AS (SELECT statement_id, {_money("deposit")} AS di, {_money("withdrawal")} AS wo FROM adapted GROUP BY 1),
        t AS (SELECT h.*, di, wo, total_deposits IS NOT NULL AND total_withdrawals IS NOT NULL AS whole FROM heads h LEFT JOIN sums USING (statement_id))
        SELECT statement_id, 'bank-' || (key % 40) || '-' || lpad(CAST(key AS VARCHAR), 7, '0')[-4:] AS id, lpad(CAST(key AS VARCHAR), 7, '0')[-4:] AS account_last4, account_type, 'USD' AS currency,
        CASE WHEN whole THEN total_deposits ELSE coalesce(di, 0) END AS total_deposits, CASE WHEN whole THEN total_withdrawals ELSE coalesce(wo, 0) END AS total_withdrawals, CASE WHEN whole THEN 'statement' ELSE 'derived' END AS totals_source FROM t""",
    "c15_normalize_rows": f"""WITH {LINES}, {HEADS}, {DOC_ROWS} SELECT statement_id, CAST(pos AS BIGINT) AS pos, CASE WHEN NOT undated THEN strftime(date, '%Y-%m-%d') END AS date, CASE WHEN undated THEN strftime(date, '%m/%d') || ' ' ELSE '' END || description AS description,
        lpad(CAST(row_key % 100 AS VARCHAR), 4, '0') AS reference, CASE WHEN nothing THEN 0 ELSE withdrawal END AS withdrawal, CASE WHEN NOT nothing THEN deposit END AS deposit, balance FROM doc_rows""",
    "c15_normalize_headers": f"""WITH {LINES}, {HEADS}, {DOC_ROWS}, n AS (SELECT statement_id, pos, CASE WHEN NOT undated THEN date END AS date, CASE WHEN nothing THEN 0 ELSE withdrawal END AS wi, CASE WHEN NOT nothing THEN deposit END AS de, balance FROM doc_rows),
        sums AS (SELECT statement_id, coalesce({_money("wi")}, 0) AS wo, coalesce({_money("de")}, 0) AS di, arg_max(balance, pos) FILTER (balance IS NOT NULL) AS last_balance FROM n GROUP BY 1),
        f AS (SELECT h.statement_id, 'Bank ' || (key % 40) AS bank_name, CAST(NULL AS VARCHAR) AS account_holder_name, '12-' || lpad(CAST(key AS VARCHAR), 7, '0') AS account_number, {_pick(lenses.ACCOUNT_KINDS, "key")} AS account_type,
          strftime(first_day, '%Y-%m-%d') AS statement_period_start, strftime(last_day, '%Y-%m-%d') AS statement_period_end, CAST(NULL AS VARCHAR) AS currency, opening_balance, coalesce(closing_balance, last_balance) AS closing_balance,
          coalesce(total_withdrawals, wo) AS total_withdrawals, coalesce(total_deposits, di) AS total_deposits FROM heads h LEFT JOIN sums USING (statement_id))
        SELECT *, concat_ws(',', 'account_holder_name', 'currency', CASE WHEN closing_balance IS NULL THEN 'closing_balance' END, CASE WHEN total_withdrawals IS NULL THEN 'total_withdrawals' END, CASE WHEN total_deposits IS NULL THEN 'total_deposits' END) AS missing FROM f""",
    "a17_incomplete_rows": f"WITH {LINES}, {HEADS}, {DOC_ROWS} SELECT statement_id, count(*) FILTER (undated) AS incomplete FROM doc_rows GROUP BY 1",
    "s2_batch_failures": "WITH s AS (SELECT DISTINCT 'c' || o_custkey AS id FROM orders) SELECT id AS statement_id, 'good' AS reason FROM s UNION ALL SELECT 'x' || id, CASE WHEN id LIKE '%7' THEN 'no JSON' WHEN id LIKE '%3' THEN 'empty' ELSE 'no object' END FROM s",
    "c8_find_recurring": f"WITH {RECURRING} SELECT * FROM found",
    "a12_recurring_totals": f"WITH {RECURRING} SELECT nature, count(*) AS merchants, {_r(_money('annual_cost'))} AS annual_cost, count(*) FILTER (price_change_pct > 0) AS price_increases FROM found GROUP BY 1",
    "c10_subscriptions": f"WITH {RECURRING} SELECT merchant, nature, annual_cost FROM found WHERE nature IN ('subscription', 'bill')",
    "c8_flag_recurring": f"WITH {RECURRING} SELECT pos, NOT is_transfer AND merchant IN (SELECT merchant FROM found) AS is_recurring FROM bills",
    "f23_minimum_payment": f"WITH {DEBTS} SELECT key, {LEAST} AS minimum, {_level(36)} AS in_36, {_level(12)} AS in_12 FROM debts",
    "f25_payoff": f"""WITH RECURSIVE {DEBTS}, plans AS (SELECT key, 'p' AS label, b, r, CAST(150 AS DOUBLE) AS pay FROM debts), {_runs("plans")}
        SELECT key, CASE WHEN b <= 0 THEN 0 ELSE CAST(months AS BIGINT) END AS months, CASE WHEN b <= 0 THEN 0.0::DOUBLE ELSE {_r("paid")} END AS total_interest FROM debts LEFT JOIN cleared USING (key)""",
    "c11_payoff_scenarios": f"{SCENARIOS} SELECT key, label, pay AS monthly_payment, CAST(months AS BIGINT) AS months, {_r('paid')} AS total_interest FROM kept",
    "n12_payoff_chart": f"""{SCENARIOS} SELECT key, CAST(n AS BIGINT) AS month, max(rem) FILTER (label = 'minimum') AS minimum, max(rem) FILTER (label = '36 months') AS m36, max(rem) FILTER (label = 'minimum plus 100') AS plus100,
        max(rem) FILTER (label = '12 months') AS m12 FROM run JOIN (SELECT key, label FROM kept) USING (key, label) WHERE n > 0 GROUP BY key, n""",
    "j7_transfer_candidates": f"""WITH {LEGS} SELECT o.pos AS out_pos, i.pos AS in_pos, regexp_matches(upper(o.description || ' ' || i.description), '{"|".join(text.TRANSFER_WORDS)}') AS has_word, CAST(abs(i.date - o.date) AS BIGINT) AS gap
        FROM legs o JOIN legs i ON o.amount < 0 AND i.amount > 0 AND i.amount BETWEEN -o.amount - 0.02 AND -o.amount + 0.02 AND abs(o.amount + i.amount) <= {CENT} AND o.account_id <> i.account_id AND abs(i.date - o.date) <= 3""",
    "c4_categorize": f"WITH {CATEGORIZED} SELECT id, category, CAST(CASE layer " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in categorize.CONFIDENCE.items()) + " END AS DOUBLE) AS confidence, layer FROM cat",
    "c18_learned_merchants": f"WITH {CATEGORIZED} SELECT merchant, arg_min(category, pos) AS category FROM cat WHERE layer = 'keyword' AND merchant <> '' GROUP BY 1",
    "a13_coverage": f"WITH {CATEGORIZED} SELECT layer, count(*) AS rows, {_r('count(*) * 100.0::DOUBLE / (SELECT count(*) FROM cat)', 1)} AS share_pct FROM cat GROUP BY 1",
    "j2_resolve_merchants": f"""WITH {RAW}, al AS (SELECT trim(description) AS d, min('Alias ' || (key % 5)) AS m FROM raw WHERE key % 6 <> 1 AND key % 100 >= 70 GROUP BY 1)
        SELECT key, coalesce(m, {_title("p_name")}) AS merchant FROM raw LEFT JOIN al ON trim(description) = d""",
    "j13_dictionary": f"""WITH r AS (SELECT p_partkey AS pos, p_name, {_pick(text.CATEGORIES, "p_partkey")} AS category FROM part), u AS (SELECT pos, p_name AS merchant, category FROM r UNION ALL SELECT pos, {_title("p_name")}, category FROM r)
        SELECT merchant, arg_min(category, pos) AS category FROM u GROUP BY 1""",
    "c12_ingest": f"WITH {LINES}, {HEADS}, {DOC_ROWS} SELECT statement_id, count(*) AS n, {_money('amount')} AS net FROM adapted GROUP BY 1",
    "c13_dashboard": f"""WITH {TXN}, {ACC} SELECT 'summary' AS block, 'net' AS key, {_r(_money("amount"))} AS value FROM txn WHERE {SPENT}
        UNION ALL SELECT 'by_category', coalesce(nullif(category, ''), 'Other'), {_r("abs(" + _money("amount") + ")")} FROM txn WHERE {SPENT} AND amount < 0 GROUP BY 2
        UNION ALL SELECT 'spending_over_time', strftime(date, '%Y-%m'), {_r("abs(" + _money("amount") + ")")} FROM txn WHERE {SPENT} AND amount < 0 GROUP BY 2
        UNION ALL SELECT 'accounts', a.id, count(t.id) FROM acc a LEFT JOIN txn t ON t.account_id = a.id GROUP BY 2
        UNION ALL SELECT 'transfers_excluded', 'both legs', {_r(_money("abs(amount)"))} FROM txn WHERE is_transfer
        UNION ALL SELECT 'extraction', 'statements', count(DISTINCT o_custkey) FROM orders""",
    "q2_ask_templates": f"""WITH {TXN} SELECT CAST(0 AS BIGINT) AS template, count(DISTINCT coalesce(nullif(category, ''), 'Other')) AS n, {_money("-amount")} AS spent FROM txn WHERE {SPENT} AND amount < 0
        UNION ALL SELECT 1, count(*), {_money("-amount")} FROM (SELECT * FROM txn WHERE {SPENT} AND amount < 0 ORDER BY amount, id LIMIT 10)
        UNION ALL SELECT 2, count(DISTINCT strftime(date, '%Y-%m')), {_money("-amount")} FROM txn WHERE {SPENT} AND amount < 0
        UNION ALL SELECT 3, count(DISTINCT dayofweek(date) IN (0, 6)), {_money("-amount")} FROM txn WHERE {SPENT} AND amount < 0""",
    "g2_number_rows": f"WITH {BOXES} SELECT page, count(DISTINCT l_linenumber) AS rows, count(*) * 3 AS words FROM box GROUP BY 1",
    "g3_columns": f"WITH {BOXES}, {COLUMNS} SELECT page, row_number() OVER (PARTITION BY page ORDER BY edge) - 1 AS \"column\", {_r('edge', 3)} AS edge FROM cols",
    "g8_lines": f"""WITH {BOXES}, {COLUMNS}, near AS (SELECT box.*, (SELECT arg_min(c, abs(cols.edge - box.x2)) FROM cols WHERE cols.page = box.page AND abs(cols.edge - box.x2) <= 30) AS c FROM box),
        -- of two amounts in one column of a line the rightmost counts
        held AS (SELECT page, l_linenumber, c, arg_max(value, {{'x': x2, 't': format('{{:,.2f}}', value)}}) AS value FROM near WHERE c IS NOT NULL GROUP BY 1, 2, 3),
        per AS (SELECT page, l_linenumber, bool_or(c IS NOT NULL) AS assigned, avg(conf) FILTER (conf < 100) AS conf FROM near GROUP BY 1, 2),
        counts AS (SELECT page, count(*) FILTER (assigned) AS transactions, count(*) FILTER (assigned AND conf < 70) AS doubtful FROM per GROUP BY 1)
        SELECT page, transactions, doubtful, coalesce(total, 0) AS total FROM counts LEFT JOIN (SELECT page, {_money("value")} AS total FROM held GROUP BY 1) USING (page)""",
    "w5_infer_signs": f"""WITH {LINES}, q AS (SELECT row_key, coalesce(deposit, withdrawal) AS value, balance, coalesce(last_value(balance IGNORE NULLS) OVER (PARTITION BY statement_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1000) AS prior FROM lines)
        SELECT row_key, CASE WHEN abs(balance - prior - value) <= {CENT} THEN value END AS deposit, CASE WHEN abs(balance - prior + value) <= {CENT} THEN value END AS withdrawal FROM q""",
    "st1_tumbling_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS events, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM events GROUP BY 1, 2",
    "st2_deduplicated_stream": "SELECT event_id, event_type, value FROM events",
    "st3_sessions": """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM s) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS events FROM n GROUP BY user_id, s""",
}
