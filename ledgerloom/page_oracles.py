"""SQL for the page driver: what the printed statements must read as, from the rows that they were printed from."""

from __future__ import annotations

from ledgerloom.oracles import CENT, HEADS, LINES, ORACLES, _list, _money, _r
from ledgerloom.sources import lenses

#: A page without withdrawals or without deposits has two columns, of which the left one counts as withdrawals. One
#: unheaded amount alone on a page makes no column, so that it stays among the words and the balance says how much it was.
PRINTED = f"""{LINES}, {HEADS},
p0 AS (SELECT l.*, l.pos // {lenses.ROWS_A_PAGE} AS page, key % 3 = 0 AS lone, CASE WHEN row_key % 89 = 0 AND row_key % 9 <> 0 THEN NULL ELSE coalesce(balance, 500) END AS shown, max(l.pos) OVER (PARTITION BY statement_id) AS last FROM lines l),
p1 AS (SELECT *, bool_or(withdrawal IS NOT NULL) OVER w AS outs, bool_or(deposit IS NOT NULL) OVER w AS ins, page = last // {lenses.ROWS_A_PAGE} AS final, lone AND count(*) OVER w = 1 AS single FROM p0 WINDOW w AS (PARTITION BY statement_id, page)),
p2 AS (SELECT *, CASE WHEN lone THEN NULL WHEN final OR (outs AND ins) THEN withdrawal ELSE coalesce(withdrawal, deposit) END AS w, CASE WHEN lone THEN NULL WHEN final OR (outs AND ins) THEN deposit END AS d,
  CASE WHEN lone AND NOT single THEN coalesce(withdrawal, deposit) END AS a, coalesce(last_value(shown IGNORE NULLS) OVER (PARTITION BY statement_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1000) AS before FROM p1),
p3 AS (SELECT *, round(shown - before, 2) AS delta, replace(description, 'UNIT 7', 'UNIT B') || CASE WHEN single THEN format(' {{:,.2f}}', coalesce(withdrawal, deposit)) ELSE '' END AS said FROM p2),
page_rows AS (SELECT statement_id AS doc, CAST(pos AS BIGINT) AS pos, CASE WHEN row_key % 9 <> 0 THEN strftime(date, '%Y-%m-%d') END AS date, said || CASE WHEN row_key % 5 = 0 THEN ' Store north' ELSE '' END AS description,
  CASE WHEN row_key % 4 <> 0 THEN lpad(CAST(row_key % 100 AS VARCHAR), 4, '0') END AS reference, CASE WHEN lone AND delta < 0 THEN coalesce(a, -delta) ELSE w END AS withdrawal, CASE WHEN lone AND delta > 0 THEN coalesce(a, delta) ELSE d END AS deposit,
  shown AS balance, CASE WHEN delta IS NULL THEN a END AS amount, row_key % 13 = 0 AS doubtful,
  CASE WHEN lone AND abs(a - abs(delta)) > {CENT} THEN 'amount' WHEN NOT lone AND abs(coalesce(d, 0) - coalesce(w, 0) - delta) > {CENT} THEN 'columns' END AS note, said, page FROM p3),
page_heads AS (SELECT h.statement_id, CAST(1000 AS DOUBLE) AS opening_balance, closing_balance, CASE WHEN key % 3 <> 0 THEN CAST(outward AS DOUBLE) END AS total_withdrawals,
  CASE WHEN key % 3 <> 0 THEN CAST(inward AS DOUBLE) END AS total_deposits, strftime(first_day, '%Y-%m-%d') AS first, strftime(last_day, '%Y-%m-%d') AS final, key
  FROM heads h JOIN (SELECT key, inward, outward FROM h0) USING (key))"""
ORACLES |= {
    "g13_page_rows": f"WITH {PRINTED} SELECT doc, pos, date, description, reference, withdrawal, deposit, balance, amount, doubtful, note FROM page_rows",
    "g8_page_heads": f"""WITH {PRINTED}, steps AS (SELECT *, CASE WHEN pos = 0 THEN 1000 ELSE lag(balance) OVER (PARTITION BY doc ORDER BY pos) END AS prior, coalesce(deposit, 0) - coalesce(withdrawal, 0) AS net FROM page_rows),
        sums AS (SELECT doc, coalesce({_money("deposit")}, 0) AS i, coalesce({_money("withdrawal")}, 0) AS o, coalesce({_money("net")}, 0) AS moved, count(*) FILTER (abs(balance - (prior + net)) > {CENT}) AS steps,
          string_agg(said[:40], ',' ORDER BY pos) FILTER (doubtful) AS doubts, arg_max(balance, pos) FILTER (balance IS NOT NULL) AS final_balance FROM steps GROUP BY doc)
        SELECT h.statement_id, opening_balance, closing_balance, total_withdrawals, total_deposits, coalesce(doubts, '') AS low_confidence_rows, array_to_string(list_filter([
          CASE WHEN abs(total_deposits - i) > {CENT} THEN 'deposits' END, CASE WHEN abs(total_withdrawals - o) > {CENT} THEN 'withdrawals' END, CASE WHEN steps > 0 THEN 'running balance' END,
          CASE WHEN abs(opening_balance + moved - coalesce(closing_balance, final_balance)) > {CENT} THEN 'closing balance' END], lambda x: x IS NOT NULL), ',') AS warnings FROM page_heads h JOIN sums ON sums.doc = h.statement_id""",
    "g9_names": f"""WITH {PRINTED} SELECT statement_id AS doc, 'Harbour Trust Bank' AS bank_name, {_list(("Anna Bell", "John Q Doe", "Ella Von Stein"))}[CAST(key % 3 + 1 AS INT)] AS account_holder_name,
        CASE WHEN key % 2 = 0 THEN 'Chequing' ELSE 'Savings' END AS account_type, first AS statement_period_start, final AS statement_period_end, '12-' || lpad(CAST(key AS VARCHAR), 7, '0') AS account_number FROM page_heads""",
    "g13_adapted_pages": f"""WITH {PRINTED} SELECT doc AS statement_id, 'harbour-trust-bank-' || lpad(CAST(key AS VARCHAR), 7, '0')[-4:] AS account_id, coalesce(closing_balance, first_value(balance) OVER (PARTITION BY doc ORDER BY pos DESC)) AS closing_balance, pos, coalesce(date, first) AS date, description,
        {_r("coalesce(deposit, 0) - coalesce(withdrawal, 0)")} AS amount, balance FROM page_rows JOIN page_heads ON doc = page_heads.statement_id QUALIFY coalesce(deposit, 0) <> coalesce(withdrawal, 0)""",
    "w8_continuations": """SELECT doc, pos, nullif(day, '') AS date, description, amount, nullif(total, -1) AS balance FROM (WITH l AS (SELECT o_custkey % 50 AS page, o_orderkey AS k, o_totalprice AS price, o_orderdate, o_orderkey % 3 = 0 AS dated, o_orderkey % 3 = 0 OR o_orderkey % 7 = 0 AS sure, o_orderkey % 5 = 0 AS lone FROM orders),
        b AS (SELECT *, min(k) FILTER (sure OR lone) OVER (PARTITION BY page) AS begun FROM l),
        t AS (SELECT *, sure OR (lone AND k = begun) AS own FROM b WHERE sure OR (lone AND k >= begun) OR (k > begun AND k % 11 <> 0)),
        i AS (SELECT *, count(*) FILTER (own) OVER (PARTITION BY page ORDER BY k) AS island,
          CASE WHEN dated THEN 'buy' WHEN sure THEN 'fee' WHEN lone THEN 'plus' ELSE 'note' END || ' n' || k AS said FROM t)
        SELECT CAST(page AS VARCHAR) AS doc, row_number() OVER (PARTITION BY page ORDER BY min(k)) - 1 AS pos, arg_min(CASE WHEN dated THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END, k) AS day,
          string_agg(said, ' ' ORDER BY k) AS description, arg_min(price, k) AS amount, arg_min(CASE WHEN sure THEN price * 2 ELSE -1 END, k) AS total FROM i GROUP BY page, island)""",
}
