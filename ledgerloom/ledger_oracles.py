"""SQL for transfer matching and for the stored ledger."""

from __future__ import annotations

from ledgerloom.functions import text
from ledgerloom.operators import recurring
from ledgerloom.oracles import BILLS, CENT, KEYWORD, LEGS, ORACLES, TXN, _r
from ledgerloom.sources import lenses

_WORDS = "|".join(text.TRANSFER_WORDS)


def greedy(universe: str) -> str:
    """pairs(k, o, i, word, gap): the greedy choice among the rows of `universe` (k, pos, account_id, amount, date,
    description) for each k, by rounds of what is best at both ends."""
    words = "CASE WHEN o.pos < i.pos THEN coalesce(o.description, '') || ' ' || coalesce(i.description, '') ELSE coalesce(i.description, '') || ' ' || coalesce(o.description, '') END"
    return f"""cand AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY word DESC, gap, least(o, i), greatest(o, i)) AS rank FROM (
  SELECT o.k, o.pos AS o, i.pos AS i, regexp_matches(upper({words}), '{_WORDS}') AS word, CAST(abs(i.date - o.date) AS BIGINT) AS gap
  FROM {universe} o JOIN {universe} i ON o.k = i.k AND o.amount < 0 AND i.amount > 0 AND i.amount BETWEEN -o.amount - 0.02 AND -o.amount + 0.02 AND abs(o.amount + i.amount) <= {CENT}
    AND o.account_id IS DISTINCT FROM i.account_id AND abs(i.date - o.date) <= 3)),
rounds(k, used, won) AS (SELECT DISTINCT k, CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) FROM cand UNION ALL
  SELECT k, list_concat(any_value(used), list_concat(list(o), list(i))), list(rank) FROM (
    SELECT m.k, m.used, c.o, c.i, c.rank, min(c.rank) OVER (PARTITION BY c.k, c.o) AS at_o, min(c.rank) OVER (PARTITION BY c.k, c.i) AS at_i
    FROM rounds m JOIN cand c ON c.k = m.k AND NOT list_contains(m.used, c.o) AND NOT list_contains(m.used, c.i)) WHERE rank = at_o AND rank = at_i GROUP BY k),
pairs AS MATERIALIZED (SELECT cand.* FROM cand JOIN (SELECT k, unnest(won) AS rank FROM rounds) USING (k, rank))"""


MATCHED = f"""{LEGS}, one AS (SELECT 1 AS k, * FROM legs), {greedy("one")}"""
_YEARS = " UNION ALL ".join(f"SELECT {i} AS upload, unnest([{', '.join(map(str, years))}]) AS y" for i, years in enumerate(lenses.UPLOADS, 1))
SENT = f"""{LEGS}, {BILLS}, years AS ({_YEARS}),
sent AS (SELECT y.upload, r.* FROM (
    SELECT 'Acme' AS owner, CAST(account_id[2:] AS INT) AS number, date, description, {_r("amount")} AS amount, pos AS ord FROM legs UNION ALL
    SELECT 'Globe', CAST(account_id[2:] AS INT), date, merchant, amount, pos FROM bills) r JOIN years y ON y.y = year(r.date)),
lines AS (SELECT *, lower(owner) || '-' || lpad(CAST(number AS VARCHAR), 4, '0') AS account_id, row_number() OVER (PARTITION BY upload, owner, number, date, description, amount ORDER BY ord) - 1 AS occurrence FROM sent WHERE amount <> 0),
named AS (SELECT *, sha256(concat_ws('|', account_id, strftime(date, '%Y-%m-%d'), description, regexp_replace(printf('%.2f', amount), '0$', ''), 'None', occurrence))[:16] AS id FROM lines),
stored AS MATERIALIZED (SELECT id, min(upload) AS upload, any_value(account_id) AS account_id, any_value(date) AS date, any_value(description) AS description, any_value(amount) AS amount,
  any_value(CASE description WHEN 'memo' THEN 'Memo' WHEN 'ONLINE PMT' THEN 'Online Pmt' WHEN 'Zelle' THEN 'Zelle' ELSE description END) AS merchant FROM named GROUP BY id)"""
UPLOADED = f"""{SENT},
known AS MATERIALIZED (SELECT k, s.*, row_number() OVER (PARTITION BY k ORDER BY date, id) AS pos FROM stored s JOIN (SELECT unnest(range(1, {len(lenses.UPLOADS) + 1})) AS k) ON s.upload <= k),
{greedy("known")},
moved AS (SELECT u.id, min(k) AS since FROM known u JOIN (SELECT k, unnest([o, i]) AS pos FROM pairs) USING (k, pos) GROUP BY u.id),
charges AS MATERIALIZED (SELECT u.* FROM known u LEFT JOIN moved m ON m.id = u.id AND m.since <= u.k WHERE m.id IS NULL AND amount < 0 AND merchant <> '' AND NOT regexp_matches(merchant, '{recurring.NO_SUBSCRIPTION}')),
g0 AS (SELECT k, merchant, date - lag(date) OVER (PARTITION BY k, merchant ORDER BY date, pos) AS gap FROM charges),
g1 AS (SELECT k, merchant, c.cadence, gap / greatest(1, round_even(gap / CAST(c.cadence AS DOUBLE), 0)) AS g, greatest(1, round_even(gap / CAST(c.cadence AS DOUBLE), 0)) AS p, gap
  FROM g0, (VALUES {", ".join(f"({c})" for c in recurring.PER_YEAR)}) c(cadence) WHERE gap IS NOT NULL),
steady AS (SELECT DISTINCT k, merchant FROM (SELECT k, merchant, cadence, stddev_pop(g) / median(g) AS ratio FROM g1 GROUP BY k, merchant, cadence
  HAVING min(gap) > 0 AND max(p) <= 3 AND bool_and(abs(g - cadence) <= 0.15 * cadence) AND count(*) >= 2) WHERE ratio < 0.25),
again AS (SELECT DISTINCT id FROM charges JOIN steady USING (k, merchant))"""
ORACLES |= {
    "j8_transfer_pairs": f"WITH RECURSIVE {MATCHED} SELECT o AS out_pos, i AS in_pos, word AS has_word, gap FROM pairs",
    "c7_mark_transfers": f"""WITH RECURSIVE {MATCHED} SELECT account_id, count(*) FILTER (u.pos IS NOT NULL) AS transfers, CAST(sum(CAST(amount AS DECIMAL(18,2))) FILTER (u.pos IS NULL) AS DOUBLE) AS net_of_rest
        FROM legs LEFT JOIN (SELECT unnest([o, i]) AS pos FROM pairs) u USING (pos) GROUP BY 1""",
    "c12_uploads": f"""WITH RECURSIVE {UPLOADED} SELECT s.id, account_id, strftime(date, '%Y-%m-%d') AS date, description, merchant, coalesce({KEYWORD}, 'Other') AS category, amount,
        m.id IS NOT NULL AS is_transfer, a.id IS NOT NULL AS is_recurring, CAST(upload AS BIGINT) AS upload FROM stored s LEFT JOIN moved m USING (id) LEFT JOIN again a USING (id)""",
    "a14_new_rows": f"""WITH {SENT} SELECT n.upload, owner || '-' || number || '-' || n.upload AS statement_id, any_value(n.account_id) AS account_id, count(*) AS submitted,
        count(*) FILTER (s.upload = n.upload) AS inserted, FALSE AS reconciled FROM named n JOIN stored s USING (id) GROUP BY n.upload, owner, number""",
    "o2_recurring_order": f"SELECT merchant, annual_cost, row_number() OVER (ORDER BY annual_cost DESC, merchant) AS rank FROM ({ORACLES['c8_find_recurring']}) WHERE nature IN ('subscription', 'bill')",
    "o3_result_cap": f"WITH {TXN} SELECT row_number() OVER (ORDER BY date DESC, id) AS rank, id, amount FROM txn QUALIFY rank <= 500",
    "o5_candidate_order": f"SELECT out_pos, in_pos, has_word, gap, row_number() OVER (ORDER BY has_word DESC, gap, least(out_pos, in_pos), greatest(out_pos, in_pos)) AS rank FROM ({ORACLES['j7_transfer_candidates']})",
}
