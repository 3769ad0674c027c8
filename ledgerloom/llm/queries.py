"""The query of each corpus operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, exact_dedup, fill_middle, html_extract, jaccard_join, lang_id, packing, quality, secrets, suffix_dedup, token_counts, token_files
from .common import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return exact_dedup.exact_dedup(docs, exact_dedup.newer_half(docs))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches on one ledger: what the first has seen is not scanned again for the second."""
    docs = _table(spark, sf_dir, "documents")
    new, ledger = F.coalesce(exact_dedup.newer_half(docs), F.lit(False)), new_path(spark, "ledger")
    for batch in (~new, new):
        secrets.record(docs.where(batch), ledger)
    return secrets.digest_columns(secrets.report(docs, spark.read.parquet(ledger)))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = lang_id.identify(docs, lang_id.fit(docs))
    return found.select("doc_id", lang_id.held_out().alias("held_out"), "lang_pred", "score")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents")).drop("kept")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    token_files.write(_table(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"))
    return token_files.documents(token_files.read(spark, path))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest_columns(fill_middle.fill_in_middle(_table(spark, sf_dir, "documents")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return conversations.for_all(rows, conversations.report(conversations.repair(conversations.damage(rows))))


def queries() -> dict:
    own = (
        op1_exact_dedup, op2_quality_classifier, op3_secret_scan, op4_language_id, op5_html_extraction,
        op6_suffix_dedup, op7_token_counts, op8_jaccard_join, op9_decontamination, op10_packing,
        op11_token_files, op12_fill_in_middle, op13_conversation_repair,
    )
    return {f.__name__: f for f in own} | {"pipeline": pipeline}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op3_secret_scan": OP3_SQL, "op12_fill_in_middle": OP12_SQL, "op13_conversation_repair": OP13_SQL}


OP1_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g ON d.t = g.t
"""


def _kind_sql(rule: secrets.Rule, rank: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    sized = "m" if not rule.group else f"regexp_extract_all(t, '{pattern}', {rule.group})"
    return f"""
SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, g AS stop, g - length(m[i]) AS start FROM (
  SELECT doc_id, m, z, i, list_sum(list_transform(gaps[:i], lambda x: length(x))) + list_sum(list_transform(m[:i], lambda x: length(x))) AS g
  FROM (SELECT doc_id, m, gaps, {sized} AS z, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, t, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_split_to_array(t, '{pattern}') AS gaps FROM d WHERE regexp_matches(t, '{pattern}')))
) WHERE length(z[i]) >= {rule.least}"""


OP3_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_kind_sql(r, i) for i, r in enumerate(secrets.BASE + secrets.ADDED))}),
s AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < {len(secrets.BASE)}) AS base,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN s USING (doc_id)
"""

OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS y,
  CAST('0x' || h[17:24] AS BIGINT) % 100 AS z, CAST('0x' || h[25:32] AS BIGINT) % 100 AS w FROM d),
c AS (SELECT doc_id, t, n, CASE WHEN n = 0 OR z >= 90 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN w < 20 THEN 'spm' ELSE 'psm' END AS form,
  least(x, y) AS a, greatest(x, y) AS b FROM r),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1, n - b) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""


def _op13_sql() -> str:
    """The same edits by a plain table over rows and states, for each state the least (cost, letters, text) so far."""
    add = lambda s, cost, letter, text="''": f"CASE WHEN {s} IS NOT NULL THEN struct_pack(c := {s}.c + {cost}, a := {s}.a || '{letter}', t := {s}.t || {text}) END"
    kept, user, bot = "(chr(10) || role || ':' || text)", "(chr(10) || 'user:' || text)", "(chr(10) || 'assistant:' || text)"
    when = lambda test, x: f"CASE WHEN {test} THEN {x} END"
    least = lambda *xs: f"list_min([{', '.join(xs)}])"
    stay = lambda test, s: when(f"NOT gone AND {test}", add(s, "late", "K", kept))
    to_user = [x for s in ("b0", "b1", "b3") for x in (stay("initial = 'u'", s), when("NOT gone", add(s, "1 + late", "R", user)))]
    to_bot = [stay("initial = 'a'", "b2"), when("NOT gone", add("b2", "1 + late", "R", bot))]
    steps = f"""
      SELECT conv_id, i, {add('b0', 2, 'D')} AS b0, {least(add('b1', 2, 'D'), stay("initial = 's'", 'b0'))} AS b1,
        {least(add('b2', 2, 'D'), *to_user)} AS b2, {least(add('b3', 2, 'D'), *to_bot)} AS b3"""
    user_put, bot_put = "(chr(10) || 'user:')", "(chr(10) || 'assistant:')"
    put_user = lambda cols: f"SELECT conv_id, i, b0, b1, {least('b2', *(add(s, 5, 'I', user_put) for s in ('b0', 'b1', 'b3')))} AS b2, b3 FROM ({cols})"
    put_bot = lambda cols: f"SELECT conv_id, i, b0, b1, b2, {least('b3', add('b2', 5, 'I', bot_put))} AS b3 FROM ({cols})"
    none = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR))"
    begin = f"SELECT conv_id, CAST(0 AS BIGINT) AS i, CAST(struct_pack(c := 0, a := '', t := '') AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS b0, {none} AS b1, {none} AS b2, {none} AS b3 FROM facts"
    recur = steps + " FROM (SELECT p.*, r.* EXCLUDE (conv_id, i), r.i AS j FROM way p JOIN judged r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1)"
    recur = recur.replace("SELECT conv_id, i, ", "SELECT conv_id, j AS i, ", 1)
    return f"""
WITH RECURSIVE poly(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM poly WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS l FROM poly WHERE k = 8),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hashed AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, l[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS h FROM keyed, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS nth FROM hashed WHERE h <> 0),
placed AS MATERIALIZED (SELECT conv_id, turn, role, text, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, substr(role, 1, 1) AS initial,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text), nth) AS i FROM damaged),
counted AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM placed),
judged AS MATERIALIZED (SELECT *, body = '' OR seen > 1 AS gone, CASE WHEN body = '' THEN 1 WHEN seen > 1 THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
  CASE WHEN body <> '' AND seen = 1 AND right(body, 1) NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS late,
  lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM counted),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
  count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM judged GROUP BY conv_id),
way AS ({put_bot(put_user(begin))} UNION ALL {put_bot(put_user(recur))}),
best AS (SELECT w.conv_id, {least('b0', 'b3')} AS b FROM way w JOIN facts f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.i)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(substr(b.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id
"""


OP13_SQL = _op13_sql()
