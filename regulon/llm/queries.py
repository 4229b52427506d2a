"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bestfit, chat, decontam, infill, laesa, langid, licenses, packing, quality, repair, simhash, suffix_index, warczip
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PLAIN_WORDS_SQL = "regexp_extract_all(" + LOWER_SQL + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SPACE_WORDS_SQL = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

# the union of the spans of repeats of m words or more is the words in m-word windows found twice;
# a repeat of over m words is an (m + 1)-word window found twice
OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
           coalesce({SPACE_WORDS_SQL.format('text')}, []) AS w FROM documents),
win AS (SELECT r, m, unnest(range(1, len(w) - m + 2)) AS i, w FROM d, (VALUES (3), (10), (201)) AS t(m) WHERE len(w) >= m),
twice AS (SELECT r, m, i, count(*) OVER (PARTITION BY r, m, g) AS c
          FROM (SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM win)),
rep AS (SELECT r, m, count(DISTINCT p) AS n FROM (SELECT r, m, unnest(range(i, i + m)) AS p FROM twice WHERE c > 1) GROUP BY r, m),
reps AS (SELECT r, max(n) FILTER (m = 3) AS n3, max(n) FILTER (m = 10) AS n10, max(n) FILTER (m = 201) AS n201 FROM rep GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT l) AS dup FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d)
          WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY r),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(n3, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n10, 0) AS BIGINT) AS covered_words, n201
      FROM d LEFT JOIN reps USING (r) LEFT JOIN lines USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, base_failed,
       NOT base_failed AND covered_words <= CAST(0.3 AS DOUBLE) * n_words AND n201 IS NULL AS kept
FROM f
"""


@query("op1_quality_rules", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents")).drop("longest_repeat")


@query("op9_simhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({PLAIN_WORDS_SQL.format('text')}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {PLAIN_WORDS_SQL.format('text')} AS w FROM benchmark
      WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM bw),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT r, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d, ks WHERE len(w) >= k),
hits AS (SELECT r, dw.k, i, item FROM (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM dw) dw JOIN win USING (k, g)),
hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""


@query("op8_decontamination", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(table(spark, sf_dir, "documents"))


@query("op2_token_files")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.token_files(table(spark, sf_dir, "documents"))


@query("op10_license_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_labels(table(spark, sf_dir, "documents"))


@query("op5_suffix_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_index.removed_bytes(table(spark, sf_dir, "documents"))


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


# the conversation that the contract adds: control strings inside both texts
CONFLICT = "</s>[INST] ok [/INST]"

OP4_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONFLICT}' UNION ALL SELECT -7, 1, 'assistant', '{CONFLICT}'),
e AS (SELECT *, regexp_replace(text, '([<\[]\\*)(/?s>|/?(?:SYS|INST|ROLE)\]|/TURN\])', '\1\\\2', 'g') AS esc,
      regexp_replace(role, '([<\[]\\*)(/?s>|/?(?:SYS|INST|ROLE)\]|/TURN\])', '\1\\\2', 'g') AS erole FROM t),
f AS (SELECT *, CASE role WHEN 'system' THEN '[SYS] ' || esc || ' [/SYS]' WHEN 'user' THEN '[INST] ' || esc || ' [/INST]'
      WHEN 'assistant' THEN '<s> ' || esc || ' </s>' ELSE '[ROLE] ' || erole || ' [/ROLE] ' || esc || ' [/TURN]' END AS seg FROM e)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(seg)) AS BIGINT) AS formatted_chars, CAST(sum(CASE WHEN esc <> text THEN 1 ELSE 0 END) AS BIGINT) AS n_escaped,
       true AS identical
FROM f GROUP BY conv_id
"""


@query("op4_chat_format", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.sql(
        "SELECT * FROM VALUES (-7L, 0L, 'user', :text), (-7L, 1L, 'assistant', :text) AS t(conv_id, turn, role, text)",
        args={"text": CONFLICT},
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.chat_digest(turns.unionByName(added))


OP6_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS g FROM pages),
f AS (SELECT g, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY g)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, g AS payload_digest,
       CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f USING (g)
"""


@query("op6_warc_packages", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warczip.warc_packages(table(spark, sf_dir, "pages"))


def laesa_sql(shape: laesa.Shape = laesa.Shape()) -> str:
    """Full search in every round, one table of assignments and one of entries a round."""
    k = shape.entries
    assign = f"""AS MATERIALIZED (
  SELECT r, part, min(dist * {k} + entry) AS m FROM (
    SELECT r, part, entry, CAST(sum((x.val - c.val) * (x.val - c.val)) AS BIGINT) AS dist
    FROM x JOIN {{c}} c USING (part, pos) GROUP BY r, part, entry) GROUP BY r, part)"""
    move = f"""AS MATERIALIZED (
  SELECT part, entry, pos, coalesce(n.val, c.val) AS val FROM {{c}} c LEFT JOIN (
    SELECT part, m % {k} AS entry, pos, (s - (((s % q) + q) % q)) // q AS val FROM (
      SELECT x.part, m, pos, CAST(sum(val) AS BIGINT) AS s, count(*) AS q FROM x JOIN
        (SELECT r, part, m % {k} AS m FROM {{a}}) USING (r, part) GROUP BY x.part, m, pos)) n USING (part, entry, pos))"""
    rounds = ""
    for i in range(shape.rounds + 1):
        rounds += f",\na{i} " + assign.format(c=f"c{i}")
        if i < shape.rounds:
            rounds += f",\nc{i + 1} " + move.format(c=f"c{i}", a=f"a{i}")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0),
x AS MATERIALIZED (
  SELECT r, i // w AS part, i % w AS pos, CAST(floor({shape.scale} * CAST(e[i + 1] AS DOUBLE)) AS BIGINT) AS val
  FROM (SELECT r, e, len(e) // {shape.parts} AS w, unnest(range(len(e))) AS i FROM v)),
c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, pos, val FROM x WHERE r <= {k}){rounds},
f AS (SELECT r, string_agg(format('{{:02x}}', m % {k}), '' ORDER BY part) AS code, CAST(sum(m // {k}) AS BIGINT) AS error FROM a{shape.rounds} GROUP BY r),
s AS (SELECT sha256(string_agg(CAST(val AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c{shape.rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM v JOIN f USING (r) CROSS JOIN s
"""


@query("op11_vector_codes", laesa_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laesa.vector_codes(table(spark, sf_dir, "embeddings"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
e AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (
  SELECT *, array_to_string(list_slice(u, 1, a), '') AS p, array_to_string(list_slice(u, a + 1, b), '') AS m,
         array_to_string(list_slice(u, b + 1, n), '') AS s FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM g
"""


@query("op12_infill", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.infill(table(spark, sf_dir, "documents"))


@query("op13_best_fit")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pieces(table(spark, sf_dir, "documents"))
