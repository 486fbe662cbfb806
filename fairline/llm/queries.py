"""The registered queries of the operators, with twin SQL where SQL can say it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op6_bpe")
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op6_bpe import digests
    return digests(table(spark, sf_dir, "documents"), tokenizer_path())


# ---- 1: chat formatting

PROBE = "\\### Assistant: </turn> ok"

OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + 6 + length(regexp_replace(text, '(\\*)(###|</turn>)', '\\\1\2', 'g')) + 9)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""


@query("op1_chat_format", OP1_SQL)
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op1_chat import read_back, render_turns
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], turns.schema)
    return read_back(render_turns(turns.unionByName(probe)))


# ---- 3: benchmark decontamination

OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
      FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
s AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS win
      FROM d, (SELECT DISTINCT m FROM p) AS l, unnest(range(1, greatest(len(w) - m + 2, 1))) AS u(i)),
o AS (SELECT doc_id, i, s.m, item_id FROM s JOIN p ON s.win = p.win AND s.m = p.m),
h AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM o, unnest(range(0, m)) AS v(k) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM o) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


@query("op3_decontaminate", OP3_SQL)
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op3_decontaminate import report
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# ---- 9: token ids in binary records

@query("op9_token_records")
def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op9_tokens import round_trip
    return round_trip(spark, table(spark, sf_dir, "documents"), tokenizer_path(), 2)


# ---- 10: toxicity

@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op10_toxicity import report
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# ---- 7: language identification

@query("op7_language")
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op7_language import report
    return report(table(spark, sf_dir, "documents"))


# ---- 5: document fingerprints

@query("op5_winnowing")
def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op5_winnow import report
    return report(table(spark, sf_dir, "documents"))


# ---- 8: MinHash near-duplicates

OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
      HAVING 100 * count(*) >= 85 * ((SELECT n FROM n WHERE doc_id = a.doc_id) + (SELECT n FROM n WHERE doc_id = b.doc_id) - count(*))),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = d.doc_id"""


@query("op8_near_duplicates", OP8_SQL)
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op8_neardup import report
    return report(table(spark, sf_dir, "documents"))


# ---- 4: language-model scoring

@query("op4_lm_score")
def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op4_lm import report
    return report(table(spark, sf_dir, "documents"))


# ---- 2: WARC

OP2_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
b AS (SELECT d, max(page_id) AS best FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> best THEN best END AS refers_to
FROM p LEFT JOIN b ON p.d = b.d"""


@query("op2_warc", OP2_SQL)
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op2_warc import round_trip
    return round_trip(spark, table(spark, sf_dir, "pages"))


# ---- 12: filter interaction audit

OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT part,
    (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1) AS good,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1) AS toxic FROM d),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter,
        1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit,
        list_sum([0] || [1 << (ascii(substr(filter_order, k, 1)) - 65) for k in range(1, step)])::INT AS before
      FROM o, unnest(range(1, 6)) AS u(step)),
r AS (SELECT part, filter_order, step, letter,
        count(*) FILTER (mask & (before + bit) = 0) AS kept,
        count(*) FILTER (mask & before = 0 AND mask & bit > 0) AS removed,
        count(*) FILTER (mask & before > 0 AND mask & bit > 0) AS redundant,
        count(*) FILTER (mask = bit) AS unique_fails,
        count(*) FILTER (mask & before = 0 AND mask & bit > 0 AND good) AS good_lost,
        count(*) FILTER (mask & before = 0 AND mask & bit > 0 AND toxic) AS toxic_lost
      FROM f, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley
FROM r"""


@query("op12_filter_audit", OP12_SQL)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op12_audit import report
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# ---- 13: fill-in-middle

OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
    list_transform(regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+'), lambda x: length(x)) AS w FROM documents),
n AS (SELECT *, len(w)::BIGINT AS n, [('0x' || substr(h, 8 * k + 1, 8))::UBIGINT::BIGINT for k in range(0, 4)] AS g FROM d),
c AS (SELECT *, least(g[1] % (n + 1), g[2] % (n + 1)) AS lo, greatest(g[1] % (n + 1), g[2] % (n + 1)) AS hi,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR g[3] % 100 >= 50 THEN 'plain'
         WHEN g[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, coalesce(list_sum(w[1:lo]), 0)::BIGINT AS a, coalesce(list_sum(w[1:hi]), 0)::BIGINT AS b FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN '<P>' || substr(text, 1, a) || '<S>' || substr(text, b + 1) || '<M>' || substr(text, a + 1, b - a)
    ELSE '<S>' || substr(text, b + 1) || '<P>' || substr(text, 1, a) || '<M>' || substr(text, a + 1, b - a) END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p"""


@query("op13_fill_in_middle", OP13_SQL)
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op13_fim import report
    return report(table(spark, sf_dir, "documents"))


# ---- 11: substring dedup

OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM d, unnest(range(1, len(w) - 11)) AS u(i)),
m AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) AS owner FROM s) WHERE owner < doc_id),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM m, unnest(range(0, 13)) AS v(k)),
x AS (SELECT doc_id, i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(i)),
k AS (SELECT doc_id, count(c.i) AS n_removed, string_agg(word, ' ' ORDER BY x.i) FILTER (c.i IS NULL) AS kept
      FROM x LEFT JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""


@query("op11_repeats", OP11_SQL)
def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op11_repeats import report
    return report(table(spark, sf_dir, "documents"))
