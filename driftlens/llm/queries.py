"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftlens.llm import conversations, decontaminate, fim, fingerprints, linededup, neardup, pages, pieces, quality, sharding, toxicity, transducer, urls
from driftlens.llm.tables import table, tokenizer_path

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, table(spark, sf_dir, "labels")))


LINES_SQL = r"""
WITH lines AS (
  SELECT d.doc_id, u.line_no, u.line,
         translate(trim(u.line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d,
       LATERAL (SELECT unnest(d.parts) AS line, unnest(range(len(d.parts))) AS line_no) u
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.*, (r.keeper IS NOT NULL AND l.doc_id < r.keeper) AS gone FROM lines l LEFT JOIN repeated r ON l.key = r.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op2_line_dedup", LINES_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents"))


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(transducer.WORD_MODEL))


# distinct 5-word shingles of a table {0} with id {1}
SHINGLES_SQL = r"""
{1}_words AS (
  SELECT {1}, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\x0c\r]+'), lambda w: w <> '') AS w
  FROM {0}
), {1}_sets AS (
  SELECT {1}, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM {1}_words
), {1}_shingles AS (SELECT {1}, len(s) AS n, unnest(s) AS shingle FROM {1}_sets)
"""

NEAR_SQL = "WITH RECURSIVE " + SHINGLES_SQL.format("documents", "doc_id") + """,
posting AS (SELECT shingle, list(doc_id) AS ids FROM doc_id_shingles GROUP BY shingle HAVING count(*) > 1),
common AS (
  SELECT a, b, count(*) AS n FROM (SELECT a, unnest(ids) AS b FROM (SELECT unnest(ids) AS a, ids FROM posting)) WHERE a < b GROUP BY a, b
), links AS (
  SELECT a, b FROM common JOIN doc_id_sets x ON x.doc_id = a JOIN doc_id_sets y ON y.doc_id = b
  WHERE 100 * n >= 75 * (len(x.s) + len(y.s) - n)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, (s.doc_id = c.component_id) AS kept
FROM doc_id_sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c ON s.doc_id = c.doc_id
"""


@query("op4_minhash_near_dedup", NEAR_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_fingerprints")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


@query("op6_url_filter")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


@query("op7_sentencepiece")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(pieces.PIECE_MODEL))


@query("op8_html_text")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_pages(table(spark, sf_dir, "pages"))


LEAKS_SQL = "WITH " + SHINGLES_SQL.format("documents", "doc_id") + ", " + SHINGLES_SQL.format("benchmark", "item_id") + """
SELECT doc_id, item_id, count(*)::BIGINT AS shared, any_value(i.n)::BIGINT AS n_item, count(*) / any_value(i.n) AS containment
FROM doc_id_shingles d JOIN item_id_shingles i ON d.shingle = i.shingle GROUP BY doc_id, item_id HAVING count(*) >= 0.75 * any_value(i.n)
"""


@query("op9_decontamination", LEAKS_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train_quality(docs, table(spark, sf_dir, "labels")))


FIM_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), numbers AS (
  SELECT doc_id, text, n, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS c2,
         ('0x' || substr(h, 17, 8))::BIGINT % 100 AS d3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS d4 FROM drawn
), cut AS (
  SELECT doc_id, text, n, least(c1, c2) AS a, greatest(c1, c2) AS b,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d3 >= 90 THEN 'plain' WHEN d4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), parts AS (
  SELECT doc_id, n, form, a, b, text, substr(text, 1, a) AS p, substr(text, a + 1, b - a) AS m, substr(text, b + 1, n - b) AS s FROM cut
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


@query("op11_fill_in_middle", FIM_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fill_in_middle_digests(table(spark, sf_dir, "documents"))


@query("op13_sharding")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


# crc32 of an id's decimal digits; sequences as lists of turn digests, nodes as their prefixes
TRIE_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), tokens AS (
  SELECT conv_id, turn, length(text) AS len, md5(length(role)::VARCHAR || ':' || role || text) AS t FROM turns
), own AS (
  SELECT conv_id, list({'t': t, 'len': len} ORDER BY turn NULLS FIRST, t) AS s FROM tokens GROUP BY conv_id
), heads AS (
  SELECT conv_id, s, conv_id - conv_id % 100 AS base,
         (xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
              lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)), 4294967295) % 6)::BIGINT AS h
  FROM own
), built AS (
  SELECT x.conv_id, list_concat(coalesce(b.s[1:x.h], []), x.s[x.h + 1:]) AS s FROM heads x LEFT JOIN own b ON b.conv_id = x.base
), prefixes AS (
  SELECT conv_id, d, len(s) = d AS ends, md5(array_to_string(list_transform(s[1:d], lambda x: x.t), ',')) AS k,
         CASE WHEN d > 0 THEN md5(array_to_string(list_transform(s[1:d - 1], lambda x: x.t), ',')) END AS up, CASE WHEN d > 0 THEN s[d].len ELSE 0 END AS len
  FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM built)
), nodes AS (
  SELECT d, k, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n, any_value(len) AS len,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM prefixes GROUP BY d, k
), children AS (SELECT d - 1 AS d, up AS k, count(*) AS c FROM nodes WHERE d > 0 GROUP BY ALL),
known AS (SELECT n.*, coalesce(c.c, 0) AS c FROM nodes n LEFT JOIN children c ON n.d = c.d AND n.k = c.k),
sums AS (
  SELECT p.d, p.k, count(*) FILTER (WHERE x.c = 0) AS n_leaves, sum((x.n - 1) * x.len) AS saved
  FROM known x JOIN prefixes p ON p.conv_id = x.conv_id AND p.d <= x.d GROUP BY p.d, p.k
)
SELECT x.conv_id, x.d AS depth, u.conv_id AS parent_conv_id, x.n AS n_convs, x.c AS n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, x.ends_sha256
FROM known x JOIN sums s ON s.d = x.d AND s.k = x.k LEFT JOIN known u ON u.d = x.d - 1 AND u.k = x.up
"""


@query("op12_conversation_trie", TRIE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.conversation_trie(table(spark, sf_dir, "conversations"))
