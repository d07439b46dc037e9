"""The queries of the training-data operators, each over its whole table, and the SQL for those that have one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import shared_folder, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_context_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.id_files import read_ids, write_ids

    path = shared_folder(spark)
    write_ids(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every document whose id is divisible by 50."""
    from tessera.llm.search import build_index, top_k

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return top_k(docs.where("doc_id % 50 = 0"), build_index(docs))


OP3_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM documents WHERE text IS NOT NULL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
n AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM dl) / (SELECT count(*) FROM documents) AS avgdl),
hits AS (
  SELECT q.doc_id AS query_id, d.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * d.tf * 2.2
    / (d.tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM tf q JOIN tf d ON q.term = d.term JOIN df ON df.term = q.term JOIN dl ON dl.doc_id = d.doc_id, n
  WHERE q.doc_id % 50 = 0 GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
FROM hits QUALIFY rank <= 10
"""


def op4_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality import judge

    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), drop_text=True)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op5_skip_chain_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pii import find_pii

    return find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op6_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_pieces and ids_crc32 with dropout 0.1, and whether the ids decode to the text (null: empty)."""
    from tessera.llm.pieces import encode_pieces

    pieces = encode_pieces(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), check=True)
    return pieces.select("doc_id", "n_pieces", F.crc32("ids").alias("ids_crc32"), "lossless")


#: The rules that op7's result is fixed for.
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.url_rules import judge_urls

    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_diagonal_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")


def op9_sparse_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.repeats import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op10_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op11_cartesian_lcp_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each with the first turns of its family's first one."""
    from tessera.llm.conversation_trie import grafted, prefix_trie, sequences

    return prefix_trie(grafted(sequences(table(spark, sf_dir, "conversations"))))


def op12_bloom_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.line_dedup import dedup_lines

    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op13_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of all documents, some of them with a repeated tail."""
    from tessera.llm.runs import periodic_runs, repeated_tail, summary

    docs = table(spark, sf_dir, "documents")
    return summary(periodic_runs(docs.select("doc_id", repeated_tail(F.col("doc_id"), F.col("text")).alias("text"))))


OP7_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules AS (SELECT * FROM (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) t(verdict, host, path)),
fits AS (
  SELECT p.page_id, r.verdict, r.host || r.path AS rule,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC, r.verdict) AS n
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id AND f.n = 1
"""

OP9_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (
  SELECT doc_id, unnest(range(0, len(w) - 49)) AS start_word, w FROM words WHERE len(w) >= 50),
passages AS (
  SELECT doc_id, start_word, array_to_string(list_slice(w, start_word + 1, start_word + 50), ' ') AS passage FROM places),
ranked AS (
  SELECT doc_id, start_word, count(*) OVER p AS n, row_number() OVER o AS k, first_value(doc_id) OVER o AS lead, lead(doc_id) OVER o AS follower
  FROM passages WINDOW p AS (PARTITION BY passage), o AS (PARTITION BY passage ORDER BY doc_id, start_word)),
found AS (
  SELECT doc_id, start_word, k > 1 AS is_repeat, CASE WHEN k > 1 THEN lead ELSE follower END AS other_doc_id FROM ranked WHERE n > 1),
marked AS (
  SELECT *, CASE WHEN start_word <= lag(start_word) OVER (PARTITION BY doc_id, is_repeat ORDER BY start_word) + 50 THEN 0 ELSE 1 END AS opens FROM found),
islands AS (
  SELECT *, sum(opens) OVER (PARTITION BY doc_id, is_repeat ORDER BY start_word) AS island FROM marked)
SELECT doc_id, min(start_word) AS start_word, max(start_word) + 50 AS end_word, max(start_word) + 50 - min(start_word) AS n_words,
  is_repeat, min(other_doc_id) AS other_doc_id
FROM islands GROUP BY doc_id, is_repeat, island
"""

OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
grams AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(0, len(w) - 4), lambda i: array_to_string(list_slice(w, i + 1, i + 5), ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS gram FROM words),
sizes AS (SELECT d.doc_id, count(g.gram) AS n FROM documents d LEFT JOIN grams g USING (doc_id) GROUP BY d.doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common.n >= 75 * (x.n + y.n - common.n)),
reach AS (
  SELECT doc_id, doc_id AS root FROM documents
  UNION
  SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.doc_id WHERE reach.root < links.b)
SELECT s.doc_id, s.n AS n_shingles, min(r.root) AS component_id
FROM sizes s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.n
"""

#: crc32 of a text of ASCII characters, as SQL: a step for each character, in it one for each bit.
_CRC = """(4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}, ''), lambda s: ascii(s)::BIGINT)), lambda a, s: list_reduce(list_prepend(xor(a, s), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))))"""

OP11_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
hashed AS (
  SELECT conv_id, turn, substr(sha256(length(role) || ':' || role || text), 1, 32) AS symbol,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM said),
words AS (SELECT DISTINCT symbol, words FROM hashed),
own AS (SELECT conv_id, list(symbol ORDER BY turn NULLS FIRST, symbol) AS s FROM hashed GROUP BY conv_id),
keyed AS (SELECT conv_id, s, """ + _CRC.format(x="conv_id::VARCHAR") + r""" % 4 AS h FROM own),
rebuilt AS (
  SELECT k.conv_id, coalesce(list_slice(b.s, 1, k.h), []) || list_slice(k.s, k.h + 1, len(k.s)) AS s
  FROM keyed k LEFT JOIN own b ON b.conv_id = k.conv_id - k.conv_id % 20),
begun AS (SELECT conv_id, len(s) AS size, s, unnest(range(0, len(s) + 1)) AS depth FROM rebuilt),
nodes AS (
  SELECT list_slice(s, 1, depth) AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends_sha256 FROM begun GROUP BY ALL),
grown AS (
  SELECT n.*, list_slice(path, 1, depth - 1) AS up, coalesce(w.words, 0) AS words, NOT EXISTS (SELECT 1 FROM nodes k WHERE k.depth = n.depth + 1 AND list_slice(k.path, 1, n.depth) = n.path) AS leaf
  FROM nodes n LEFT JOIN words w ON w.symbol = n.path[n.depth]),
over AS (SELECT list_slice(path, 1, d) AS path, leaf, (n_convs - 1) * words AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM grown)),
sums AS (SELECT path, count(*) FILTER (WHERE leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM over GROUP BY path),
kids AS (SELECT up AS path, count(*) AS n_children FROM grown WHERE depth > 0 GROUP BY up)
SELECT g.conv_id, g.depth, p.conv_id AS parent_conv_id, g.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, g.ends_sha256
FROM grown g JOIN sums s ON s.path = g.path LEFT JOIN kids k ON k.path = g.path LEFT JOIN nodes p ON g.depth > 0 AND p.path = g.up
"""

OP12_SQL = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM split),
repeated AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (
  SELECT k.doc_id, k.n, k.line, r.first IS NOT NULL AND k.doc_id <> r.first AS dropped FROM keyed k LEFT JOIN repeated r ON r.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP13_SQL = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, """ + _CRC.format(x="doc_id::VARCHAR") + r""" AS h FROM documents),
shaped AS (
  SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS changed, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS parts FROM texts),
made AS (
  SELECT doc_id, n, list_transform(range(0, n), lambda i: w[1 + CASE WHEN changed AND i >= a THEN a + (i - a) % (1 + (n - a) // parts) ELSE i END]) AS w FROM shaped),
words AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(0, n)) AS i FROM made),
pairs AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i AND 2 * (y.i - x.i) <= x.n),
stretches AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs) GROUP BY doc_id, q, island
  HAVING count(*) >= q AND count(*) + q >= 12),
runs AS (
  SELECT * FROM stretches s WHERE NOT EXISTS (
    SELECT 1 FROM stretches t WHERE t.doc_id = s.doc_id AND t.q < s.q AND t.start <= s.start AND t.start + t.length >= s.start + s.length)),
best AS (
  SELECT doc_id, count(*) AS n_runs, first(struct_pack(s := start, l := length, p := q) ORDER BY length DESC, start, q) AS b,
    string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM runs),
kept AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS text FROM words w ANTI JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY w.doc_id)
SELECT m.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.l AS length, b.p AS period, 1000 * b.l // b.p AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM made m LEFT JOIN best r ON r.doc_id = m.doc_id LEFT JOIN kept k ON k.doc_id = m.doc_id
"""

QUERIES = {
    "op1_context_range_coder": op1_context_range_coder,
    "op2_harmonic_packing": op2_harmonic_packing,
    "op3_block_max_wand": op3_block_max_wand,
    "op4_robust_outliers": op4_robust_outliers,
    "op5_skip_chain_crf": op5_skip_chain_crf,
    "op6_merge_dropout": op6_merge_dropout,
    "op7_url_rules": op7_url_rules,
    "op8_diagonal_voting": op8_diagonal_voting,
    "op9_sparse_suffix_arrays": op9_sparse_suffix_arrays,
    "op10_prefix_tree_join": op10_prefix_tree_join,
    "op11_cartesian_lcp_trie": op11_cartesian_lcp_trie,
    "op12_bloom_line_dedup": op12_bloom_line_dedup,
    "op13_lyndon_runs": op13_lyndon_runs,
}
ORACLES = {
    "op3_block_max_wand": OP3_SQL,
    "op7_url_rules": OP7_SQL,
    "op9_sparse_suffix_arrays": OP9_SQL,
    "op10_prefix_tree_join": OP10_SQL,
    "op11_cartesian_lcp_trie": OP11_SQL,
    "op12_bloom_line_dedup": OP12_SQL,
    "op13_lyndon_runs": OP13_SQL,
}
