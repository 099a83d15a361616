"""The queries of this subpackage by name, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: The folder of the public tokenizers' files; their path is a parameter of the operators.
WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_and_read

    return archive_and_read(table(spark, sf_dir, "pages"))


# Base 32 of the 160 bits: each 5 bits are a letter of the alphabet.
OP3_SQL = """
WITH payloads AS (
  SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS sha, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS least FROM pages
), bits AS (
  SELECT page_id, body, least, array_to_string([rpad(lpad(bin(instr('0123456789abcdef', c) - 1), 4, '0'), 4, '0') FOR c IN string_split(sha, '')], '') AS b FROM payloads
)
SELECT page_id, octet_length(body) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(16 * CAST(b[5*k+1] AS INT) + 8 * CAST(b[5*k+2] AS INT) + 4 * CAST(b[5*k+3] AS INT) + 2 * CAST(b[5*k+4] AS INT) + CAST(b[5*k+5] AS INT) AS INT), 1) FOR k IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> least THEN least END AS refers_to
FROM bits
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op6_neargraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neargraph import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings")).drop("recall")


OP6_SQL = """
WITH RECURSIVE valid AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95
), reach AS (
  SELECT vec_id AS start, vec_id AS node FROM embeddings
  UNION
  SELECT r.start, l.b FROM reach r JOIN links l ON l.a = r.node
), least AS (SELECT start, min(node) AS component_id FROM reach GROUP BY start),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON start = vec_id LEFT JOIN counts ON a = vec_id
"""


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .unigram import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path(PIECES), kind="bpe")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import configured_key, pseudonymize

    return pseudonymize(table(spark, sf_dir, "documents"), configured_key(spark))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') AS gram
  FROM items, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS u(k)
  WHERE len(w) > 0
), sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
  SELECT doc_id, size, k, array_to_string(w[k : k + size - 1], ' ') AS gram
  FROM words, sizes, unnest(range(1, len(w) - size + 2)) AS u(k)
  WHERE len(w) >= size
), matches AS (SELECT g.doc_id, g.k, g.size, v.item_id FROM grams g JOIN windows v USING (size, gram)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM matches, unnest(range(k, k + size)) AS u(p) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM matches WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltext import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path(PIECES))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .runs import periodic_runs, repeated_tail, summary

    return summary(periodic_runs(table(spark, sf_dir, "documents"), rewrite=repeated_tail))


def op13_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tries import lent, prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"), lent)


# CRC-32 byte by byte, with its table of 256 remainders.
OP13_SQL = """
WITH crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)
), own AS (
  SELECT conv_id, role, text, octet_length(encode(text)) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha) - 1 AS rank, sha
  FROM (SELECT conv_id, turn, role, text, sha256(concat(octet_length(encode(role)), ':', role, text)) AS sha
        FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL))
), convs AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295, [CAST(ord(c) AS BIGINT) FOR c IN string_split(CAST(conv_id AS VARCHAR), '')]), lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM own), crc_table
), placed AS (
  SELECT c.conv_id, 0 AS part, o.rank, o.sha, o.size FROM convs c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 5 AND o.rank < c.h
  UNION ALL
  SELECT c.conv_id, 1, o.rank, o.sha, o.size FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.rank >= c.h
), paths AS (
  SELECT conv_id, list(sha) OVER w AS path, size FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY part, rank ROWS UNBOUNDED PRECEDING)
  UNION ALL
  SELECT conv_id, CAST([] AS VARCHAR[]), 0 FROM convs
), nodes AS (
  SELECT path, min(conv_id) AS conv_id, len(path) AS depth, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved FROM paths GROUP BY path
), children AS (
  SELECT path[1 : depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), sums AS (
  SELECT path[1 : k] AS path, sum(saved) AS saved_tokens, count(*) FILTER (WHERE leaf) AS n_leaves
  FROM (SELECT n.path, n.saved, c.path IS NULL AS leaf, unnest(range(0, n.depth + 1)) AS k FROM nodes n LEFT JOIN children c ON c.path = n.path) GROUP BY 1
), ends AS (
  SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, max_by(path, len(path)) AS path FROM paths GROUP BY conv_id) GROUP BY path
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[1 : n.depth - 1] LEFT JOIN children c ON c.path = n.path JOIN sums s ON s.path = n.path LEFT JOIN ends e ON e.path = n.path
"""


ALL = (op1_bpe, op2_simhash, op3_warc, op4_toxicity, op5_langid, op6_neargraph, op7_token_counts, op8_pii, op9_decontaminate, op10_main_text, op11_pieces, op12_runs, op13_tries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3_SQL, "op6_neargraph": OP6_SQL, "op9_decontaminate": OP9_SQL, "op13_tries": OP13_SQL}
