"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import byte_bpe, chat_format, code_compression, language_id, lattice_dedup, mixing, ordinal_quality, prefix_trie, simhash, substring_dedup, threshold_topk, url_filter, warc
from linkloom.scratch import materialise


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal_quality.rated_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_topk.top_k(_table(spark, sf_dir, "embeddings"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(_table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.digests(_table(spark, sf_dir, "documents"), byte_bpe.load_vocabulary(path, public_tokenizers.PATTERN))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = materialise(chat_format.format_turns(chat_format.with_probe(_table(spark, sf_dir, "conversations"))), "chats")
    return chat_format.conversation_digests(turns, materialise(chat_format.examples(turns), "examples", "zstd"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.kept_digests(_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_compression.compress(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_embedding_dedup, op2_quality_classifier, op3_exact_topk, op4_simhash_dedup, op5_language_id,
        op6_source_mixing, op7_byte_bpe, op8_url_filter, op9_chat_format, op10_warc,
        op11_substring_dedup, op12_prefix_trie, op13_code_compression,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embedding_dedup": OP1_SQL,
        "op3_exact_topk": OP3_SQL,
        "op9_chat_format": OP9_SQL,
        "op10_warc": OP10_SQL,
        "op11_substring_dedup": OP11_SQL,
        "op12_prefix_trie": OP12_SQL,
        "op13_code_compression": _op13_sql(),
    }


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), able AS (
  SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM able a JOIN able b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
   AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), root AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a
), degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, r.component_id, v.vec_id = r.component_id AS kept
FROM v LEFT JOIN degree d ON d.a = v.vec_id LEFT JOIN root r ON r.a = v.vec_id
"""

OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, row_number() OVER w AS place,
    length(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'),
      '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '[SYS]', '[\SYS]'), '[/SYS]', '[\/SYS]'), '[TURN ', '[\TURN '), '[/TURN]', '[\/TURN]')) AS body
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), f AS (
  SELECT *, body + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 ELSE 15 + length(role) END
    + CASE WHEN place = 1 THEN 3 ELSE 0 END AS chars FROM e
), g AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM f)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars, count(*) FILTER (role = 'assistant') AS n_examples,
  coalesce(sum(upto) FILTER (role = 'assistant'), 0)::BIGINT AS example_chars
FROM g GROUP BY conv_id
"""

OP10_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM f
"""

OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d)
), low AS (SELECT k, min(doc_id) AS low FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM win JOIN low USING (k) WHERE low < doc_id
), word AS (SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS p FROM d
), left_over AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS kept FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
), span AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (prior IS NULL OR prior < p - 1) AS n_spans
  FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS prior FROM gone) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_spans, 0)::INTEGER AS n_spans
FROM d LEFT JOIN left_over USING (doc_id) LEFT JOIN span USING (doc_id)
"""


def _crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, bit by bit."""
    step = "CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = f"list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: {step})"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda y: ascii(y)::BIGINT)), lambda c, x: {byte}), 4294967295)"


OP12_SQL = f"""
WITH RECURSIVE t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base, {_crc32_sql("conv_id::VARCHAR")} % 6 AS h FROM t
), b AS (
  SELECT c.conv_id, 0 AS own, t.p, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.p < c.h
  UNION ALL SELECT c.conv_id, 1, t.p, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.p >= c.h
), r AS (
  SELECT conv_id, row_number() OVER w AS d, length(text) AS chars, md5(length(role) || ':' || role || text) AS own
  FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY own, p)
), s AS (
  SELECT conv_id, d, chars, string_agg(own, '') OVER (PARTITION BY conv_id ORDER BY d) AS k FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c
), parent AS (SELECT DISTINCT k, left(k, greatest(length(k) - 32, 0)) AS up FROM s
), node AS (SELECT k, any_value(d) AS depth, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs FROM s GROUP BY k
), kids AS (SELECT up AS k, count(*) AS n FROM parent WHERE k <> '' GROUP BY up
), under AS (SELECT DISTINCT a.k, b.k AS x FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.d >= a.d
), sums AS (
  SELECT u.k, count(*) FILTER (kids.k IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.chars)::BIGINT AS saved
  FROM under u JOIN node n ON n.k = u.x LEFT JOIN kids ON kids.k = u.x GROUP BY u.k
), full_ AS (SELECT conv_id, max_by(k, d) AS k FROM s GROUP BY conv_id
), ends AS (SELECT k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM full_ GROUP BY k)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, sums.n_leaves, sums.saved AS saved_tokens,
  sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM node n JOIN parent p ON p.k = n.k LEFT JOIN node up ON up.k = p.up AND n.k <> '' LEFT JOIN kids ON kids.k = n.k
  JOIN sums ON sums.k = n.k LEFT JOIN ends ON ends.k = n.k
"""


def _op13_sql() -> str:
    """Six rounds and a last assignment, written out."""
    book = "SELECT p, s AS e, j, x AS c FROM part WHERE s < 16"
    steps = []
    for i in range(7):
        steps.append(f"book{i} AS ({book})")
        steps.append(
            f"near{i} AS (SELECT r, p, min_by(e, (far, e)) AS e, min(far) AS far FROM"
            f" (SELECT r, p, e, sum((x - c) * (x - c)) AS far FROM part JOIN book{i} USING (p, j) GROUP BY r, p, e) GROUP BY r, p)"
        )
        book = f"SELECT b.p, b.e, b.j, coalesce(m.c, b.c) AS c FROM book{i} b LEFT JOIN (SELECT p, e, j, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS c FROM part JOIN near{i} USING (r, p) GROUP BY p, e, j) m USING (p, e, j)"
    return f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS w, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), flat AS (SELECT r, unnest(w) AS x, unnest(range(0, len(w))) AS i, len(w) // 8 AS width FROM v
), part AS (SELECT r, r AS s, i // width AS p, i % width AS j, x FROM flat
), {", ".join(steps)}, code AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM near6 GROUP BY r
), total AS (SELECT label, sum(error)::BIGINT AS label_error FROM code JOIN v USING (r) GROUP BY label)
SELECT vec_id, code, error, label_error, (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, j)) FROM book6) AS codebooks_sha256
FROM code JOIN v USING (r) JOIN total ON v.label IS NOT DISTINCT FROM total.label
"""
