"""The registered queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import chat, exact_dedup, jaccard, langid, license, media, packing, sentencepiece_scan, toxicity, warc
from tessella.llm.common import shared_path, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = sentencepiece_scan.decode(sentencepiece_scan.encode(table(spark, sf_dir, "documents")))
    return texts.select("doc_id", "n_chunks", "n_tokens", "ids_digest", F.length("text").cast("long").alias("decoded_chars"), F.sha2("text", 256).alias("decoded_sha256"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), shared_path(spark, "warc"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.clip_list(media.read_media(media.with_media(table(spark, sf_dir, "documents"))))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


def op10_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_packing": op3_packing,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_warc": op5_warc,
        "op6_media": op6_media,
        "op7_language_id": op7_language_id,
        "op8_jaccard_join": op8_jaccard_join,
        "op9_license_scan": op9_license_scan,
        "op10_chat_rotation": op10_chat_rotation,
    }


OP2_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n
"""


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
g AS (SELECT page_id, payload, sha1(payload) AS h, max(page_id) OVER (PARTITION BY payload) AS keep FROM p)
SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((CAST('0x' || substr(h, CAST((5 * i) // 4 + 1 AS BIGINT), 2) AS INT) >> CAST(3 - (5 * i) % 4 AS INT)) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
FROM g
"""

OP10_SQL = r"""
WITH t AS (
  SELECT DISTINCT conv_id, CAST(turn AS BIGINT) AS turn,
         replace(CASE WHEN trim(translate(coalesce(role, ''), chr(13) || chr(10), '  ')) = '' THEN 'unknown'
                      ELSE trim(translate(role, chr(13) || chr(10), '  ')) END, '<|', '< |') AS speaker,
         replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations),
k AS (SELECT *, coalesce(CAST(floor(turn / 512.0e0) AS BIGINT), -1) AS block FROM t),
b AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, block ORDER BY turn NULLS FIRST, speaker, body) - 1) // 512 AS part FROM k),
p AS (SELECT DISTINCT conv_id, speaker AS me FROM t WHERE speaker <> 'system'),
s AS (
  SELECT b.*, p.me, b.speaker = p.me AS mine, b.body || '<|im_end|>' || chr(10) AS tail,
         '<|im_start|>' || CASE WHEN b.speaker = p.me THEN 'assistant' WHEN b.speaker = 'system' THEN 'system'
                                ELSE 'user name=' || b.speaker END || chr(10) AS head
  FROM b JOIN p ON b.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, coalesce(sum(length(head) + length(tail)) OVER (PARTITION BY conv_id, me, block, part ORDER BY turn NULLS FIRST, speaker, body
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM s)
SELECT conv_id, me AS speaker, block, CAST(part AS BIGINT) AS part, count(*) AS n_turns, count(*) FILTER (WHERE mine) AS n_targets,
       string_agg(head || tail, '' ORDER BY turn NULLS FIRST, speaker, body) AS text,
       coalesce(string_agg(CAST(pos + length(head) AS BIGINT) || '-' || CAST(pos + length(head) + length(tail) - 1 AS BIGINT), ','
                ORDER BY turn NULLS FIRST, speaker, body) FILTER (WHERE mine), '') AS target_spans
FROM o GROUP BY conv_id, me, block, part
"""


OP9_SQL = r"""
WITH g(t, label, base, total, t_words, tpos, a, b, c) AS (VALUES
{rows}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT r, unnest(range(len(w) - 2)) AS pos, w FROM d WHERE len(w) >= 3),
hits AS (SELECT x.r, x.pos, g.* FROM x JOIN g ON x.w[pos + 1] = g.a AND x.w[pos + 2] = g.b AND x.w[pos + 3] = g.c),
votes AS (SELECT r, t, label, base, total, t_words, pos - tpos AS diag, count(*) AS votes, min(pos) AS lo, max(pos) AS hi FROM hits GROUP BY ALL),
near AS (SELECT *, CASE WHEN NOT base AND diag - lag(diag) OVER (PARTITION BY r, t ORDER BY diag) <= 2 THEN 0 ELSE 1 END AS fresh FROM votes),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY r, t ORDER BY diag) AS span FROM near),
spans AS (SELECT r, t, label, base, total, t_words, span, sum(votes) AS votes, min(lo) AS lo, max(hi) AS hi FROM runs GROUP BY ALL),
judged AS (SELECT *, base AND votes = total AS place,
                  CASE WHEN hi - lo + 3 > t_words * 1.5e0 THEN 0e0 ELSE least(1e0, CAST(votes AS DOUBLE) / total) END AS cover FROM spans)
SELECT d.doc_id, CAST(len(any_value(d.w)) AS BIGINT) AS n_words, CAST(count(*) FILTER (WHERE place) AS BIGINT) AS n_base,
       CAST(min(lo) FILTER (WHERE place) AS BIGINT) AS first_word, CAST(max(lo) FILTER (WHERE place) AS BIGINT) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE place), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE place OR (NOT base AND cover >= 0.7e0)), '') AS labels,
       round(coalesce(max(cover), 0e0), 6) AS score
FROM d LEFT JOIN judged USING (r) GROUP BY d.r, d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    rows = ",\n".join(str(r) for r in license.template_rows())
    return {"op2_exact_dedup": OP2_SQL, "op5_warc": OP5_SQL, "op9_license_scan": OP9_SQL.replace("{rows}", rows), "op10_chat_rotation": OP10_SQL}
