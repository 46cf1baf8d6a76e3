"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, conversation_repair, importance, language, main_text, mixing, multiset_hash, ngram_join, pieces, pii, suffix_dedup, toxicity, url_cascade
from .common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.reported(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"))


def op5_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predictions(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(table(spark, sf_dir, "documents")).drop("key")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.edits(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_cascade.judge(table(spark, sf_dir, "pages"))


def op11_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.report(table(spark, sf_dir, "conversations"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.report(table(spark, sf_dir, "pages"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_personal_data, op3_toxicity, op4_sentencepiece, op5_nearest_vectors, op6_language, op7_suffix_dedup, op8_ngram_join, op9_fingerprints,
        op10_url_filter, op11_repair_conversations, op12_main_text, op13_importance_resampling,
    )
}

#: The table of CRC-32 as a list, for the SQL.
CRC = """
        crc_table AS (
            SELECT list(c ORDER BY b) AS t
            FROM (
                SELECT b, list_reduce(list_concat([b], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(b)
            )
        )"""

ORACLES = {
    "op10_url_filter": """
        WITH cut AS (
            SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
        ), part AS (
            SELECT page_id,
                   coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
            FROM cut
        ), rules(rule, host_part, path_part, verdict) AS (
            VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
                   ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'),
                   ('com/de/', 'com', '/de/', 'block')
        ), fit AS (
            SELECT page_id, host, path, rule, verdict,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST, length(host_part) DESC) AS place
            FROM part LEFT JOIN rules
              ON (host = host_part OR host LIKE '%.' || host_part) AND starts_with(path, path_part)
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit WHERE place = 1
    """,
    "op11_repair_conversations": r"""
        WITH RECURSIVE""" + CRC + r""", given AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS x
            FROM conversations
        ), marked AS (
            SELECT conv_id, turn, role, text,
                   xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(x), 2), lambda i: (instr('0123456789ABCDEF', x[i]) - 1) * 16 + instr('0123456789ABCDEF', x[i + 1]) - 1)),
                                   lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS k
            FROM given, crc_table
        ), hurt AS (
            SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
                   CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy
            FROM marked WHERE k <> 0
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM hurt
        ), judged AS (
            SELECT *, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair,
                   CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
            FROM placed
        ), measured AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                   count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
            FROM judged GROUP BY conv_id
        ), moves(a, role, b) AS (
            VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
        ), added(a, b, cost, audit, txt) AS (
            VALUES (0, 0, 0, '', ''), (0, 2, 3, 'I', 'user:' || chr(10)), (0, 3, 6, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 1, 0, '', ''), (1, 2, 3, 'I', 'user:' || chr(10)),
                   (1, 3, 6, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (2, 2, 0, '', ''), (2, 3, 3, 'I', 'assistant:' || chr(10)), (3, 3, 0, '', ''), (3, 2, 3, 'I', 'user:' || chr(10))
        ), ways AS (
            SELECT conv_id, i, a, a AS b, 4 AS cost, 'D' AS audit, '' AS txt FROM judged, range(4) s(a)
            UNION ALL
            SELECT conv_id, i, a, b, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END, 'K', judged.role || ':' || text || chr(10)
            FROM judged JOIN moves ON judged.role[1] = moves.role WHERE fault NOT IN ('blank', 'duplicate')
            UNION ALL
            SELECT conv_id, i, a, b, CASE WHEN fault = 'truncated' THEN 6 ELSE 3 END, 'R', CASE moves.role WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text || chr(10)
            FROM judged JOIN moves ON moves.role <> 's' WHERE fault NOT IN ('blank', 'duplicate')
        ), paths AS (
            SELECT conv_id, 0::BIGINT AS i, {'cost': 0, 'audit': '', 'txt': '', 'at': 0} AS best FROM measured
            UNION ALL
            SELECT p.conv_id, p.i + 1, min({'cost': p.best.cost + x.cost + w.cost, 'audit': p.best.audit || x.audit || w.audit, 'txt': p.best.txt || x.txt || w.txt, 'at': w.b})
            FROM paths p JOIN added x ON x.a = p.best.at JOIN ways w ON w.conv_id IS NOT DISTINCT FROM p.conv_id AND w.i = p.i + 1 AND w.a = x.b
            GROUP BY p.conv_id, p.i, w.b
        ), ended AS (
            SELECT p.conv_id, min({'cost': p.best.cost + x.cost, 'audit': p.best.audit || x.audit, 'txt': p.best.txt || x.txt}) AS best
            FROM paths p JOIN measured m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.n = p.i JOIN added x ON x.a = p.best.at AND x.b IN (0, 3)
            GROUP BY p.conv_id
        )
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(best.txt[:-2], '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN measured m ON m.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
    """,
    "op13_importance_resampling": r"""
        WITH""" + CRC + r""", said AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, 0 AS wanted FROM documents
            UNION ALL
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), 1 FROM benchmark
        ), runs AS (
            SELECT doc_id, wanted, unnest(list_concat(w,
                list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]),
                list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f
            FROM said
        ), counted AS (
            SELECT doc_id, wanted, f, count(*) AS n FROM runs GROUP BY ALL
        ), spelt AS (
            SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM counted)
        ), placed AS (
            SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(x), 2), lambda i: (instr('0123456789ABCDEF', x[i]) - 1) * 16 + instr('0123456789ABCDEF', x[i + 1]) - 1)),
                                  lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket
            FROM spelt, crc_table
        ), bucketed AS (
            SELECT doc_id, wanted, bucket, sum(n)::BIGINT AS n FROM counted JOIN placed USING (f) GROUP BY ALL
        ), whole AS (
            SELECT coalesce(sum(n) FILTER (wanted = 0), 0)::BIGINT AS s, coalesce(sum(n) FILTER (wanted = 1), 0)::BIGINT AS t FROM bucketed
        ), gain AS (
            SELECT bucket, floor(1000 * ln((tb + 1) * (s + 10000) / ((sb + 1) * (t + 10000))::DOUBLE))::BIGINT AS gain
            FROM (SELECT bucket, coalesce(sum(n) FILTER (wanted = 0), 0)::BIGINT AS sb, coalesce(sum(n) FILTER (wanted = 1), 0)::BIGINT AS tb FROM bucketed GROUP BY bucket), whole
        ), weighed AS (
            SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM bucketed JOIN gain USING (bucket) WHERE wanted = 0 GROUP BY doc_id
        ), scored AS (
            SELECT said.doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || said.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
            FROM said LEFT JOIN weighed ON said.doc_id = weighed.doc_id WHERE wanted = 0
        ), ordered AS (
            SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM ordered
    """,
}
