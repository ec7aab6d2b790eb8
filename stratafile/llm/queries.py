"""The ``opN_`` queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, covertree, neardup, packing, pii, quality_gam, quality_rules, sharding, urlrules, warc

BYTE_BPE = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cover_tree_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_pairwise_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))


#: host, path, verdict
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op3_url_rule_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"), urlrules.rule_table(spark, URL_RULES))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packing.pack(docs, public_tokenizers.path(BYTE_BPE))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_ngram_ratio_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    found = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), trusted)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path(BYTE_BPE)
    both = bpe.decode(bpe.encode(docs, path), path)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op7_odd_sketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(table(spark, sf_dir, "pages"))
    ends = warc.read(archives, with_chunks=False).where("is_last")
    return ends.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_weighted_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find(table(spark, sf_dir, "documents")))


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the quality rules that SQL can say: base counts of whole texts."""
    rows = quality_rules.with_words(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return quality_rules.base_counts(rows).select("doc_id", *quality_rules.COUNTS)


def pii_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the personal data that SQL can say: how many base spans of each kind a whole text has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spans = docs.select("doc_id", pii.base_spans(F.col("text")).alias("base"))
    return spans.select("doc_id", *pii.base_numbers("base"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (quality_base_counts, pii_base_counts, op1_cover_tree_near_dedup, op2_pairwise_gam_quality, op3_url_rule_sweep, op4_best_fit_packing, op5_ngram_ratio_rules, op6_bpe_round_trip, op7_odd_sketch_near_dedup, op8_warc_round_trip, op9_weighted_tree_sharding, op10_bootstrapped_pii)}


def oracle_sql() -> dict[str, str]:
    return {
        "quality_base_counts": r"""
            WITH w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
            g AS (SELECT doc_id, i, array_to_string(words[i:i+4], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1))) AS i FROM w)),
            again AS (SELECT doc_id, win FROM g GROUP BY doc_id, win HAVING count(*) > 1),
            c AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT g.doc_id, unnest(range(g.i, g.i + 5)) AS p FROM g JOIN again USING (doc_id, win)) GROUP BY doc_id),
            f AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
              list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(c.n, 0) AS n_repeat_words FROM w LEFT JOIN c USING (doc_id))
            SELECT doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f""",
        "pii_base_counts": r"""
            WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
            m AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS email, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip,
              list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS card, list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phone FROM t)
            SELECT doc_id, len(email)::BIGINT AS n_email,
              len(list_filter(ip, lambda x: NOT list_contains(list_transform(string_split(x, '.'), lambda p: coalesce(TRY_CAST(p AS BIGINT) <= 255, false)), false)))::BIGINT AS n_ip,
              len(list_filter(card, lambda d: length(d) BETWEEN 14 AND 19 AND list_sum(list_transform(range(0, length(d)), lambda k: CASE WHEN k % 2 = 0 THEN CAST(substr(d, length(d) - k, 1) AS INT)
                WHEN CAST(substr(d, length(d) - k, 1) AS INT) > 4 THEN 2 * CAST(substr(d, length(d) - k, 1) AS INT) - 9 ELSE 2 * CAST(substr(d, length(d) - k, 1) AS INT) END)) % 10 = 0))::BIGINT AS n_card,
              len(list_filter(phone, lambda d: length(d) BETWEEN 10 AND 15))::BIGINT AS n_phone FROM m""",
        "op1_cover_tree_near_dedup": """
            WITH RECURSIVE v AS (
              SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
              WHERE label IS NOT NULL AND embedding IS NOT NULL),
            u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE sqrt(list_dot_product(e, e)) > 0),
            l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
              WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
            r AS (SELECT x AS a, y AS b FROM l UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x)
            SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.x = e.vec_id)::BIGINT AS n_links,
              least(e.vec_id, coalesce((SELECT min(b) FROM r WHERE r.a = e.vec_id), e.vec_id)) AS component_id,
              e.vec_id = least(e.vec_id, coalesce((SELECT min(b) FROM r WHERE r.a = e.vec_id), e.vec_id)) AS kept
            FROM embeddings e""",
        "op3_url_rule_sweep": f"""
            WITH rules(host, path, said) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
            cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
            parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{urlrules.UPPER}', '{urlrules.LOWER}') AS host,
              regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
            pairs AS (SELECT DISTINCT host, path FROM parts),
            fits AS (SELECT p.host, p.path, r.host || r.path AS rule, r.said,
              row_number() OVER (PARTITION BY p.host, p.path ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
              FROM pairs p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
            SELECT a.page_id, a.host, a.path, f.rule, coalesce(f.said, 'allow') AS verdict
            FROM parts a LEFT JOIN (SELECT * FROM fits WHERE k = 1) f ON a.host = f.host AND a.path = f.path""",
        "op7_odd_sketch_near_dedup": r"""
            WITH RECURSIVE w AS (
              SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
            g AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(words) - 3, 2)), lambda i: array_to_string(words[i:i+4], ' '))) AS grams FROM w WHERE len(words) > 0),
            n AS (SELECT doc_id, len(grams)::BIGINT AS n FROM g),
            e AS (SELECT doc_id, unnest(grams) AS gram FROM g),
            l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id <> b.doc_id
              JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
              GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(p.n) + any_value(q.n) - count(*))),
            r AS (SELECT x AS a, y AS b FROM l UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x),
            m AS (SELECT a, min(b) AS least FROM r GROUP BY a)
            SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id,
              d.doc_id = least(d.doc_id, coalesce(m.least, d.doc_id)) AS kept
            FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id""",
        "op8_warc_round_trip": """
            WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
            f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
            SELECT p.page_id, p.payload_bytes::BIGINT AS payload_bytes, p.payload_digest,
              CASE WHEN f.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
              CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
            FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100""",
    }
