"""The queries of this subpackage, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, embedding_dedup, language_id, license_scan, lm_score, quality_classifier, quality_rules, simhash_dedup, source_mix, url_filter
from tidemark.llm.common import fold


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link(_read(spark, sf_dir, "embeddings"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    model = language_id.train(docs, ~held_out)
    return language_id.identify(docs, model, [F.col("doc_id"), held_out.alias("held_out")])


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = fold("doc_id", 7) == 2
    return lm_score.score(docs, ~held_out, [F.col("doc_id"), held_out.alias("held_out")])


#: Host, path and verdict of the rules that pages are judged by.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages"), url_filter.rules_table(spark, URL_RULES))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(_read(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = fold("doc_id", 3) == 1
    model = quality_classifier.train(docs, _read(spark, sf_dir, "labels"), ~held_out)
    return quality_classifier.score(docs, model, [F.col("doc_id"), held_out.alias("held_out")])


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality_rules.train(docs, _read(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, model, [F.col("doc_id")])


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.deduplicate(_read(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return license_scan.scan(docs, license_scan.train(docs), [F.col("doc_id")])


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _read(spark, sf_dir, "documents")
    return byte_bpe.encode(docs, [F.col("doc_id")], public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_embedding_dedup, op2_language_id, op3_lm_score, op4_url_filter, op5_source_mix, op6_quality_classifier, op7_quality_rules, op8_simhash_dedup, op9_license_scan, op10_byte_bpe)} | {"pipeline": pipeline}


_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

OP4_SQL = f"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
u AS (
  SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
r(h, p, v) AS (VALUES {_RULES}),
m AS (
  SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h) + length(p) DESC, length(h) DESC, v DESC) AS k
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (page_id)"""


def _part(what: str) -> str:
    return f"('0x' || substr(md5('42/' || {what}), 1, 12))::BIGINT / 281474976710656.0"


#: An id's or a source's text in a hash; null has a text of its own.
_ID = "coalesce(doc_id::VARCHAR, chr(0))"

#: Blocks go to sources, and to shards of a source, by ranking every quotient that a row could need: as many as there are blocks.
OP5_SQL = f"""
WITH d AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s),
x AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
y AS (SELECT *, max(CASE WHEN w * level < cap THEN level END) OVER () AS rest FROM x),
t AS (SELECT source, source_size, CASE WHEN w * level >= cap OR rest IS NULL THEN cap ELSE w * rest END AS target FROM y),
g AS (SELECT *, round(sum(target) OVER () / 8)::BIGINT AS seats, greatest(1, ceil(source_size / 262144))::BIGINT AS shards FROM t),
gq AS (SELECT source, seats, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source NULLS LAST) AS r FROM g, unnest(range(0, seats)) AS z(k) WHERE target > 0),
gs AS (SELECT source, count(*) AS blocks FROM gq WHERE r <= seats GROUP BY 1),
e AS (
  SELECT doc_id, size, text, g.*, coalesce(blocks, 0) AS blocks, floor({_part(f"'shard/' || {_ID}")} * shards)::BIGINT AS shard
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN gs ON gs.source IS NOT DISTINCT FROM g.source),
h AS (SELECT source, shard, blocks, sum(size) AS words FROM e GROUP BY ALL),
hq AS (SELECT source, shard, blocks, row_number() OVER (PARTITION BY source ORDER BY words / (2 * k + 1) DESC, shard) AS r FROM h, unnest(range(0, blocks)) AS z(k) WHERE words > 0),
hs AS (SELECT source, shard, count(*) AS quota FROM hq WHERE r <= blocks GROUP BY ALL),
o AS (
  SELECT e.*, words, 8 * coalesce(quota, 0) AS goal,
    sum(size) OVER (PARTITION BY e.source, e.shard ORDER BY {_part(f"'order/' || {_ID}")}, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop
  FROM e JOIN h ON h.source IS NOT DISTINCT FROM e.source AND h.shard = e.shard LEFT JOIN hs ON hs.source IS NOT DISTINCT FROM e.source AND hs.shard = e.shard),
v AS (SELECT *, stop - size AS start, least(goal, words) AS once, least(greatest(0, goal - words), words) AS again FROM o)
SELECT doc_id, size, source_size, target, (least(stop, once) - least(start, once) + least(stop, again) - least(start, again))::BIGINT AS taken FROM v"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that SQL can express; the others are tested against brute force."""
    return {"op4_url_filter": OP4_SQL, "op5_source_mix": OP5_SQL}
