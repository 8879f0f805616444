"""The queries of this subpackage: each operator over its whole table, with its SQL if any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopwright.llm.common import table
from loopwright.session import new_shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return register


# Shards of the resharding query: one old shard for each hash of a source, so a hot source is
# a shard of a third of all bytes; 40 new ones of equal capacity.
OLD_SHARDS, NEW_SHARDS, ROW_OVERHEAD = 20, 40, 16


@query("op2_min_cost_resharding")
def resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents written as old shards, moved, and read from the files of the new ones."""
    from loopwright.llm.sharding import reshard

    text = F.coalesce("text", F.lit(""))
    old = F.pmod(F.crc32(F.coalesce("source", F.lit(""))), F.lit(OLD_SHARDS))
    found = reshard(
        table(spark, sf_dir, "documents"), old, F.octet_length(text) + ROW_OVERHEAD,
        new_shared_path(spark, "shards"), NEW_SHARDS,
    )
    return found.select(
        "doc_id",
        "size",
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "old_shard",
        "moved",
    )


@query("op3_cost_balanced_packing")
def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loopwright.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


@query("op5_adaptive_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loopwright.llm.quality_rules import judge_counted, with_counts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    counted = with_counts(docs, "counts", keep_text=False)
    judged = judge_counted(counted, "counts")
    return judged.select("doc_id", "counts.*")


@query("op6_bayesian_near_dedup")
def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loopwright.llm.near_dedup import find_groups

    return find_groups(table(spark, sf_dir, "documents")).drop("text_key")


@query("op7_sentence_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loopwright.llm.toxicity import train_and_score

    return train_and_score(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


@query("op10_personal_data_crf")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loopwright.llm.pii import find_personal_data

    return find_personal_data(table(spark, sf_dir, "documents"))


@query("op1_seed_align_decontamination")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loopwright.llm.decontamination import find_leaks

    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.drop("text_key")


@query("op8_importance_resampling")
def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loopwright.llm.quality_classifier import resample

    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return resample(table(spark, sf_dir, "documents"), good)


# Captures made of ``pages``: each page is a full response, and a revisit follows it later; every
# fifth revisit names another version, every seventh sends no entity tag.
REVISIT_SQL = """
WITH parts AS (
  SELECT page_id, url, octet_length(encode(html)) AS bytes, md5(html) AS tag,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''),
                        '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS rest
  FROM pages),
split AS (
  SELECT page_id, bytes, tag,
         regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)),
                                       ':(80|443)$', ''), '^www[.]', '')
         || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS place,
         array_to_string(list_sort(list_filter(
           string_split(regexp_extract(rest, '[?](.*)$', 1), '&'),
           lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))),
           '&') AS query
  FROM parts),
named AS (
  SELECT page_id, bytes, tag, place || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS page
  FROM split),
responses AS (
  SELECT page_id * 2 AS record_id, page, page_id * 60 AS ts, bytes, tag, page_id FROM named),
revisits AS (
  SELECT page_id * 2 + 1 AS record_id, page, page_id * 60 + 30 + (page_id % 11) * 600 AS ts,
         CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 5 = 0 THEN md5(tag) ELSE tag END AS tag,
         page_id
  FROM named),
ranked AS (
  SELECT v.record_id, v.page, v.ts, v.tag, v.page_id, r.record_id AS response_id,
         r.ts AS response_ts, r.tag AS full_tag, r.bytes, r.page_id AS full_page,
         row_number() OVER (PARTITION BY v.record_id ORDER BY r.ts DESC, r.record_id DESC) AS place
  FROM revisits v LEFT JOIN responses r ON r.page = v.page AND r.ts < v.ts),
judged AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'no_response' WHEN tag IS NULL THEN 'unverified'
                 WHEN tag = full_tag THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM ranked WHERE place = 1)
SELECT record_id, page AS canonical_url, ts, response_id, response_ts, outcome,
       CASE WHEN outcome IN ('resolved', 'unverified') THEN
         'cache-control: max-age=' || (page_id % 100) || '; content-length: ' || bytes
         || '; content-type: text/html; date: ' || ts || '; etag: "'
         || coalesce(tag, full_tag) || '"; last-modified: ' || (full_page * 60) END AS headers
FROM judged
"""


@query("op9_revisit_resolution", REVISIT_SQL)
def revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loopwright.llm.warc import resolve_revisits

    page, text = F.col("page_id"), lambda c: c.cast("string")
    tag = F.md5(F.encode("html", "UTF-8"))
    pages = table(spark, sf_dir, "pages").select(
        "page_id", "url", F.octet_length("html").alias("bytes"), tag.alias("tag")
    )
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    full = pages.select(
        (page * 2).alias("record_id"),
        "url",
        (page * 60).alias("ts"),
        F.lit("response").alias("kind"),
        F.create_map(
            F.lit("content-type"), F.lit("text/html"),
            F.lit("content-length"), text(F.col("bytes")),
            F.lit("etag"), quoted(F.col("tag")),
            F.lit("last-modified"), text(page * 60),
        ).alias("headers"),
    )
    at = page * 60 + 30 + page % 11 * 600
    again = pages.select(
        (page * 2 + 1).alias("record_id"),
        "url",
        at.alias("ts"),
        F.lit("revisit").alias("kind"),
        F.create_map(
            F.lit("cache-control"), F.concat(F.lit("max-age="), text(page % 100)),
            F.lit("content-length"), F.lit("0"),
            F.lit("date"), text(at),
            F.lit("etag"),
            F.when(page % 7 == 0, F.lit(None)).otherwise(
                quoted(F.when(page % 5 == 0, F.md5("tag")).otherwise(F.col("tag")))
            ),
        ).alias("headers"),
    )
    found = resolve_revisits(full.union(again))
    lines = F.transform(
        F.array_sort(F.map_entries("headers")), lambda e: F.concat(e.key, F.lit(": "), e.value)
    )
    return found.withColumn("headers", F.array_join(lines, "; "))


@query("op4_masked_pseudo_likelihood")
def masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loopwright.llm.lm_scoring import train_and_score

    return train_and_score(table(spark, sf_dir, "documents"))


@query("op11_diagonal_token_alignment")
def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loopwright.llm.token_alignment import align_tokenizers

    return align_tokenizers(table(spark, sf_dir, "documents"))


HARD_NEGATIVES_SQL = """
WITH q AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same,
         CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM q a JOIN q r ON a.vec_id % 50 = 0 AND r.vec_id <> a.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score
  FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id
                               ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""


@query("op12_residue_hard_negatives", HARD_NEGATIVES_SQL)
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loopwright.llm.hard_negatives import mine_hard_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return mine_hard_negatives(vectors, F.col("vec_id") % 50 == 0)


@query("op13_containment_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loopwright.llm.license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents")).drop("found")
