"""Queries of the text problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import dedup, fusion, packing, scans, subject, tokenizer
from tessella.session import load, stage


def _upserts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "kg_entities").where("op = 'upsert'").select("rec_id", "label", "type")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return dedup.find_copies(_upserts(spark, d), "rec_id", "label", "type")


def p1_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return dedup.collapse(_upserts(spark, d), "rec_id", "label", "type").select("keep_id", F.col("n_copies").cast("long").alias("n_copies"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return fusion.latest(load(spark, d, "kg_entities"))


def p3_fused(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse(load(spark, d, "kg_entities"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.find_noise(load(spark, d, "doc_segments"))


def p6_text(spark: SparkSession, d: str) -> DataFrame:
    return scans.repair(load(spark, d, "doc_segments"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode(load(spark, d, "documents"), path=tokenizer.VOCABULARY)


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(load(spark, d, "documents"), load(spark, d, "pack_capacities"), tokenizer.VOCABULARY)


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    capacities = load(spark, d, "pack_capacities")
    return packing.fill_report(packing.pack_texts(load(spark, d, "documents"), capacities, tokenizer.VOCABULARY), capacities)


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    capacities, sizes = load(spark, d, "pack_capacities"), tokenizer.sizes(load(spark, d, "documents"), path=tokenizer.VOCABULARY)
    sizes = stage(sizes, "token-sizes")
    return packing.packing_checks(stage(packing.pack(sizes, capacities), "packed"), sizes, capacities)


def p3_items(spark: SparkSession, d: str) -> DataFrame:
    """The groups and fields that are fused and how many different values each has."""
    return fusion.fuse(load(spark, d, "kg_entities")).select("keep_id", "field", F.col("n_values").cast("long").alias("n_values"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return subject.find_areas(load(spark, d, "documents"), load(spark, d, "subject_examples"))


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    return subject.composition(load(spark, d, "documents"), load(spark, d, "subject_examples"), load(spark, d, "subject_areas"))


def p10_leaves(spark: SparkSession, d: str) -> DataFrame:
    return subject.leaf_report(load(spark, d, "documents"), load(spark, d, "subject_examples"))


QUERIES = {f.__name__: f for f in (p1_found, p1_collapsed, p3_found, p3_fused, p3_items, p6_found, p6_text, p8_ids, p9_packed, p9_fill, p9_checks, p10_found, p10_composition, p10_leaves)}

_FOLDED = """folded AS (SELECT rec_id, regexp_replace(lower(label), '[^\\p{L}\\p{Nd}]', '', 'g') AS a, regexp_replace(lower(type), '[^\\p{L}\\p{Nd}]', '', 'g') AS b
  FROM kg_entities WHERE op = 'upsert' AND label IS NOT NULL AND type IS NOT NULL),
grouped AS (SELECT rec_id, min(rec_id) OVER (PARTITION BY least(a, b), greatest(a, b)) AS keep_id FROM folded WHERE a <> '' AND b <> '')"""

_ABSENT = ", ".join(f"'{x}'" for x in fusion.NO_VALUE)
_PLAIN = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_COUNTS = f"({_PLAIN} <> '' AND {_PLAIN} NOT IN ({_ABSENT}))"

_LATEST = f"""base AS (
  SELECT doc_id, id, rec_id, label, CASE WHEN json_valid(properties) THEN CASE WHEN json_type(properties) = 'OBJECT' THEN properties END END AS props,
    trim(provenance['extraction_timestamp']) AS t, min(rec_id) OVER g AS keep_id, count(*) OVER g AS n
  FROM kg_entities WHERE op = 'upsert' AND id IS NOT NULL WINDOW g AS (PARTITION BY doc_id, id)),
timed AS (
  SELECT *, CASE WHEN regexp_full_match(t, '\\d{{9,11}}') THEN try_cast(t AS BIGINT) * 1000000
    WHEN regexp_full_match(t, '\\d{{12,14}}') THEN try_cast(t AS BIGINT) * 1000
    WHEN regexp_full_match(t, '\\d{{1,2}} [A-Za-z]{{3}} \\d{{4}} .*') THEN epoch_us(try_strptime(t, '%d %b %Y %H:%M:%S'))
    WHEN regexp_matches(t, '([Zz]|[+-]\\d{{2}}:\\d{{2}})$') AND contains(t, ':') THEN epoch_us(try_cast(replace(t, '/', '-') AS TIMESTAMPTZ))
    ELSE epoch_us(try_cast(replace(t, '/', '-') AS TIMESTAMP)) END AS ts
  FROM base WHERE n >= 2),
fields AS (
  SELECT keep_id, rec_id, ts, 'label' AS field, label AS value FROM timed WHERE {_COUNTS.format("label")}
  UNION ALL
  SELECT keep_id, rec_id, ts, field, CAST(v AS VARCHAR) FROM (SELECT keep_id, rec_id, ts, k AS field, json_extract(props, '$."' || k || '"') AS v
    FROM (SELECT *, unnest(json_keys(props)) AS k FROM timed WHERE props IS NOT NULL))
  WHERE CASE json_type(v) WHEN 'NULL' THEN false WHEN 'OBJECT' THEN true
    WHEN 'ARRAY' THEN len(list_filter(CAST(v AS VARCHAR[]), lambda x: coalesce({_COUNTS.format("x")}, false))) > 0
    ELSE {_COUNTS.format("(v ->> '$')")} END)"""

ORACLE = {
    "p1_found": f"WITH {_FOLDED} SELECT keep_id, rec_id AS copy_id FROM grouped WHERE rec_id <> keep_id",
    "p1_collapsed": f"WITH {_FOLDED} SELECT keep_id, count(*) AS n_copies FROM grouped GROUP BY keep_id",
    "p3_found": f"WITH {_LATEST} SELECT keep_id, field, arg_min(rec_id, (-coalesce(ts, -500000000000000000), rec_id)) AS rec_id FROM fields GROUP BY keep_id, field",
    "p3_items": f"WITH {_LATEST} SELECT keep_id, field, count(DISTINCT value) AS n_values FROM fields GROUP BY keep_id, field",
    # what holds of any packing: every text placed once, nothing lost, overfull, doubly taken or split for nothing
    "p9_checks": "SELECT capacity_id, (SELECT count(*) FROM documents) AS n_texts, 0::BIGINT AS lost_tokens, 0::BIGINT AS overfull, 0::BIGINT AS same_place, 0::BIGINT AS split_short, true AS tight FROM pack_capacities",
}
