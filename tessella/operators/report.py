"""The aggregations behind the validation report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.values import blank, percent
from tessella.operators import cascade, gate, rules
from tessella.operators.cascade import Validated
from tessella.session import merged
from tessella.vocab import ENTITY_TYPES


def type_distribution(ents: DataFrame, survivors: DataFrame) -> DataFrame:
    """Entities per type before and after with a TOTAL row; types without entities stay, unknown types do not count."""
    tag = lambda df, s: df.where(F.col("type").isin(ENTITY_TYPES)).select("type", F.lit(s).alias("stage"))
    dim = ents.sparkSession.createDataFrame([(t,) for t in ENTITY_TYPES], "type string").select("type", F.lit("none").alias("stage"))
    rows = tag(ents, "before").unionByName(tag(survivors, "after")).unionByName(dim)
    g = rows.rollup("type").agg(F.count_if(F.col("stage") == "before").alias("n_before"), F.count_if(F.col("stage") == "after").alias("n_after"))
    return g.select(F.coalesce("type", F.lit("TOTAL")).alias("type"), "n_before", "n_after", F.round(percent(F.col("n_after"), F.col("n_before")), 1).alias("retention"))


def predicate_distribution(ends: DataFrame) -> DataFrame:
    """Relationships per predicate before and after with a TOTAL row; a missing one counts as 'Unknown'.
    ``ends`` are all relationships, the surviving ones marked ``alive``."""
    both = ends.groupBy(F.coalesce("predicate", F.lit("Unknown")).alias("predicate")).agg(F.count(F.lit(1)).alias("n_before"), F.count_if("alive").alias("n_after"))
    g = both.rollup("predicate").agg(F.sum("n_before").alias("n_before"), F.sum("n_after").alias("n_after"), F.grouping("predicate").alias("total"))
    return g.select(F.when(F.col("total") == 1, "TOTAL").otherwise(F.col("predicate")).alias("predicate"), F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"), F.round(percent(F.col("n_after"), F.col("n_before")), 1).alias("retention"))


def type_counts(ents: DataFrame) -> DataFrame:
    """Entities of each document by type, spread over the closed set of types."""
    return ents.groupBy("doc_id").agg(*[F.count_if(F.col("type") == t).alias(t.lower()) for t in ENTITY_TYPES], F.count_if(~F.coalesce(F.col("type"), F.lit("")).isin(ENTITY_TYPES)).alias("other"))


def predicate_counts(rels: DataFrame) -> DataFrame:
    """Relationships of each document by predicate; a missing one counts as 'Unknown'."""
    return rels.groupBy("doc_id", F.coalesce("predicate", F.lit("Unknown")).alias("predicate")).agg(F.count(F.lit(1)).alias("n"))


def rule_matrix(rule_results: DataFrame) -> DataFrame:
    """One row per document, one cell per rule: PASS, FAIL (n) or N/A."""
    cell = F.when(F.col("passed"), "PASS").otherwise(F.format_string("FAIL (%d)", "violation_count"))
    rules = ["VR001", "VR002", "VR003", "VR004", "VR005", "VR006"]
    p = rule_results.withColumn("cell", cell).groupBy("doc_id").pivot("rule_id", rules).agg(F.first("cell"))
    return p.select("doc_id", *[F.coalesce(r, F.lit("N/A")).alias(r.lower()) for r in rules])


def provenance_coverage(ents: DataFrame) -> DataFrame:
    """Share of a document's entities with a segment and with a time, in percent."""
    pct = lambda k: F.round(percent(F.count_if(~blank(F.col("provenance")[k])), F.count(F.lit(1))), 1)
    return ents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_entities"), pct("segment_id").alias("with_provenance"), pct("extraction_timestamp").alias("with_timestamp"))


def metadata_totals(meta: DataFrame) -> DataFrame:
    """Pages and segments of each document: repeated rows count once, missing totals as 0."""
    return meta.groupBy(F.col("document_name").alias("doc_id")).agg(F.coalesce(F.max("total_pages"), F.lit(0)).alias("total_pages"), F.coalesce(F.max("total_segments"), F.lit(0)).alias("total_segments"))


def documents(v: Validated, meta: DataFrame, rule_results: DataFrame) -> DataFrame:
    """One row per document: sizes and quality; no surviving entity means schema and retention 0, accuracy stays."""
    metrics = v.ids.groupBy("doc_id").agg(F.sum("metrics").alias("n_metrics"))
    t = cascade.retention(v)
    for right in (metrics, rules.compliance(rule_results).select("doc_id", "compliance"), gate.accuracy(v.ids).select("doc_id", "accuracy", "cost_usd"), metadata_totals(meta)):
        t = t.join(merged(right), "doc_id", "left")
    alive = F.col("entities_after") > 0
    return t.select(
        "doc_id", F.coalesce("total_pages", F.lit(0)).alias("total_pages"), F.coalesce("total_segments", F.lit(0)).alias("total_segments"), "entities_before", "entities_after", "n_metrics", "rels_before", "rels_after",
        F.when(alive, F.coalesce("compliance", F.lit(0.0))).otherwise(0.0).alias("compliance"), F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"), F.when(alive, F.col("rel_retention")).otherwise(0.0).alias("rel_retention"), "cost_usd",
    )


def grand_totals(docs: DataFrame) -> DataFrame:
    return docs.agg(
        F.count(F.lit(1)).alias("documents"), F.sum("total_pages").cast("long").alias("pages"), F.sum("total_segments").cast("long").alias("segments"), F.sum("entities_before").alias("entities"), F.sum("entities_after").alias("validated"),
        F.sum("n_metrics").alias("metrics"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"), F.round(F.avg("cost_usd"), 6).alias("mean_cost_usd"),
    )


def examples(v: Validated) -> DataFrame:
    """Whole percentages cut, not rounded, as the report's examples print them."""
    g = v.ids.groupBy("doc_id").agg(F.sum("n").alias("n"), F.count_if("alive").alias("kept"))
    return g.select("doc_id", F.floor(percent(F.col("kept"), F.col("n"))).alias("percent_kept"))


def summary(v: Validated) -> DataFrame:
    """Stage by stage per document: entities and relationships extracted, past the gate, and validated."""
    e = v.ids.groupBy("doc_id").agg(F.sum("n").alias("extracted"), F.coalesce(F.sum(F.when(~F.col("bad"), F.col("n"))), F.lit(0)).alias("gated"), F.count_if("alive").alias("validated"))
    r = v.ends.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rels_extracted"), F.count_if(~F.col("bad")).alias("rels_gated"), F.count_if("alive").alias("rels_validated"))
    return e.join(merged(r), "doc_id", "left").na.fill(0)
