"""Removal of failed entities and the relationships that hang on them; quality metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.values import percent
from tessella.operators import gate as G
from tessella.operators import rules as R
from tessella.session import hot_join, merged, stage


@dataclass
class Validated:
    """The result of gate and cascade: judged rows, what is known of each id, and every relationship with
    the state of its ends (``bad``: an end is mismatched; ``alive``: both ends survive)."""

    gate: DataFrame
    ids: DataFrame
    ends: DataFrame

    @property
    def gated(self) -> DataFrame:
        """Entities whose id is not mismatched anywhere in the document; rows without an id stay."""
        bad = self.ids.where("bad").select("doc_id", F.col("key").alias("_key"), F.lit(True).alias("_bad"))
        rows = self.gate.withColumn("_key", R.key_of("id"))
        return hot_join(rows, bad, ["doc_id", "_key"], "left", spread=F.col("rec_id"), grows=True).where("_bad is null").drop("_bad", "_key")

    @property
    def gated_ids(self) -> DataFrame:
        return self.ids.where("not bad")

    @property
    def gated_rels(self) -> DataFrame:
        """Relationships of which no end is mismatched; null and dangling ends stay."""
        return self.ends.where("not bad")

    @property
    def entities(self) -> DataFrame:
        """Entities that survive: neither mismatched nor one of several with their id, the first included."""
        return self.gate.join(merged(self.ids.where("alive").select("rec_id")), "rec_id", "left_semi")

    @property
    def rels(self) -> DataFrame:
        """Relationships with both ends among the surviving entities; dangling ends die here."""
        return self.ends.where("alive")


def ends_of(rels: DataFrame, ids: DataFrame) -> DataFrame:
    """Adds ``bad`` and ``alive`` to relationships by the state of their ends, safe for hot nodes."""
    t = rels
    for end in ("subject", "object"):
        state = ids.select("doc_id", F.col("key").alias("_key"), F.col("bad").alias(f"_bad_{end}"), F.col("alive").alias(f"_alive_{end}"))
        t = hot_join(t.withColumn("_key", R.key_of(end)), state, ["doc_id", "_key"], "left", spread=F.col("rel_id"), grows=True).drop("_key")
    no = F.lit(False)
    t = t.withColumn("bad", F.coalesce("_bad_subject", no) | F.coalesce("_bad_object", no)).withColumn("alive", F.coalesce("_alive_subject", no) & F.coalesce("_alive_object", no))
    return t.drop("_bad_subject", "_bad_object", "_alive_subject", "_alive_object")


def validate(ents: DataFrame, rels: DataFrame, judge: G.Judge | None = G.offline_judge) -> Validated:
    """Gate, removal and cascade over all documents at once.

    The rows are judged and reduced to their ids once; that table is written, and everything else reads
    it. Documents that lose every entity simply have no rows left; reports bring them back with zeros."""
    g = G.judged(ents, judge)
    ids = stage(R.per_id(g), "ids")
    return Validated(g, ids, ends_of(rels, ids))


def retention(v: Validated) -> DataFrame:
    """Per document with entities: entities and relationships before and after and the share kept in percent."""
    a = v.ids.groupBy("doc_id").agg(F.sum("n").alias("entities_before"), F.count_if("alive").alias("entities_after"))
    b = v.ends.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rels_before"), F.count_if("alive").alias("rels_after"))
    t = a.join(merged(b), "doc_id", "left").na.fill(0)
    return t.select(
        "doc_id", "entities_before", "entities_after", "rels_before", "rels_after",
        F.round(percent(F.col("entities_after"), F.col("entities_before")), 2).alias("entity_retention"), F.round(percent(F.col("rels_after"), F.col("rels_before")), 2).alias("rel_retention"),
    )


def segment_retention(v: Validated) -> DataFrame:
    """Per document and segment ('unknown' if unnamed): entities before and after."""
    alive = v.ids.where("alive").select("rec_id", F.lit(True).alias("_alive"))
    t = v.gate.select("rec_id", "doc_id", F.coalesce(F.col("provenance")["segment_id"], F.lit("unknown")).alias("segment_id")).join(merged(alive), "rec_id", "left")
    return t.groupBy("doc_id", "segment_id").agg(F.count(F.lit(1)).alias("original"), F.count_if("_alive").alias("validated"))


def mean_segment_retention(segments: DataFrame) -> DataFrame:
    """The unweighted mean of the segments' shares: a mean of ratios, not a ratio of sums.

    Shares are summed as whole billionths, so the mean does not depend on the order of the rows."""
    share = F.round(F.col("validated") / F.col("original") * 1e11).cast("long")
    g = segments.groupBy("doc_id").agg(F.sum(share).alias("s"), F.count(F.lit(1)).alias("n_segments"))
    return g.select("doc_id", "n_segments", F.expr("(2 * s + n_segments * 10000000) div (2 * n_segments * 10000000) / 100.0D").alias("avg_segment_retention"))


def violation_stats(rule_results: DataFrame) -> DataFrame:
    """Violations of each rule over all documents and how many documents pass it."""
    return rule_results.groupBy("rule_id").agg(F.sum("violation_count").alias("violations"), F.sum("total_items").alias("items"), F.count_if("passed").alias("documents_passed"), F.count(F.lit(1)).alias("documents"))


def validated_metadata(v: Validated, rule_results: DataFrame, now: str = "") -> DataFrame:
    """One nested row per document that keeps at least one entity, as it goes into the validated file.

    ``critical_violations_removed`` counts the entities and relationships that were removed."""
    passed = F.array_sort(F.collect_list(F.when(F.col("passed"), F.col("rule_id"))))
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("rule_id"))))
    scores = F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule_id", "score"))))
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule_id", "violation_count"))))
    per_rule = rule_results.groupBy("doc_id").agg(scores.alias("rule_scores"), passed.alias("critical_rules_passed"), failed.alias("critical_rules_failed"), counts.alias("violations_by_rule"))
    segments = mean_segment_retention(segment_retention(v))
    r = retention(v).where("entities_after > 0").join(R.compliance(rule_results), "doc_id", "left").join(G.accuracy(v.ids), "doc_id", "left").join(per_rule, "doc_id", "left").join(segments, "doc_id", "left")
    return r.select("doc_id", F.struct(
        F.lit(now).alias("validation_timestamp"), F.lit("python").alias("validation_approach"), "critical_rules_passed",
        (F.col("entities_before") - F.col("entities_after") + F.col("rels_before") - F.col("rels_after")).alias("critical_violations_removed"),
        F.col("entities_before").alias("original_entity_count"), F.col("entities_after").alias("validated_entity_count"), F.col("rels_before").alias("original_relationship_count"), F.col("rels_after").alias("validated_relationship_count"),
        F.struct(F.col("compliance").alias("schema_compliance_weighted"), F.col("accuracy").alias("semantic_type_accuracy"), F.col("rel_retention").alias("relationship_retention_rate")).alias("quality_metrics"), "rule_scores",
        F.struct(F.col("n_entities").alias("total_entities"), F.col("n_correct").alias("correct_entities"), (F.col("n_entities") - F.col("n_correct")).alias("incorrect_entities"), F.col("accuracy").alias("semantic_type_accuracy"), F.col("cost_usd").alias("llm_cost")).alias("semantic_validation"),
        F.struct(F.size("critical_rules_failed").alias("critical_rules_failed_count"), "critical_rules_failed").alias("rule_compliance"),
        F.struct("total_violations", "violations_by_rule").alias("violation_statistics"), F.struct(F.col("n_segments").alias("total_segments"), "avg_segment_retention").alias("segment_statistics"),
    ).alias("validation_metadata"))
