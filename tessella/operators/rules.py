"""The six structural rules, their scores and the registry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.values import blank, field, is_falsy, is_na, present, text_of
from tessella.session import hot_join, merged
from tessella.vocab import PREDICATES, REQUIRED_PROPERTIES


@dataclass(frozen=True)
class Rule:
    """A rule: aggregates over a document's ids (see :func:`per_id`) or its relationships.

    ``violations`` and ``items`` are counted per document; where ``crash`` holds the rule could not look at
    the document. A rule of one's own is added by handing ``[*RULES, Rule(...)]`` to :func:`results`."""

    rule_id: str
    name: str
    description: str
    violations: Column | str
    items: Column | str
    crash: str | None = None
    over: str = "entities"
    critical: bool = True


def _sum(c: str) -> str:
    return f"sum({c})"


NOT_LINKED = "sum(CASE WHEN linked THEN 0 ELSE calc END)"
OUTSIDE = "count_if(coalesce(predicate, '') NOT IN (" + ", ".join(f"'{p}'" for p in PREDICATES) + "))"
RULES = [
    Rule("VR001", "Entity Uniqueness", "All entity IDs must be unique within the knowledge graph", "sum(n) - count(1)", "sum(n)"),
    Rule("VR002", "Entity Type-Specific Schema Compliance", "Each entity has the fields that the ontology asks of its type", "count_if(v2)", "sum(n)", "max(c2)"),
    Rule("VR003", "Metric Property Values", "Direct and calculated metrics need a code, quantitative ones a unit", "count_if(v3)", "sum(metrics)", "max(c3)"),
    Rule("VR004", "Model Property Values", "Models need at least one input variable", "sum(v4)", "sum(models)", "max(c4)"),
    Rule("VR005", "Relationship Predicate Validity", "Relationships use the predicates of the ontology", OUTSIDE, "count(1)", over="relationships"),
    Rule("VR006", "CalculatedMetric-Model Links", "Every calculated metric is the subject of an IsCalculatedBy relationship", NOT_LINKED, "sum(calc)", "max(c3)"),
]


def registry(spark: SparkSession, rules: list[Rule] = RULES) -> DataFrame:
    return spark.createDataFrame([(r.rule_id, r.name, r.description, r.over, r.critical) for r in rules], "rule_id string, rule_name string, description string, over string, critical boolean")


def flags(ents: DataFrame) -> DataFrame:
    """Per entity: which fields are missing, which rules it breaks, and which rules it would crash.

    A rule crashes on JSON null where it looks for keys (VR002), and on anything but an object where it
    reads values (VR003, VR004, VR006)."""
    p, kind = F.col("props"), F.col("props_kind")
    missing = F.concat(
        F.when(blank(F.col("id")), F.array(F.lit("id"))).otherwise(F.array()), F.when(blank(F.col("type")), F.array(F.lit("type"))).otherwise(F.array()),
        F.when(blank(F.col("label")), F.array(F.lit("label"))).otherwise(F.array()), F.when(F.col("source").isNull(), F.array(F.lit("source"))).otherwise(F.array()),
        *[
            F.when((F.col("type") == t) & (kind.isin("object", "absent")), F.filter(F.array(*[F.when(~present(p, f), F.lit("properties." + f)) for f in fields]), lambda x: x.isNotNull())).otherwise(F.array())
            for t, fields in REQUIRED_PROPERTIES.items()
        ],
        F.when((F.col("type") == "Industry") & kind.isin("null", "other"), F.array(F.lit("properties"))).otherwise(F.array()),
    )
    metric, model = F.col("type") == "Metric", F.col("type") == "Model"
    metric_type = text_of(field(p, "metric_type"))
    code, unit, inputs = field(p, "code"), field(p, "unit"), field(p, "input_variables")
    bad_code = metric_type.isin("DirectMetric", "CalculatedMetric") & (is_falsy(code) | is_na(code))
    bad_unit = (text_of(field(p, "measurement_type")) == "Quantitative") & (is_falsy(unit) | is_na(unit))
    items = F.try_variant_get(inputs, "$", "array<variant>")
    empty = is_falsy(inputs) | is_na(inputs) | F.coalesce(F.forall(items, is_falsy), F.lit(False))
    unreadable = kind.isin("null", "other")
    no = F.lit(False)
    return ents.select(
        *ents.columns, missing.alias("missing"),
        (F.size(missing) > 0).alias("vr002"), F.coalesce(metric & (F.coalesce(bad_code, no) | F.coalesce(bad_unit, no)), no).alias("vr003"),
        F.coalesce(model & empty, no).alias("vr004"), F.coalesce(metric & (metric_type == "CalculatedMetric"), no).alias("calculated"),
        F.coalesce(F.col("type").isin(list(REQUIRED_PROPERTIES)) & (kind == "null"), no).alias("crash2"),
        F.coalesce(metric & unreadable, no).alias("crash3"), F.coalesce(model & unreadable, no).alias("crash4"),
    )


def key_of(name: str) -> Column:
    """A node id as a join key: null is a key of its own, so null-safe joins are plain ones."""
    return F.coalesce(F.concat(F.lit("="), name), F.lit(""))


def per_id(rows: DataFrame) -> DataFrame:
    """One row for each id of each document (null is an id like any other): everything that gate, rules and
    cascade need to know of it, by one aggregation that combines before it shuffles.

    ``rows`` are entities, judged or not. ``bad``: a mismatch removes the id; ``alive``: it survives, which
    needs a single row; ``rec_id`` is that row."""
    f = flags(rows)
    if "mismatch" not in rows.columns:
        f = f.withColumn("mismatch", F.lit(False)).withColumn("called", F.lit(False)).withColumn("gate_open", F.lit(True))
    g = f.withColumn("key", key_of("id")).groupBy("doc_id", "key").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("mismatch") & ~blank(F.col("id"))).alias("bad"), F.count_if(~F.col("mismatch") & ~F.col("gate_open")).alias("n_ok"), F.count_if("called").alias("n_calls"), F.max("rec_id").alias("rec_id"),
        F.max("vr002").alias("v2"), F.max("vr003").alias("v3"), F.count_if("vr004").alias("v4"), F.count_if(F.col("type") == "Metric").alias("metrics"), F.count_if(F.col("type") == "Model").alias("models"), F.count_if("calculated").alias("calc"),
        F.max("crash2").alias("c2"), F.max("crash3").alias("c3"), F.max("crash4").alias("c4"),
    )
    return g.withColumn("alive", ~F.col("bad") & (F.col("n") == 1))


def calls(rels: DataFrame) -> DataFrame:
    """(doc_id, key, linked): ids with a calculation link."""
    return rels.where("predicate = 'IsCalculatedBy'").select("doc_id", key_of("subject").alias("key")).distinct().withColumn("linked", F.lit(True))


def results(ents: DataFrame, rels: DataFrame, strict: bool = True, rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, rule_id, violation_count, total_items, score, passed) of every document and rule.

    ``ents`` are entities or, already reduced, their ids (:func:`per_id`). ``strict`` keeps the reported
    behaviour: a rule that crashes has -1 violations of 0 items and scores 100 but has not passed.
    Otherwise it scores 0. Entities are reduced per id before documents, so a large document is summed in
    parts."""
    ids = ents if "n_ok" in ents.columns else per_id(ents)
    ids = ids.join(merged(calls(rels)), ["doc_id", "key"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))

    def counted(frame: DataFrame, over: str) -> DataFrame:
        mine = [(i, r) for i, r in enumerate(rules) if r.over == over]
        column = lambda x: F.expr(x) if isinstance(x, str) else x
        aggs = [c for i, r in mine for c in (column(r.violations).alias(f"v{i}"), column(r.items).alias(f"t{i}"), (F.expr(r.crash) if r.crash else F.lit(False)).alias(f"x{i}"))]
        return frame.groupBy("doc_id").agg(F.count(F.lit(1)).alias(f"_{over}"), *aggs)

    doc = counted(ids, "entities").join(counted(rels, "relationships"), "doc_id", "full_outer")

    def row(i: int, rule: Rule) -> Column:
        crash = F.coalesce(F.col(f"x{i}"), F.lit(False))
        count = F.when(crash, F.lit(-1)).otherwise(F.coalesce(F.col(f"v{i}"), F.lit(0))).cast("long")
        items = F.when(crash, F.lit(0)).otherwise(F.coalesce(F.col(f"t{i}"), F.lit(0))).cast("long")
        score = F.when(crash, F.lit(100.0 if strict else 0.0)).when(items > 0, F.round((items - count) / items * 100, 2)).otherwise(F.lit(100.0))
        return F.struct(F.lit(rule.rule_id).alias("rule_id"), count.alias("violation_count"), items.alias("total_items"), score.alias("score"), (count == 0).alias("passed"))

    return doc.select("doc_id", F.inline(F.array(*[row(i, r) for i, r in enumerate(rules)])))


def compliance(rule_results: DataFrame) -> DataFrame:
    """Per document: the mean of the rounded rule scores, rounded again; PASS if no rule failed.

    The mean is taken over whole hundredths, so it does not depend on the order of the rows; exact ties
    go up."""
    g = rule_results.groupBy("doc_id").agg(F.sum(F.round(F.col("score") * 100).cast("long")).alias("s"), F.count_if(~F.col("passed")).alias("critical_failures"), F.count(F.lit(1)).alias("n_rules"), F.sum("violation_count").alias("total_violations"))
    mean = F.expr("(2 * s + n_rules) div (2 * n_rules) / 100.0D")
    return g.select("doc_id", mean.alias("compliance"), "critical_failures", (F.col("n_rules") - F.col("critical_failures")).alias("passed_rules"), "total_violations", F.when(F.col("critical_failures") == 0, "PASS").otherwise("FAIL").alias("status"))


def duplicate_rows(ents: DataFrame) -> DataFrame:
    """Rows whose id came earlier in the document, with the label of the first; null is an id like any other."""
    rows = ents.withColumn("_key", key_of("id"))
    first = rows.groupBy("doc_id", "_key").agg(F.min(F.struct("pos", "rec_id", "label")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = hot_join(rows.select("rec_id", "doc_id", "_key", "id", "label"), first, ["doc_id", "_key"], "inner", spread=F.col("rec_id"))
    return joined.where(F.col("rec_id") != F.col("f.rec_id")).select("rec_id", "doc_id", "id", F.col("f.label").alias("first_occurrence"), F.col("label").alias("duplicate_label"))


def unlinked(ents: DataFrame, rels: DataFrame) -> DataFrame:
    """Calculated metrics without a calculation link."""
    rows = flags(ents).where("calculated").select("rec_id", "doc_id", key_of("id").alias("key"))
    return hot_join(rows, calls(rels), ["doc_id", "key"], "left", spread=F.col("rec_id"), grows=True).where("linked is null").select("rec_id")


def signature_violations(ents: DataFrame, rels: DataFrame, signatures: DataFrame) -> DataFrame:
    """Extension, off by default: relationships between types that the ontology does not join."""
    types = ents.where("id is not null").groupBy("doc_id", "id").agg(F.min_by("type", F.struct("pos", "rec_id")).alias("type"))
    s = types.select("doc_id", F.col("id").alias("subject"), F.col("type").alias("subject_type"))
    o = types.select("doc_id", F.col("id").alias("object"), F.col("type").alias("object_type"))
    spread = F.col("rel_id")
    typed = hot_join(hot_join(rels, s, ["doc_id", "subject"], "inner", spread=spread), o, ["doc_id", "object"], "inner", spread=spread)
    return typed.join(F.broadcast(signatures), ["subject_type", "predicate", "object_type"], "left_anti").select("rel_id", "doc_id", "subject_type", "predicate", "object_type")
