"""Graph operators: failures, merging of equal metrics, redirected edges, triples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import strip
from tessella.functions.values import blank, field, is_falsy, is_na, python_list, text_of
from tessella.operators.cascade import Validated
from tessella.operators.rules import key_of
from tessella.session import hot_join, rank_within, stage

# What is said of a failure where nothing is known.
DEFAULT_REASON = "Entity removed during validation (detailed reasoning not available)"
NO_TYPE, NO_LABEL = "Unknown", "No label"


def failed_entities(v: Validated) -> DataFrame:
    """Ids that did not survive with type, label and reason; of repeated ids the last row speaks, of several
    mismatches the last one gives the reason."""
    at = F.struct("pos", "rec_id")
    rows = v.gate.where("id is not null").withColumn("key", key_of("id"))
    last = rows.groupBy("doc_id", "key").agg(F.max(at)["rec_id"].alias("rec_id"), F.max(F.when(F.col("mismatch"), at))["rec_id"].alias("why"))
    gone = v.ids.where("not alive and key <> ''").select("doc_id", "key").join(last, ["doc_id", "key"])
    told = gone.join(v.gate.select("rec_id", F.col("id").alias("entity_id"), F.col("type").alias("entity_type"), F.col("label").alias("entity_label")), "rec_id")
    reasons = v.gate.where("mismatch").select(F.col("rec_id").alias("why"), "reasoning")
    t = told.join(reasons, "why", "left")
    return t.select("doc_id", "entity_id", F.coalesce("entity_type", F.lit(NO_TYPE)).alias("entity_type"), F.coalesce("entity_label", F.lit(NO_LABEL)).alias("entity_label"), F.coalesce("reasoning", F.lit(DEFAULT_REASON)).alias("failure_reason"))


def failures_per_document(v: Validated) -> DataFrame:
    """Failed ids of every document, zeros included."""
    return v.ids.groupBy("doc_id").agg(F.count_if(~F.col("alive") & (F.col("key") != "")).alias("n_failed"))


def metric_kind() -> F.Column:
    return text_of(field(F.col("props"), "metric_type"))


def merge_map(ents: DataFrame, rels: DataFrame) -> DataFrame:
    """(doc_id, old_id, new_id): metrics of a document with one label, pointed at the one that stays.

    A direct metric that a category consists of comes first, then any direct, calculated, input metric;
    then the earliest. An id in several groups follows the group that begins last. Groups without a known kind are left alone. A hot label is reduced before it is
    shuffled and its members meet the chosen one by a salted join.
    """
    linked = rels.where("predicate = 'ConsistOf'").select("doc_id", F.col("object").alias("id")).distinct().withColumn("linked", F.lit(True))
    m = ents.where("type = 'Metric' and id is not null").select("doc_id", "id", "pos", "rec_id", strip(F.lower(F.coalesce("label", F.lit("")))).alias("key"), metric_kind().alias("kind"))
    m = hot_join(m, linked, ["doc_id", "id"], "left", spread=F.col("rec_id"))
    rank = F.when((F.col("kind") == "DirectMetric") & F.col("linked"), 0).when(F.col("kind") == "DirectMetric", 1).when(F.col("kind") == "CalculatedMetric", 2).when(F.col("kind") == "InputMetric", 3)
    first = m.groupBy("doc_id", "key").agg(F.min(F.when(rank.isNotNull(), F.struct(rank.alias("r"), "pos", "rec_id", "id"))).alias("p"), F.min(F.struct("pos", "rec_id")).alias("at"), F.count(F.lit(1)).alias("n")).where("n > 1 and p is not null")
    joined = hot_join(m, first.select("doc_id", "key", "at", F.col("p.id").alias("new_id")), ["doc_id", "key"], "inner", spread=F.col("rec_id"))
    return joined.where("id <> new_id").groupBy("doc_id", F.col("id").alias("old_id")).agg(F.max_by("new_id", "at").alias("new_id"))


def redirect(rels: DataFrame, merges: DataFrame) -> DataFrame:
    """Edges after merging: ends redirected, loops dropped, of equal edges the first kept."""
    s = merges.select("doc_id", F.col("old_id").alias("subject"), F.col("new_id").alias("s2"))
    o = merges.select("doc_id", F.col("old_id").alias("object"), F.col("new_id").alias("o2"))
    spread = F.col("rel_id")
    t = hot_join(hot_join(rels, s, ["doc_id", "subject"], "left", spread=spread), o, ["doc_id", "object"], "left", spread=spread)
    t = t.select("rel_id", "pos", "doc_id", F.coalesce("s2", "subject").alias("subject"), "predicate", F.coalesce("o2", "object").alias("object"))
    t = t.where(~F.col("subject").eqNullSafe(F.col("object")))
    return t.groupBy("doc_id", "subject", "predicate", "object").agg(F.min(F.struct("pos", "rel_id")).alias("f")).select(F.col("f.rel_id").alias("rel_id"), "doc_id", "subject", "predicate", "object")


def effective_type() -> F.Column:
    """Metrics by their kind: none means DirectMetric, an unknown one stays Metric."""
    kind = F.coalesce(metric_kind(), F.when(field(F.col("props"), "metric_type").isNull(), "DirectMetric"))
    return F.when((F.col("type") == "Metric") & kind.isin("DirectMetric", "CalculatedMetric", "InputMetric"), kind).otherwise(F.col("type"))


def legend(ents: DataFrame) -> DataFrame:
    """Entities by effective type, direct and input metrics together."""
    e = F.when(effective_type().isin("DirectMetric", "InputMetric"), "Direct/InputMetric").otherwise(effective_type())
    return ents.groupBy(F.coalesce(e, F.lit("Unknown")).alias("legend")).agg(F.count(F.lit(1)).alias("n"))


def induced(rels: DataFrame, ents: DataFrame) -> DataFrame:
    """Edges whose ends both are entities of the document."""
    ids = ents.where("id is not null").select("doc_id", "id").distinct()
    t = hot_join(rels, ids.withColumnRenamed("id", "subject"), ["doc_id", "subject"], "inner", spread=F.col("rel_id"))
    return hot_join(t, ids.withColumnRenamed("id", "object"), ["doc_id", "object"], "inner", spread=F.col("rel_id"))


def _tree(rels: DataFrame) -> DataFrame:
    return rels.where("predicate in ('ConsistOf', 'RequiresInputFrom') and subject is not null and object is not null")


def parents(rels: DataFrame) -> DataFrame:
    """The parent of each node by ConsistOf and RequiresInputFrom edges; the last one wins."""
    return _tree(rels).groupBy("doc_id", "object").agg(F.max(F.struct("pos", "rel_id", "subject")).alias("l")).select("doc_id", F.col("object").alias("node"), F.col("l.subject").alias("parent"))


def children(rels: DataFrame) -> DataFrame:
    """(doc_id, parent, ord, child): the children of each node in the order of their edges, repeated ones included."""
    t = _tree(rels).select("doc_id", F.col("subject").alias("parent"), "pos", "rel_id", F.col("object").alias("child"))
    return rank_within(t, ["doc_id", "parent"], [F.asc("pos"), F.asc("rel_id")], "ord").select("doc_id", "parent", F.col("ord").cast("int").alias("ord"), "child")


def drawing_order(ents: DataFrame, rels: DataFrame, kind: str = "Category") -> DataFrame:
    """(doc_id, id, n_children, k, side): nodes of a type in drawing order, from left to right.

    Nodes with children stand in the middle, most first; of those without, the first half (rounded down)
    stands left of them and the rest right, each in order of appearance."""
    n = _tree(rels).groupBy("doc_id", F.col("subject").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = ents.where((F.col("type") == kind) & F.col("id").isNotNull()).groupBy("doc_id", "id").agg(F.min(F.struct("pos", "rec_id")).alias("at"))
    t = stage(nodes.join(n, ["doc_id", "id"], "left").na.fill(0, ["n_children"]), "drawn")
    t = rank_within(t.withColumn("_bare", F.col("n_children") == 0), ["doc_id", "_bare"], [F.desc("n_children"), F.asc("at")], "_r")
    bare = t.groupBy("doc_id").agg(F.count_if("_bare").alias("_b"), F.count_if(~F.col("_bare")).alias("_m"))
    t = hot_join(t, bare, ["doc_id"], "left", spread=F.xxhash64("id"))
    half = F.floor(F.col("_b") / 2)
    side = F.when(~F.col("_bare"), "middle").when(F.col("_r") <= half, "left").otherwise("right")
    k = F.when(~F.col("_bare"), half + F.col("_r")).when(F.col("_r") <= half, F.col("_r")).otherwise(F.col("_m") + F.col("_r"))
    return t.select("doc_id", "id", "n_children", k.cast("int").alias("k"), side.alias("side"))


def triples(ents: DataFrame, rels: DataFrame) -> DataFrame:
    """(doc_id, s, p, o, o_kind): the graph as a set of triples. Falsy and 'N/A' properties and empty
    provenance are left out; lists are written as Python prints them."""
    named = ents.where("id is not null")
    lit = F.lit("literal").alias("o_kind")
    kind = named.select("doc_id", F.col("id").alias("s"), F.lit("rdf:type").alias("p"), F.coalesce("type", F.lit("Entity")).alias("o"), F.lit("uri").alias("o_kind"))
    label = named.where(~blank(F.col("label"))).select("doc_id", F.col("id").alias("s"), F.lit("rdfs:label").alias("p"), F.col("label").alias("o"), lit)
    props = named.select("doc_id", "id", F.explode(F.try_variant_get("props", "$", "map<string,variant>")).alias("k", "v")).where(~is_falsy(F.col("v")) & ~is_na(F.col("v")))
    props = props.select("doc_id", F.col("id").alias("s"), F.concat(F.lit("esg:"), "k").alias("p"), python_list(F.col("v")).alias("o"), lit)
    prov = named.select("doc_id", "id", F.explode("provenance").alias("k", "v")).where(~blank(F.col("v"))).select("doc_id", F.col("id").alias("s"), F.concat(F.lit("esg:provenance_"), "k").alias("p"), F.col("v").alias("o"), lit)
    edges = rels.where("subject is not null and object is not null").select("doc_id", F.col("subject").alias("s"), F.coalesce("predicate", F.lit("Unknown")).alias("p"), F.col("object").alias("o"), F.lit("uri").alias("o_kind"))
    return kind.unionByName(label).unionByName(props).unionByName(prov).unionByName(edges).distinct()
