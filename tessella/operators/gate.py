"""The semantic gate: does each entity's type fit its content?"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.values import blank, field, percent, text_of
from tessella.session import hot_join
from tessella.vocab import ENTITY_TYPES

CALL_COST = 0.0001
Judge = Callable[[DataFrame], DataFrame]


def known_type() -> F.Column:
    return F.coalesce(F.col("type"), F.lit("unknown")).isin(ENTITY_TYPES)


def prompt() -> F.Column:
    """What a judge gets to see: the label, and for metrics and models the description if there is one."""
    description = text_of(field(F.col("props"), "description"))
    label = F.concat(F.lit("Label: "), F.coalesce("label", F.lit("")))
    return F.when(F.col("type").isin("Metric", "Model") & ~blank(F.coalesce(description, F.lit(""))), F.concat(label, F.lit("\nDescription: "), description)).otherwise(label)


def offline_judge(ents: DataFrame) -> DataFrame:
    """A deterministic stand-in for a language model: adds ``is_correct``, ``reasoning`` and ``failed``.

    It needs no join; a label that is missing counts as a failed call."""
    wrong = F.pmod(F.length("label") + F.length(F.coalesce("id", F.lit(""))), F.lit(7)) == 3
    why = F.concat(F.lit('"'), "label", F.lit('" does not read like a '), F.coalesce("type", F.lit("unknown")))
    return ents.withColumn("is_correct", ~wrong).withColumn("reasoning", why).withColumn("failed", F.col("label").isNull())


def table_judge(verdicts: DataFrame) -> Judge:
    """A judge that looks verdicts up by (doc_id, id), with their ``reasoning`` if the table has one; an answer without
    a verdict is a 'no', an entity without an answer a failed call. Other columns of the table are left alone."""
    why = F.coalesce("reasoning", F.lit("")) if "reasoning" in verdicts.columns else F.lit("")
    answers = verdicts.select("doc_id", "id", F.coalesce("is_correct", F.lit(False)).alias("is_correct"), why.alias("reasoning"), F.lit(True).alias("_answered")).dropDuplicates(["doc_id", "id"])
    return lambda ents: hot_join(ents, answers, ["doc_id", "id"], "left", spread=F.col("rec_id")).withColumn("failed", F.col("_answered").isNull()).drop("_answered")


# The reason given for a type that is not of the ontology, around the type.
UNKNOWN_TYPE = ('SEMANTIC FAILURE: Unknown/invalid type "', '" not in ontology schema. Only 4 types allowed: Industry, Category, Metric, Model.')


def judged(ents: DataFrame, judge: Judge | None = offline_judge) -> DataFrame:
    """Adds ``called`` (a call that succeeded), ``mismatch`` and, for mismatches, ``reasoning``.

    An unknown type is a mismatch without a call; a failed call counts as correct and costs nothing.
    Without a judge nothing is called and nothing mismatches."""
    if judge is None:
        return ents.withColumn("called", F.lit(False)).withColumn("mismatch", F.lit(False)).withColumn("gate_open", F.lit(True)).withColumn("reasoning", F.lit(None).cast("string"))
    known = known_type()
    out = judge(ents)
    if "reasoning" not in out.columns:
        out = out.withColumn("reasoning", F.lit(""))
    fail = F.coalesce(F.col("failed"), F.lit(False))
    mismatch = ~known | (~fail & ~F.coalesce(F.col("is_correct"), F.lit(False)))
    why = F.when(~known, F.concat(F.lit(UNKNOWN_TYPE[0]), F.coalesce("type", F.lit("unknown")), F.lit(UNKNOWN_TYPE[1]))).when(mismatch, F.coalesce("reasoning", F.lit("")))
    return out.withColumn("reasoning", why).withColumn("called", known & ~fail).withColumn("mismatch", mismatch).withColumn("gate_open", F.lit(False)).drop("is_correct", "failed")


def accuracy(gate: DataFrame) -> DataFrame:
    """Per document: entities, correct ones, accuracy in percent (0 where the gate is open) and cost.

    ``gate`` holds judged rows, or their counts per id (``n``, ``n_ok``, ``n_calls``)."""
    if "n_ok" in gate.columns:
        g = gate.groupBy("doc_id").agg(F.sum("n").alias("n_entities"), F.sum("n_ok").alias("n_correct"), F.sum("n_calls").alias("n_calls"))
    else:
        g = gate.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_entities"), F.count_if(~F.col("mismatch") & ~F.col("gate_open")).alias("n_correct"), F.count_if("called").alias("n_calls"))
    return g.select("doc_id", "n_entities", "n_correct", F.round(percent(F.col("n_correct"), F.col("n_entities")), 2).alias("accuracy"), F.round(F.col("n_calls") * CALL_COST, 4).alias("cost_usd"))
