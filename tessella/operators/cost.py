"""Token cost: per call, per document, per method."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.values import percent
from tessella.session import rank_within

DEFAULT_MODEL = "quill-large-2"


def priced(usage: DataFrame, pricing: DataFrame, default: str = DEFAULT_MODEL) -> DataFrame:
    """Cost of each call by its model's price per million tokens; an unpriced model costs as ``default``.

    Prices are a small fixed table, so the lookup is a broadcast. Tokens are divided before they are
    multiplied, so doubles come out alike everywhere.
    """
    p = F.broadcast(pricing.select("model", "input_usd", "output_usd"))
    d = F.broadcast(pricing.where(F.col("model") == default).select(F.col("input_usd").alias("d_in"), F.col("output_usd").alias("d_out")).limit(1))
    t = usage.select("usage_id", "document_name", "run_id", "segment_id", "model", "input_tokens", "output_tokens", "page_start", "page_end").join(p, "model", "left").join(d, F.lit(True), "left")
    cin = F.col("input_tokens") / 1e6 * F.coalesce("input_usd", "d_in")
    cout = F.col("output_tokens") / 1e6 * F.coalesce("output_usd", "d_out")
    span = F.when(F.col("page_start").isNotNull() & F.col("page_end").isNotNull(), F.col("page_end") - F.col("page_start") + 1)
    return t.select("usage_id", "document_name", "run_id", "segment_id", "model", "input_tokens", "output_tokens", cin.alias("input_cost"), cout.alias("output_cost"), (cin + cout).alias("total_cost"), "page_start", "page_end", span.alias("page_span"))


def document_summary(calls: DataFrame) -> DataFrame:
    """Per document: calls, tokens and cost of both directions, models and the mean per call."""
    tokens_in, tokens_out = F.sum("input_tokens"), F.sum("output_tokens")
    return calls.groupBy("document_name").agg(
        F.count(F.lit(1)).alias("n_calls"), tokens_in.alias("input_tokens"), tokens_out.alias("output_tokens"), (tokens_in + tokens_out).alias("total_tokens"),
        F.round(F.sum("input_cost"), 6).alias("input_cost"), F.round(F.sum("output_cost"), 6).alias("output_cost"), F.round(F.sum("total_cost"), 6).alias("total_cost"),
        F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"), F.round(F.avg("total_cost"), 6).alias("avg_cost"),
    )


def batch_summary(per_doc: DataFrame) -> DataFrame:
    cost, n, calls = F.sum("total_cost"), F.count(F.lit(1)), F.sum("n_calls")
    return per_doc.agg(
        n.alias("documents"), calls.alias("n_calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("total_tokens").alias("total_tokens"),
        F.round(cost, 4).alias("total_cost"), F.round(F.try_divide(cost, n), 4).alias("avg_cost_per_document"), F.round(F.try_divide(cost, calls), 6).alias("avg_cost_per_segment"),
    )


def ranking(per_doc: DataFrame) -> DataFrame:
    """The documents of a batch by cost, the dearest first, with their place."""
    t = rank_within(per_doc.select("document_name", "n_calls", "total_cost"), [], [F.desc("total_cost"), F.asc("document_name")], "place")
    return t.withColumn("place", F.col("place").cast("int")).orderBy("place")


def cumulative_basis(calls: DataFrame) -> DataFrame:
    """Total cost by what each report holds against what was spent.

    A tracker that is never reset makes each document's report hold all earlier documents of its run
    too; summing such reports counts a call once for every later document. Both figures, labelled."""
    per = calls.groupBy("run_id", "document_name").agg(F.sum("total_cost").alias("own"), F.min("usage_id").alias("first"))
    w = Window.partitionBy("run_id").orderBy("first").rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("reported", F.sum("own").over(w))
    return per.agg(F.round(F.sum("own"), 4).alias("spent"), F.round(F.sum("reported"), 4).alias("reported_sum"))


def wasted(per_doc: DataFrame, retention: DataFrame, gate: DataFrame) -> DataFrame:
    """Per document: extraction cost, the part spent on entities that were filtered, validation cost. A document
    that keeps no entity has no validated file, so its counts and its validation cost are 0."""
    r = retention.where("entities_after > 0").select(F.col("doc_id").alias("document_name"), "entities_before", "entities_after")
    r = r.join(gate.select(F.col("doc_id").alias("document_name"), F.col("cost_usd").alias("validation_cost")), "document_name", "left")
    t = per_doc.select("document_name", F.col("total_cost").alias("extraction_cost")).join(r, "document_name", "left").na.fill(0)
    share = F.coalesce(F.try_divide(F.col("entities_before") - F.col("entities_after"), F.col("entities_before")), F.lit(0.0))
    return t.select("document_name", "extraction_cost", "validation_cost", "entities_before", "entities_after", F.round(share * F.col("extraction_cost"), 6).alias("wasted_cost"))


def method_summary(per_doc: DataFrame) -> DataFrame:
    """Totals of one method with effective cost and cost per extracted and per validated entity."""
    a = per_doc.agg(F.sum("extraction_cost").alias("e"), F.sum("validation_cost").alias("v"), F.sum("entities_before").alias("n"), F.sum("entities_after").alias("k"))
    # over all documents together, not summed up from theirs
    a = a.withColumn("w", F.coalesce(F.try_divide(F.col("n") - F.col("k"), F.col("n")), F.lit(0.0)) * F.col("e"))
    effective = F.col("e") - F.col("w") + F.col("v")
    total = F.col("e") + F.col("v")
    return a.select(
        F.round("e", 4).alias("extraction_cost"), F.round("v", 4).alias("validation_cost"), F.round("w", 4).alias("wasted_cost"), F.col("n").alias("extracted"), F.col("k").alias("validated"),
        F.round(percent(F.col("k"), F.col("n")), 2).alias("retention"), F.round(F.coalesce(F.try_divide(F.col("e"), F.col("n")), F.lit(0.0)), 6).alias("cost_per_extracted"),
        F.round(F.coalesce(F.try_divide(effective, F.col("k")), F.lit(0.0)), 6).alias("cost_per_validated"), F.round(F.coalesce(F.try_divide(total, F.col("k")), F.lit(0.0)), 6).alias("total_per_validated"),
        F.round(total, 4).alias("total_cost"), F.round(effective, 4).alias("effective_cost"), F.round(percent(F.col("w"), total), 2).alias("wasted_percent"),
    )


# The metrics of a comparison of methods, in order.
METRICS = ["extraction_cost", "validation_cost", "total_cost", "wasted_cost", "extracted", "validated", "retention", "total_per_validated"]


def compare_methods(a: DataFrame, b: DataFrame) -> DataFrame:
    """(metric, baseline, guided, difference): two one-row summaries side by side."""
    long = lambda df, c: df.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(c)) for m in METRICS])))
    t = F.broadcast(long(a, "baseline")).join(long(b, "guided"), "metric")
    return t.select("metric", "baseline", "guided", F.round(F.col("guided") - F.col("baseline"), 6).alias("difference"))


def savings(comparison: DataFrame) -> DataFrame:
    """How much less the guided method costs for each validated entity, in percent; none if either costs nothing."""
    t = comparison.where("metric = 'total_per_validated' and baseline > 0 and guided > 0")
    return t.select(F.round((F.col("baseline") - F.col("guided")) / F.col("baseline") * 100, 1).alias("savings"))


def insights(comparison: DataFrame) -> DataFrame:
    """(metric, winner, lead): which method wins on cost per validated entity (only if both have one), retention
    and wasted cost, and by how much; a tie goes to the baseline."""
    gain = F.when(F.col("metric") == "retention", F.col("guided") - F.col("baseline")).otherwise(F.col("baseline") - F.col("guided"))
    lead = F.when(F.col("metric") == "total_per_validated", F.round(F.abs(gain) / F.col("baseline") * 100, 1)).when(F.col("metric") == "retention", F.round(F.abs(gain), 1)).otherwise(F.round(F.abs(gain), 4))
    asked = F.col("metric").isin("retention", "wasted_cost") | ((F.col("metric") == "total_per_validated") & (F.col("baseline") > 0) & (F.col("guided") > 0))
    return comparison.where(asked).select("metric", F.when(gain > 0, "guided").otherwise("baseline").alias("winner"), lead.alias("lead"))


def token_summary(calls: DataFrame) -> DataFrame:
    """Tokens and cost of all calls and their means per segment: ratios of sums; NULL without any call."""
    n, tokens = F.count(F.lit(1)), F.sum("input_tokens") + F.sum("output_tokens")
    return calls.agg(
        n.alias("total_segments"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), tokens.alias("total_tokens"),
        F.round(F.try_divide(tokens, n), 0).alias("avg_tokens_per_segment"), F.round(F.try_divide(F.sum("total_cost"), n), 4).alias("avg_cost_per_segment"),
    )


def uncalled_segments(segments: DataFrame, usage: DataFrame) -> DataFrame:
    """Segments of a run that no call was made for."""
    s = segments.where("segment_id is not null").select(F.col("doc_id").alias("document_name"), "run_id", "segment_id").distinct()
    return s.join(usage.select("document_name", "run_id", "segment_id").distinct(), ["document_name", "run_id", "segment_id"], "left_anti")
