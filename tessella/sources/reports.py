"""Reports as lines of text and as tables with formatted figures.

A report is a table (section, ord, value): its lines are formatted where the rows are, and its order is a sort
of that table, so a report of millions of documents is written by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import cascade, report, rules
from tessella.session import stage, union_all

LINE = "section int, ord string, value string"


def _lines(df: DataFrame, section: int, order: Column, pattern: str, *cols: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), F.concat(F.lit("1"), order.cast("string")).alias("ord"), F.format_string(pattern, *cols).alias("value"))


def _head(df: DataFrame, section: int, title: str, columns: str = "") -> DataFrame:
    rows = [(section, "0a", title), (section, "0b", "=" * len(title))] + ([(section, "0c", columns), (section, "0d", "-" * len(columns))] if columns else [])
    return df.sparkSession.createDataFrame(rows, LINE)


def _cut(c: str, n: int) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, n)


def validation_report(v: cascade.Validated, meta: DataFrame, rule_results: DataFrame, ents: DataFrame) -> DataFrame:
    """(section, ord, value): the validation report of a batch: totals, a line per document, types, predicates, rules,
    quality metrics and provenance."""
    docs = stage(report.documents(v, meta, rule_results), "report-documents")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    total = report.grand_totals(docs)
    facts = [("Documents", "documents"), ("Pages", "pages"), ("Segments", "segments"), ("Entities extracted", "entities"), ("Entities validated", "validated"), ("Metrics", "metrics")]
    long = total.select(F.posexplode(F.array(*[F.struct(F.lit(k).alias("k"), n(c).alias("x")) for k, c in facts])).alias("i", "f"))
    types = report.type_distribution(v.gate, v.entities)
    predicates = report.predicate_distribution(v.ends)
    matrix = report.rule_matrix(rule_results)
    cells = matrix.select("doc_id", F.posexplode(F.array(*[F.struct(F.lit(r.rule_id).alias("rule"), F.lit(r.name).alias("name"), F.col(r.rule_id.lower()).alias("cell")) for r in rules.RULES])).alias("i", "c"))
    last = lambda c: F.concat(F.when(F.col(c) == "TOTAL", "2").otherwise("1"), F.col(c))
    doc = F.coalesce("doc_id", F.lit(""))
    parts = [
        _head(docs, 1, "1. OVERALL STATISTICS"), _lines(long, 1, F.col("i"), "%-24s %12d", F.col("f.k"), F.col("f.x")),
        _head(docs, 2, "2. QUALITY METRICS", f"{'Document':<40} {'Schema %':>10} {'Accuracy %':>10} {'Rels kept %':>11}"), _lines(docs, 2, doc, "%-40s %10.2f %10.2f %11.2f", _cut("doc_id", 40), F.col("compliance"), F.col("accuracy"), F.col("rel_retention")),
        _head(docs, 3, "3. DOCUMENT SUMMARY", f"{'Document':<40} {'Pages':>7} {'Segments':>9} {'Entities':>9} {'Valid':>9} {'Rels':>9} {'Valid':>9}"),
        _lines(docs, 3, doc, "%-40s %7d %9d %9d %9d %9d %9d", _cut("doc_id", 40), n("total_pages"), n("total_segments"), n("entities_before"), n("entities_after"), n("rels_before"), n("rels_after")),
        _head(docs, 4, "4. ENTITY TYPES", f"{'Type':<24} {'Extracted':>10} {'Validated':>10} {'Kept %':>8}"), _lines(types, 4, last("type"), "%-24s %10d %10d %8.1f", F.col("type"), n("n_before"), n("n_after"), F.col("retention")),
        _head(docs, 5, "5. RELATIONSHIP PREDICATES", f"{'Predicate':<24} {'Extracted':>10} {'Validated':>10} {'Kept %':>8}"), _lines(predicates, 5, last("predicate"), "%-24s %10d %10d %8.1f", _cut("predicate", 24), n("n_before"), n("n_after"), F.col("retention")),
        _head(docs, 6, "6. VALIDATION RULES", f"{'Rule':<6} {'Name':<40} {'Document':<40} Result"), _lines(cells, 6, F.concat("c.rule", doc), "%-6s %-40s %-40s %s", F.col("c.rule"), F.col("c.name"), _cut("doc_id", 40), F.col("c.cell")),
        _head(docs, 7, "7. PROVENANCE", f"{'Document':<40} {'Entities':>9} {'Segment %':>10} {'Time %':>8}"),
        _lines(report.provenance_coverage(ents), 7, doc, "%-40s %9d %10.1f %8.1f", _cut("doc_id", 40), n("n_entities"), F.col("with_provenance"), F.col("with_timestamp")),
    ]
    return union_all(parts)


def write_report(lines: DataFrame, path: str) -> None:
    """The lines in order, as text files in order."""
    lines.orderBy("section", "ord").select("value").write.mode("overwrite").text(path)


def money(c: str | Column, places: int) -> Column:
    """An amount with so many places; halves, told by two places more, go up."""
    c = F.col(c) if isinstance(c, str) else c
    return F.format_string(f"%.{places}f", F.floor((F.round(c * 10.0 ** (places + 2)) + 50) / 100) / 10.0**places)


def cost_breakdown(summary: DataFrame) -> DataFrame:
    """Cost by stage of one method, as the report prints it."""
    none = F.lit(0.0)
    rows = [("Stage 2 Extraction", F.col("extraction_cost"), none), ("Stage 3 Validation", none, F.col("validation_cost")), ("Total Pipeline", F.col("extraction_cost"), F.col("validation_cost"))]
    return summary.select(F.inline(F.array(*[F.struct(F.lit(k).alias("stage"), money(e, 4).alias("extraction_usd"), money(w, 4).alias("validation_usd"), money(e + w, 4).alias("total_usd")) for k, e, w in rows])))


def cost_efficiency(summary: DataFrame) -> DataFrame:
    """What one method costs for each entity and how many it keeps, as the report prints it."""
    count = lambda c: F.col(c).cast("string")
    rows = [
        ("Cost per Extracted Entity (USD)", money("cost_per_extracted", 6)), ("Cost per Validated Entity (USD)", money("cost_per_validated", 6)), ("Entity Retention Rate (%)", money("retention", 2)), ("Total Entities Extracted", count("extracted")),
        ("Total Entities Validated", count("validated")), ("Total Entities Filtered", (F.col("extracted") - F.col("validated")).cast("string")), ("Wasted Cost (USD)", money("wasted_cost", 4)),
    ]
    return summary.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in rows])))


def document_costs(wasted: DataFrame) -> DataFrame:
    """Cost, retention and waste of each document, as the report prints it."""
    kept = F.coalesce(F.try_divide(F.col("entities_after"), F.col("entities_before")) * 100, F.lit(0.0))
    return wasted.select(
        F.col("document_name").alias("document"), money("extraction_cost", 4).alias("extraction_usd"), money("validation_cost", 4).alias("validation_usd"), money(F.col("extraction_cost") + F.col("validation_cost"), 4).alias("total_usd"),
        F.col("entities_before").alias("extracted"), F.col("entities_after").alias("validated"), money(kept, 2).alias("retention"), money("wasted_cost", 4).alias("wasted_usd"),
    )


def comparison_tables(baseline: DataFrame, guided: DataFrame) -> dict[str, DataFrame]:
    """The four tables that hold two methods against each other, by name."""
    both = baseline.select(F.lit("Baseline").alias("method"), "*").unionByName(guided.select(F.lit("Ontology-Guided").alias("method"), "*"))
    return {
        "comparison_total_cost": both.select("method", money("extraction_cost", 4).alias("extraction_usd"), money("validation_cost", 4).alias("validation_usd"), money("total_cost", 4).alias("total_usd")),
        "comparison_wasted_cost": both.select("method", money("effective_cost", 4).alias("effective_usd"), money("wasted_cost", 4).alias("wasted_usd"), money("total_cost", 4).alias("total_usd"), money("wasted_percent", 2).alias("wasted_percent")),
        "comparison_entity_retention": both.select("method", "extracted", "validated", (F.col("extracted") - F.col("validated")).alias("filtered"), money("retention", 2).alias("retention")),
        "comparison_cost_efficiency": both.select("method", money("total_per_validated", 6).alias("per_validated_usd"), money("total_cost", 4).alias("total_usd"), "validated"),
    }


def cost_report(calls: DataFrame, summary: DataFrame) -> DataFrame:
    """(section, ord, value): the readable cost report of each document, one section a document by its place in the
    alphabet of the sort key: totals first, then a line per call."""
    t = summary.select(F.col("document_name").alias("d"), F.posexplode(F.array(
        F.format_string("Document: %s", "document_name"), F.format_string("Calls: %d   Models: %s", "n_calls", "models"), F.format_string("Tokens: %d in, %d out, %d in all", F.coalesce("input_tokens", F.lit(0)), F.coalesce("output_tokens", F.lit(0)), F.coalesce("total_tokens", F.lit(0))),
        F.format_string("Cost: $%.4f in, $%.4f out, $%.4f in all, $%.4f a call", F.coalesce("input_cost", F.lit(0.0)), F.coalesce("output_cost", F.lit(0.0)), F.coalesce("total_cost", F.lit(0.0)), F.coalesce("avg_cost", F.lit(0.0))),
    )).alias("i", "value"))
    pages = F.when(F.col("page_start").isNull() | F.col("page_end").isNull(), "N/A").when(F.col("page_start") == F.col("page_end"), F.format_string("p.%d", "page_start")).otherwise(F.format_string("p.%d-%d", "page_start", "page_end"))
    each = calls.select(F.col("document_name").alias("d"), F.format_string("%-15s %-10s %12d %12d $%11.4f", F.coalesce("segment_id", F.lit("")), pages, F.coalesce("input_tokens", F.lit(0)), F.coalesce("output_tokens", F.lit(0)), F.coalesce("total_cost", F.lit(0.0))).alias("value"), F.format_string("%020d", "usage_id").alias("i"))
    name = F.coalesce("d", F.lit(""))
    return t.select(F.lit(1).alias("section"), F.concat(name, F.lit("\x01"), "i").alias("ord"), "value").unionByName(each.select(F.lit(1).alias("section"), F.concat(name, F.lit("\x02"), "i").alias("ord"), "value"))


def cost_report_json(calls: DataFrame, summary: DataFrame, pricing: DataFrame) -> DataFrame:
    """(document_name, value): the cost report of each document as JSON: totals, its calls in order, the price list."""
    prices = pricing.agg(F.map_from_entries(F.collect_list(F.struct("model", F.struct(F.col("input_usd").alias("input"), F.col("output_usd").alias("output"))))).alias("models"))
    listed = calls.groupBy("document_name").agg(F.array_sort(F.collect_list(F.struct("usage_id", "segment_id", "model", "input_tokens", "output_tokens", "input_cost", "output_cost", "total_cost", "page_start", "page_end", "page_span"))).alias("per_segment_usage"))
    totals = summary.select("document_name", F.struct("n_calls", "input_tokens", "output_tokens", "total_tokens", "input_cost", "output_cost", "total_cost", "models", "avg_cost").alias("summary"))
    t = totals.join(listed, "document_name").join(F.broadcast(prices.select(F.struct("models").alias("pricing_reference"))), F.lit(True))
    return t.select("document_name", F.to_json(F.struct("document_name", "summary", "per_segment_usage", "pricing_reference")).alias("value"))


def comparison_report(comparison: DataFrame, insights: DataFrame) -> DataFrame:
    """(section, ord, value): both methods side by side and what follows from it."""
    table = comparison.select(F.lit(1).alias("section"), F.concat(F.lit("1"), "metric").alias("ord"), F.format_string("%-24s %18.6f %18.6f %+18.6f", "metric", "baseline", "guided", "difference").alias("value"))
    said = insights.select(F.lit(2).alias("section"), F.concat(F.lit("1"), "metric").alias("ord"), F.format_string("%s: the %s method is better by %.4f", "metric", "winner", "lead").alias("value"))
    return union_all([_head(comparison, 1, "COST COMPARISON", f"{'Metric':<24} {'Baseline':>18} {'Guided':>18} {'Difference':>18}"), table, _head(comparison, 2, "KEY INSIGHTS"), said])


def failures_table(failed: DataFrame) -> DataFrame:
    """Failed entities under the names of the report's columns."""
    return failed.select(F.col("doc_id").alias("Document"), F.col("entity_id").alias("Entity_ID"), F.col("entity_type").alias("Entity_Type"), F.col("entity_label").alias("Entity_Label"), F.col("failure_reason").alias("Failure_Reason"))
