"""Extraction: prompts, provider calls, reading of answers, flattening over segments."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import strip
from tessella.operators.nested import as_list, as_object, choose_graph, field_of, read_answers
from tessella.session import stage

Provider = Callable[[str], str]
CONTENT_CHARS = 6000
TEMPLATE = "Document: {document_name}\nSection: {section_title}\n\n{content}"


def long_enough(segments: DataFrame, least: int = 100) -> DataFrame:
    """Segments of at least ``least`` characters, white space around them aside."""
    return segments.where(F.length(strip(F.coalesce("content", F.lit("")))) >= least)


def prompts(segments: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """The prompt of each segment. Placeholders are filled in order, so one inside a title is filled too."""
    t = F.replace(F.lit(template), F.lit("{document_name}"), F.coalesce("doc_id", F.lit("")))
    t = F.replace(t, F.lit("{section_title}"), F.coalesce("section_title", F.lit("")))
    t = F.replace(t, F.lit("{content}"), F.substring(F.coalesce("content", F.lit("")), 1, CONTENT_CHARS))
    return long_enough(segments).select("seg_uid", "doc_id", t.alias("prompt"))


def call_provider(prompted: DataFrame, provider: Provider, parallelism: int, pause: float = 0.5) -> DataFrame:
    """Answers of an external model, staged before anything reads them, so a retry of later steps never
    calls again. ``parallelism`` is explicit: no more calls run at once than the quota allows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            answers, errors = [], []
            for p in f["prompt"]:
                try:
                    answers.append(provider(p))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - one bad call must not fail the job
                    answers.append(None)
                    errors.append(str(e))
                time.sleep(pause)
            yield pd.DataFrame({"seg_uid": f["seg_uid"], "doc_id": f["doc_id"], "answer": answers, "error": errors})

    asked = prompted.repartition(parallelism)
    return stage(asked.mapInPandas(run, "seg_uid long, doc_id string, answer string, error string"), "answers")


# The experiments of a document, by id: name and description.
EXPERIMENTS = {
    "1_ontology_guided": ("Ontology-Guided Extraction", "Extraction with the whole guidance of the ontology"),
    "2_baseline_llm": ("Baseline (Unconstrained)", "Unconstrained extraction without ontology schema"),
}


def answer_tables(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relationships) of provider answers (seg_uid, doc_id, answer), all segments together and without
    removing repeats; an answer that cannot be read has none."""
    read = read_answers(answers.withColumnRenamed("seg_uid", "payload_id"), "answer", "graph")
    return graph_rows(stage(read.select("payload_id", "doc_id", "graph"), "answer-graphs").where("graph is not null"))


def experiments(guided: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc_id, experiment, name, description, entities, relationships, failed): both experiments of each document.

    The first takes over the graphs of ``guided`` (doc_id, graph), none if a document has no file; the second
    gathers the answers of all segments. It fails as a whole if one answer is a JSON list instead of an
    object."""
    items = lambda v, k: F.coalesce(as_list(field_of(v, k)), F.array().cast("array<variant>"))
    names = answers.select("doc_id").distinct()
    first = names.join(guided.select("doc_id", "graph"), "doc_id", "left").select("doc_id", F.lit("1_ontology_guided").alias("experiment"), items(F.col("graph"), "entities").alias("entities"), items(F.col("graph"), "relationships").alias("relationships"), F.lit(False).alias("failed"))
    whole = F.try_variant_get(F.try_parse_json("answer"), "$", "array<variant>").isNotNull()
    read = read_answers(answers.withColumn("_list", whole), "answer", "graph").select("doc_id", "seg_uid", "_list", "graph")
    read = stage(read, "experiment-answers")
    parts = F.array_sort(F.collect_list(F.struct("seg_uid", F.to_json(items(F.col("graph"), "entities")).alias("e"), F.to_json(items(F.col("graph"), "relationships")).alias("r"))))
    gathered = read.groupBy("doc_id").agg(parts.alias("p"), F.max("_list").alias("failed"))
    unite = lambda k: F.flatten(F.transform("p", lambda x: F.try_variant_get(F.parse_json(x[k]), "$", "array<variant>")))
    second = gathered.select("doc_id", F.lit("2_baseline_llm").alias("experiment"), unite("e").alias("entities"), unite("r").alias("relationships"), "failed")
    both = first.unionByName(second)
    label = lambda i: F.coalesce(*[F.when(F.col("experiment") == k, F.lit(x[i])) for k, x in EXPERIMENTS.items()])
    return both.select("doc_id", "experiment", label(0).alias("name"), label(1).alias("description"), "entities", "relationships", "failed")


def batch_summary(results: DataFrame, seconds: float = 0.0) -> DataFrame:
    """One row for a batch: documents, those of which no experiment failed, and what all found."""
    per = results.groupBy("doc_id").agg(F.max("failed").alias("failed"), F.sum(F.size("entities")).alias("e"), F.sum(F.size("relationships")).alias("r"))
    return per.agg(F.lit(True).alias("success"), F.count(F.lit(1)).alias("total_documents"), F.count_if(~F.col("failed")).alias("successful"), F.count_if("failed").alias("failed"), F.coalesce(F.sum("e"), F.lit(0)).alias("entities"), F.coalesce(F.sum("r"), F.lit(0)).alias("relationships"), F.lit(seconds).alias("elapsed_time"))


def answer_kind(payloads: DataFrame) -> DataFrame:
    """How each answer could be read: plain, wrapped (fence or surrounding text) or failed."""
    t = read_answers(payloads, "payload", "v").select("payload_id", "doc_id", F.col("v").isNull().alias("bad"), F.try_parse_json("payload").isNotNull().alias("whole"))
    return t.select("payload_id", "doc_id", F.when(F.col("bad"), "failed").when(F.col("whole"), "plain").otherwise("wrapped").alias("kind"))


def experiment_counts(payloads: DataFrame) -> DataFrame:
    """Per document: payloads by the experiment their graph comes from, and entities at the top of it."""
    t = read_answers(payloads, "payload", "v").select("doc_id", "v", choose_graph(F.col("v")).alias("g"))
    method = F.when(F.col("g").isNull(), "none").when(F.try_variant_get("v", "$.experiments['2_baseline_llm']", "variant").isNotNull(), "baseline").otherwise("guided")
    n = lambda k: F.coalesce(F.size(F.try_variant_get("g", f"$.{k}", "array<variant>")), F.lit(0))
    return t.groupBy(method.alias("method")).agg(F.count(F.lit(1)).alias("n_payloads"), F.sum(n("entities")).cast("long").alias("n_listed"), F.sum(n("relationships")).cast("long").alias("n_rels_listed"))


def stamp_provenance(ents: DataFrame, now: str) -> DataFrame:
    """Provenance of newly extracted entities: document, segment, section and time."""
    return ents.withColumn("provenance", F.create_map(F.lit("document_id"), "doc_id", F.lit("segment_id"), "segment_id", F.lit("section_title"), "section_title", F.lit("extraction_timestamp"), F.lit(now)))


def graph_rows(graphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relationships) of payload graphs (payload_id, doc_id, graph) in the form of the tables of the graph.

    Rows are numbered by their payload and place. Entities and relationships that are no objects are left out."""
    text = lambda k: F.try_variant_get("v", f"$.{k}", "string").alias(k)
    row = (F.col("payload_id") * 2**24 + F.col("pos")).cast("long")

    def rows(name: str) -> DataFrame:
        return graphs.select("payload_id", "doc_id", F.posexplode(as_list(field_of(F.col("graph"), name))).alias("pos", "v")).where(as_object(F.col("v")).isNotNull())

    props = field_of(F.col("v"), "properties")
    kind = F.when(props.isNull(), "absent").when(as_object(props).isNotNull(), "object").otherwise("other")
    ents = rows("entities").select(row.alias("rec_id"), "doc_id", row.alias("pos"), text("id"), text("type"), text("label"), as_object(props).alias("props"), kind.alias("props_kind"), F.try_variant_get("v", "$.source", "variant").alias("source"), F.try_variant_get("v", "$.provenance", "map<string,string>").alias("provenance"))
    rels = rows("relationships").select(row.alias("rel_id"), "doc_id", row.alias("pos"), text("subject"), text("predicate"), text("object"))
    return ents, rels
