"""Sources: graph files in both envelopes, segments, metadata, cost reports, pages, prompts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.nested import as_list, as_object, choose_graph, field_of, read_json
from tessella.session import ship

# The ends of graph file names; the last one is that of older files.
SUFFIXES = ["ontology_guided", "baseline_llm", "knowledge"]
TABLE = "struct<page:int,table_id:string,headers:array<string>,rows:array<array<string>>,pages:array<int>,last_page:int>"
SEGMENT_SCHEMA = f"segment_id string, section_title string, section_number string, page_start int, page_end int, content string, has_tables boolean, tables array<{TABLE}>"
PageReader = Callable[[bytes], list[tuple[str, list]]]


def _named(df: DataFrame, suffix: str) -> DataFrame:
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), rf"_({suffix})\.json$", "")
    return df.withColumn("doc_id", F.url_decode(name))


def graph_files(spark: SparkSession, folder: str, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """(doc_id, method, answer) of all graph files of a folder; an unreadable file has a null answer, it
    does not fail the job. The suffix of the name tells the method."""
    raw = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", "*_{" + ",".join(suffixes) + "}.json").load(folder)
    method = F.regexp_extract("_metadata.file_path", r"_(" + "|".join(suffixes) + r")\.json$", 1)
    return _named(raw.withColumn("method", method), "|".join(suffixes)).select("doc_id", "method", read_json(F.col("value")).alias("answer"))


def graph_tables(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relationships, failures): both tables keyed by document, method and position; failures
    name the files whose envelope is not known."""
    g = files.select("doc_id", "method", choose_graph(F.col("answer")).alias("g"))
    text = lambda v, k: F.try_variant_get(v, f"$.{k}", "string").alias(k)
    e = g.select("doc_id", "method", F.posexplode(as_list(field_of(F.col("g"), "entities"))).alias("pos", "v")).where(as_object(F.col("v")).isNotNull())
    e = e.select("doc_id", "method", "pos", text(F.col("v"), "id"), text(F.col("v"), "type"), text(F.col("v"), "label"), as_object(field_of(F.col("v"), "properties")).alias("props"),
                 F.try_variant_get("v", "$.source", "struct<doc_id:string,page:int,start:int,end:int,quote:string>").alias("source"), F.try_variant_get("v", "$.provenance", "map<string,string>").alias("provenance"))
    r = g.select("doc_id", "method", F.posexplode(as_list(field_of(F.col("g"), "relationships"))).alias("pos", "v")).where(as_object(F.col("v")).isNotNull())
    r = r.select("doc_id", "method", "pos", text(F.col("v"), "subject"), text(F.col("v"), "predicate"), text(F.col("v"), "object"))
    return e, r, g.where("g is null").select("doc_id", "method", F.lit("unknown envelope").alias("error"))


def segment_files(spark: SparkSession, folder: str) -> DataFrame:
    raw = spark.read.schema(SEGMENT_SCHEMA).option("multiLine", True).option("pathGlobFilter", "*_segments.json").json(folder)
    return _named(raw, "segments")


def metadata_files(spark: SparkSession, folder: str) -> DataFrame:
    schema = "document_name string, title string, total_pages int, total_segments int, processing_timestamp string, sections array<struct<number:string,title:string,pages:string,word_count:int,table_count:int>>"
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*_metadata.json").json(folder)


USAGE = "timestamp string, segment_id string, model string, input_tokens long, output_tokens long, input_cost_usd double, output_cost_usd double, total_cost_usd double, page_start int, page_end int, page_span int"


def cost_reports(spark: SparkSession, folder: str, suffix: str = "ontology_guided_cost_report") -> DataFrame:
    """One row per call of all cost reports of a method; the suffix is cut from the name in the report."""
    schema = f"document_name string, report_timestamp string, per_segment_usage array<struct<{', '.join(c.replace(' ', ':', 1) for c in USAGE.split(', '))}>>"
    raw = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", f"*_{suffix}.json").json(folder)
    return raw.select(F.regexp_replace("document_name", r"_(ontology_guided|baseline)$", "").alias("document_name"), F.posexplode("per_segment_usage").alias("call_no", "u")).select("document_name", "call_no", "u.*")


def files_in(spark: SparkSession, folder: str, glob: str) -> tuple[bool, str | None]:
    """Whether a folder holds files of a pattern, else what is wrong with it: a value, not an exception."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return False, "Directory not found"
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, glob))
    return (True, None) if found is not None and len(found) else (False, "No files found")


PAGE = "doc_id string, page_num int, text string, tables array<array<array<string>>>, error string"


def page_files(spark: SparkSession, folder: str, reader: PageReader, glob: str = "*.pdf") -> DataFrame:
    """(doc_id, page_num, text, tables, error) of binary documents by a pluggable ``reader`` of bytes, which gives the
    text and the raw tables of each page.

    A document that cannot be read gives one row with its error instead of failing the job; a folder
    that is missing or holds no such file gives a single row without a document (see :func:`batch_result`)."""
    ship(spark)
    ok, error = files_in(spark, folder, glob)
    if not ok:
        return spark.createDataFrame([(None, None, None, None, error)], PAGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.string()), ("page_num", pa.int32()), ("text", pa.string()), ("tables", pa.list_(pa.list_(pa.list_(pa.string())))), ("error", pa.string())])
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                name = unquote(path.rsplit("/", 1)[-1].rsplit(".", 1)[0])
                try:
                    out = [(name, i, text, tables, None) for i, (text, tables) in enumerate(reader(bytes(content)))]
                except Exception as e:  # noqa: BLE001 - one bad document must not fail the job
                    out = [(name, None, None, None, str(e))]
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "content")
    return files.mapInArrow(run, PAGE)


def batch_result(pages: DataFrame) -> DataFrame:
    """(success, total_files, successful, failed, error) of a batch of documents in one row."""
    per = pages.groupBy("doc_id").agg(F.max("error").alias("error"))
    g = per.agg(F.count("doc_id").alias("total_files"), F.count_if(F.col("doc_id").isNotNull() & F.col("error").isNull()).alias("successful"), F.count_if(F.col("doc_id").isNotNull() & F.col("error").isNotNull()).alias("failed"), F.max(F.when(F.col("doc_id").isNull(), F.col("error"))).alias("error"))
    return g.select(F.col("error").isNull().alias("success"), "total_files", "successful", "failed", "error")


def template_file(spark: SparkSession, path: str) -> str:
    """A prompt template, as it stands in its file."""
    return spark.read.text(path, wholetext=True).first()[0]


@dataclass(frozen=True)
class Settings:
    """How to reach a model. ``error`` says why there is none; validation then runs with an open gate."""

    api_key: str = field(default="", repr=False)
    model: str = ""
    max_tokens: int = 200
    temperature: float = 0.0
    error: str | None = None


def provider_settings(path: str) -> Settings:
    """The settings of a configuration file; a missing or unreadable one, or one without a key, is no exception."""
    try:
        with open(path, encoding="utf-8") as f:
            api = json.load(f).get("api_settings", {})
    except (OSError, ValueError, AttributeError) as e:
        return Settings(error=f"Failed to load configuration: {e}")
    if not api.get("api_key"):
        return Settings(error="No API key in configuration")
    return Settings(api["api_key"], api.get("model", ""), int(api.get("max_tokens", 200)), float(api.get("temperature", 0)))


def validated_files(spark: SparkSession, folder: str) -> DataFrame:
    """(document_name, original_entities, validated_entities, semantic_validation_cost, semantic_accuracy,
    schema_compliance) of validated files; what a file does not say is 0."""
    raw = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", "*_validated.json").load(folder)
    m = F.try_variant_get(F.try_parse_json("value"), "$.validation_metadata", "variant")
    n = lambda path, kind: F.coalesce(F.try_variant_get("m", path, kind), F.lit(0).cast(kind))
    named = _named(raw, "validated").select(F.col("doc_id").alias("document_name"), m.alias("m"))
    return named.select(
        "document_name", n("$.original_entity_count", "long").alias("original_entities"), n("$.validated_entity_count", "long").alias("validated_entities"), n("$.semantic_validation.llm_cost", "double").alias("semantic_validation_cost"),
        n("$.quality_metrics.semantic_type_accuracy", "double").alias("semantic_accuracy"), n("$.quality_metrics.schema_compliance_weighted", "double").alias("schema_compliance"),
    )


def register_views(spark: SparkSession, sf_dir: str, tables: list[str]) -> None:
    """Temp views of the input tables, so that all of this is open to SQL as well."""
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
