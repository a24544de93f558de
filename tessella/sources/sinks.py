"""Sinks: JSON, text, CSV and RDF of the validated graph and its reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import title, word_count

# Fixed value: the namespace of the ontology.
BASE = "http://example.org/esg-ontology#"
RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
RDFS_LABEL = "<http://www.w3.org/2000/01/rdf-schema#label>"


def _uri(name: Column, base: str) -> Column:
    return F.concat(F.lit(f"<{base}"), F.url_encode(name), F.lit(">"))


def _literal(text: Column) -> Column:
    t = F.regexp_replace(text, r"\\", r"\\\\")
    for raw, esc in (('"', r'\\"'), ("\n", r"\\n"), ("\r", r"\\r"), ("\t", r"\\t")):
        t = F.regexp_replace(t, raw, esc)
    return F.concat(F.lit('"'), t, F.lit('"'))


def ntriples(triples: DataFrame, base: str = BASE) -> DataFrame:
    """(doc_id, value): one N-Triples line per triple, which is Turtle as well."""
    p = F.when(F.col("p") == "rdf:type", F.lit(RDF_TYPE)).when(F.col("p") == "rdfs:label", F.lit(RDFS_LABEL)).otherwise(_uri(F.regexp_replace("p", "^esg:", ""), base))
    o = F.when(F.col("o_kind") == "uri", _uri(F.col("o"), base)).otherwise(_literal(F.col("o")))
    return triples.select("doc_id", F.concat_ws(" ", _uri(F.col("s"), base), p, o, F.lit(".")).alias("value"))


def write_rdf(triples: DataFrame, path: str, base: str = BASE) -> None:
    """A folder per document of N-Triples files; documents are spread over tasks by their lines. Of graph files only
    those of the guided method are meant for it (``method = 'ontology_guided'``)."""
    if "method" in triples.columns:
        triples = triples.where("method = 'ontology_guided'").drop("method")
    ntriples(triples, base).write.mode("overwrite").partitionBy("doc_id").text(path)


def validated_json(ents: DataFrame, rels: DataFrame, metadata: DataFrame) -> DataFrame:
    """One line per entity, relationship and metadata record of every document that keeps an entity."""
    e = ents.select("doc_id", F.lit("entity").alias("part"), F.to_json(F.struct("id", "type", "label", F.to_json("props").alias("properties"), "source", "provenance")).alias("value"))
    r = rels.select("doc_id", F.lit("relationship").alias("part"), F.to_json(F.struct("subject", "predicate", "object")).alias("value"))
    m = metadata.select("doc_id", F.lit("metadata").alias("part"), F.to_json("validation_metadata").alias("value"))
    keep = metadata.select("doc_id")
    return m.unionByName(e.join(keep, "doc_id", "left_semi")).unionByName(r.join(keep, "doc_id", "left_semi"))


def segments_json(sections: DataFrame) -> DataFrame:
    """(doc_id, value): the segments of each document as one JSON array, in order."""
    s = F.struct("segment_id", F.col("title").alias("section_title"), F.col("number").alias("section_number"), "page_start", "page_end", "content", "has_tables", "tables")
    g = sections.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(F.col("number").cast("int").alias("k"), s.alias("s")))).alias("l"))
    return g.select(F.col("doc").cast("string").alias("doc_id"), F.to_json(F.transform("l", lambda x: x["s"])).alias("value"))


def metadata_json(sections: DataFrame, docs: DataFrame, now: str) -> DataFrame:
    """(doc_id, value): structure and overview of each document: title, totals and its sections in order."""
    s = F.struct("number", "title", F.format_string("%d-%d", "page_start", "page_end").alias("pages"), word_count(F.col("content")).alias("word_count"), F.size("tables").alias("table_count"))
    g = sections.groupBy("doc").agg(F.count(F.lit(1)).alias("total_segments"), F.array_sort(F.collect_list(F.struct(F.col("number").cast("int").alias("k"), s.alias("s")))).alias("l"))
    head = docs.select("doc", title(F.get("pages", 0)).alias("title"), F.size("pages").alias("total_pages"))
    name = F.col("doc").cast("string")
    row = F.struct(name.alias("document_name"), "title", "total_pages", "total_segments", F.lit(now).alias("processing_timestamp"), F.transform("l", lambda x: x["s"]).alias("sections"))
    return g.join(head, "doc").select(name.alias("doc_id"), F.to_json(row).alias("value"))


def experiments_json(results: DataFrame, now: str) -> DataFrame:
    """(doc_id, value): the results of all experiments of each document as one JSON object; a failed experiment has
    its name and status only."""
    ok = F.struct("name", "description", "entities", "relationships", F.size("entities").alias("entity_count"), F.size("relationships").alias("relationship_count"))
    one = F.when(F.col("failed"), F.to_json(F.struct("name", F.lit("failed").alias("status")))).otherwise(F.to_json(ok))
    g = results.withColumn("one", one).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("experiment", "one"))).alias("l"))
    g = g.select("doc_id", F.map_from_entries(F.transform("l", lambda x: F.struct(x["experiment"], F.parse_json(x["one"])))).alias("experiments"))
    return g.select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("document"), F.lit(now).alias("timestamp"), "experiments")).alias("value"))


def write_json_files(df: DataFrame, path: str) -> None:
    """One JSON text per document, in a folder of its own (doc_id=...)."""
    df.write.mode("overwrite").partitionBy("doc_id").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A report of bounded size as one file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def segment_summary(segments: DataFrame) -> DataFrame:
    """(doc_id, value): a text line per segment, in order."""
    return segments.select("doc_id", "segment_id", F.format_string("%s  pages %s-%s  %s %s", F.coalesce("segment_id", F.lit("?")), F.coalesce(F.col("page_start").cast("string"), F.lit("?")), F.coalesce(F.col("page_end").cast("string"), F.lit("?")), F.coalesce("section_number", F.lit("")), F.coalesce("section_title", F.lit(""))).alias("value"))
