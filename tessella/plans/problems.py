"""Queries of the general data problems 2, 4, 5 and 7, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import hierarchy, intervals, nested, orphans
from tessella.session import load


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(load(spark, d, "kg_relationships")).select("doc_id", "node_id", "root_id", "depth")


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    tree = hierarchy.hierarchy(load(spark, d, "kg_relationships"), paths=True)
    return tree.select("doc_id", "node_id", "depth", F.array_join("path", " > ").alias("path"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(load(spark, d, "kg_relationships"))


def p2_closure(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.closure(hierarchy.hierarchy(load(spark, d, "kg_relationships"), paths=True))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    state, _ = orphans.replay(load(spark, d, "kg_entities"), load(spark, d, "kg_relationships"))
    return state.open_refs().select("rel_id", "endpoint")


def p4_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return orphans.snapshots(load(spark, d, "kg_relationships"), load(spark, d, "kg_entities"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.payload_rows(load(spark, d, "kg_payloads"))


def p5_levels(spark: SparkSession, d: str) -> DataFrame:
    return nested.level_counts(load(spark, d, "kg_payloads"))


def _fields(spark: SparkSession, d: str, level: tuple[str, ...]) -> DataFrame:
    return nested.read_payloads(load(spark, d, "kg_payloads")).table(level)


def p5_entities(spark: SparkSession, d: str) -> DataFrame:
    return _fields(spark, d, nested.ENTITIES)


def p5_relationships(spark: SparkSession, d: str) -> DataFrame:
    return _fields(spark, d, nested.RELATIONSHIPS)


def p5_provenance(spark: SparkSession, d: str) -> DataFrame:
    return _fields(spark, d, nested.PROVENANCE)


def p5_inputs(spark: SparkSession, d: str) -> DataFrame:
    return _fields(spark, d, nested.INPUTS)


def p5_disaggregations(spark: SparkSession, d: str) -> DataFrame:
    return _fields(spark, d, nested.DISAGGREGATIONS)


def p5_members(spark: SparkSession, d: str) -> DataFrame:
    return _fields(spark, d, nested.MEMBERS)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.page_periods(load(spark, d, "doc_segments"))


def p7_totals(spark: SparkSession, d: str) -> DataFrame:
    out = intervals.page_periods(load(spark, d, "doc_segments"))
    pages = F.sum(F.col("page_to").cast("long") - F.col("page_from") + 1)
    return out.groupBy("doc_id", "run_id", "kind").agg(F.count(F.lit(1)).alias("n"), pages.alias("pages"))


QUERIES = {f.__name__: f for f in (p2_found, p2_paths, p2_descendants, p2_closure, p4_found, p4_snapshot, p5_found, p5_levels, p5_entities, p5_relationships, p5_provenance, p5_inputs, p5_disaggregations, p5_members, p7_found, p7_totals)}

_LINKS = """links AS (SELECT doc_id, object AS node, min(subject) AS parent FROM kg_relationships
  WHERE subject <> '' AND object <> ''
    AND regexp_replace(lower(predicate), '[^a-z0-9]', '', 'g') IN ('reportusing', 'include', 'consistof', 'iscalculatedby', 'requiresinputfrom')
  GROUP BY doc_id, object),
nodes AS (SELECT doc_id, node FROM links UNION SELECT doc_id, parent FROM links),
walk AS (
  SELECT n.doc_id, n.node, n.node AS root, 0 AS depth, n.node AS path FROM nodes n
  WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.doc_id = n.doc_id AND l.node = n.node)
  UNION ALL
  SELECT l.doc_id, l.node, w.root, w.depth + 1, w.path || ' > ' || l.node FROM walk w JOIN links l ON l.doc_id = w.doc_id AND l.parent = w.node)"""

_REFS = """ends AS (
  SELECT rel_id, 'subject' AS endpoint, doc_id, subject AS ref_id, ingested_at FROM kg_relationships
  UNION ALL SELECT rel_id, 'object', doc_id, object, ingested_at FROM kg_relationships),
refs AS (SELECT * FROM ends WHERE ref_id IS NOT NULL AND trim(ref_id) <> ''),
parents AS (
  SELECT doc_id, id AS ref_id, min(ingested_at) FILTER (op = 'upsert') AS first_upsert,
         arg_max(op, (ingested_at, rec_id)) AS last_op
  FROM kg_entities WHERE id IS NOT NULL GROUP BY doc_id, id),
probed AS (
  SELECT r.rel_id, r.endpoint, r.ingested_at, CASE WHEN p.first_upsert IS NULL THEN 'missing' WHEN p.last_op = 'delete' THEN 'deleted'
    WHEN p.first_upsert <= r.ingested_at THEN 'resolved' ELSE 'late' END AS status
  FROM refs r LEFT JOIN parents p USING (doc_id, ref_id))"""

_SWEEP = """e AS (
  SELECT doc_id, run_id, x, sum(d) AS d FROM (
    SELECT doc_id, run_id, page_start::BIGINT AS x, 1 AS d FROM doc_segments WHERE page_start <= page_end
    UNION ALL SELECT doc_id, run_id, page_end::BIGINT + 1, -1 FROM doc_segments WHERE page_start <= page_end)
  GROUP BY ALL HAVING sum(d) <> 0),
c AS (SELECT *, sum(d) OVER (PARTITION BY doc_id, run_id ORDER BY x) AS after FROM e),
t AS (SELECT doc_id, run_id, x, after > 0 AS opens FROM c WHERE (after = 0) <> (after - d = 0)),
n AS (SELECT *, lead(x) OVER (PARTITION BY doc_id, run_id ORDER BY x) AS nx FROM t),
spans AS (SELECT doc_id, run_id, CASE WHEN opens THEN 'period' ELSE 'gap' END AS kind, x::INTEGER AS page_from, (nx - 1)::INTEGER AS page_to FROM n WHERE nx IS NOT NULL)"""



def _items(x: str) -> str:
    """A JSON list as it is, a single value as a list of one."""
    return f"CASE WHEN {x} IS NULL OR json_type({x}) = 'NULL' THEN CAST([] AS JSON[]) WHEN json_type({x}) = 'ARRAY' THEN CAST({x} AS JSON[]) ELSE [{x}] END"


def _level(name: str, source: str, keys: str, value: str, pos: str, objects: bool = False) -> str:
    kept = "json_type(v) = 'OBJECT'" if objects else "v IS NOT NULL AND json_type(v) <> 'NULL'"
    return f"""{name} AS (SELECT * FROM (SELECT {keys}, (generate_subscripts(l, 1) - 1)::INTEGER AS {pos}, unnest(l) AS v FROM (SELECT {keys}, {_items(value)} AS l FROM {source})) WHERE {kept})"""


READ = r"""ans AS (SELECT payload_id, doc_id, payload, CASE WHEN json_valid(payload) THEN CASE WHEN json_type(payload) = 'OBJECT' THEN payload END END AS a,
  nullif(regexp_extract(payload, '(?s)```(?:json)?\s*(.*?)\s*```', 1), '') AS f, nullif(regexp_extract(payload, '(?s)\{.*\}', 0), '') AS b FROM kg_payloads),
rd AS (SELECT payload_id, doc_id, payload, coalesce(a, CASE WHEN json_valid(f) THEN CASE WHEN json_type(f) = 'OBJECT' THEN f END END, CASE WHEN json_valid(b) THEN CASE WHEN json_type(b) = 'OBJECT' THEN b END END) AS a FROM ans),
gr AS (SELECT payload_id, doc_id, a, CASE WHEN base IS NOT NULL THEN CASE WHEN json_type(base) = 'OBJECT' THEN base END WHEN json_extract(a, '$.entities') IS NOT NULL THEN CAST(a AS JSON) END AS g, base IS NOT NULL AS baseline
  FROM (SELECT *, json_extract(a, '$.experiments."2_baseline_llm"') AS base FROM rd WHERE a IS NOT NULL))"""
_NESTED = f"""{READ},
{_level("e", "gr", "payload_id", "json_extract(g, '$.entities')", "pos1", True)},
{_level("r", "gr", "payload_id", "json_extract(g, '$.relationships')", "pos1", True)},
{_level("p", "e", "payload_id, pos1", "json_extract(v, '$.provenance')", "pos2")},
pr AS (SELECT payload_id, pos1, CASE json_type(x) WHEN 'OBJECT' THEN x WHEN 'VARCHAR' THEN CASE WHEN json_valid(x ->> '$') THEN CASE WHEN json_type(x ->> '$') = 'OBJECT' THEN CAST(x ->> '$' AS JSON) END END END AS x
  FROM (SELECT payload_id, pos1, json_extract(v, '$.properties') AS x FROM e)),
{_level("i", "pr", "payload_id, pos1", "json_extract(x, '$.input_variables')", "pos2")},
{_level("d", "pr", "payload_id, pos1", "json_extract(x, '$.disaggregations')", "pos2")},
{_level("m", "d", "payload_id, pos1, pos2", "CASE WHEN json_type(v) = 'OBJECT' THEN json_extract(v, '$.members') END", "pos3")},
found AS (SELECT payload_id, 'entity' AS kind, pos1, -1 AS pos2, -1 AS pos3 FROM e UNION ALL SELECT payload_id, 'relationship', pos1, -1, -1 FROM r UNION ALL SELECT payload_id, 'provenance', pos1, pos2, -1 FROM p
  UNION ALL SELECT payload_id, 'input_variable', pos1, pos2, -1 FROM i UNION ALL SELECT payload_id, 'disaggregation', pos1, pos2, -1 FROM d UNION ALL SELECT payload_id, 'disaggregation_member', pos1, pos2, pos3 FROM m)"""
# levels that the contract does not name; one is a level if it holds a list anywhere
_G1 = """json_extract(g, '$.experiments."1_ontology_guided".{0}')"""
_OTHERS = f"""{_level("q", "gr", "payload_id", "json_extract(g, '$.qa_log')", "pos1")},
{_level("xr", "gr", "payload_id", _G1.format("relationships"), "pos1")},
{_level("xe", "gr", "payload_id", _G1.format("entities"), "pos1")},
{_level("xp", "xe", "payload_id, pos1", "json_extract(v, '$.provenance')", "pos2")},
xpr AS (SELECT payload_id, pos1, CASE json_type(x) WHEN 'OBJECT' THEN x WHEN 'VARCHAR' THEN CASE WHEN json_valid(x ->> '$') THEN CASE WHEN json_type(x ->> '$') = 'OBJECT' THEN CAST(x ->> '$' AS JSON) END END END AS x
  FROM (SELECT payload_id, pos1, json_extract(v, '$.properties') AS x FROM xe)),
{_level("xi", "xpr", "payload_id, pos1", "json_extract(x, '$.input_variables')", "pos2")},
{_level("xd", "xpr", "payload_id, pos1", "json_extract(x, '$.disaggregations')", "pos2")},
{_level("xm", "xd", "payload_id, pos1, pos2", "CASE WHEN json_type(v) = 'OBJECT' THEN json_extract(v, '$.members') END", "pos3")},
others AS ({" UNION ALL ".join(f"SELECT payload_id, '{name}' AS level FROM {view} WHERE (SELECT bool_or(json_type({value}) = 'ARRAY') FROM {source})" for name, view, value, source in (
    ("qa_log", "q", "json_extract(g, '$.qa_log')", "gr"), ("experiments.1_ontology_guided.relationships", "xr", _G1.format("relationships"), "gr"), ("experiments.1_ontology_guided.entities", "xe", _G1.format("entities"), "gr"),
    ("experiments.1_ontology_guided.entities.provenance", "xp", "json_extract(v, '$.provenance')", "xe"), ("experiments.1_ontology_guided.entities.properties.input_variables", "xi", "json_extract(x, '$.input_variables')", "xpr"),
    ("experiments.1_ontology_guided.entities.properties.disaggregations", "xd", "json_extract(x, '$.disaggregations')", "xpr"), ("experiments.1_ontology_guided.entities.properties.disaggregations.members", "xm", "json_extract(v, '$.members')", "xd"),
))})"""

ORACLE = {
    "p5_found": f"WITH {_NESTED} SELECT * FROM found",
    "p5_levels": f"WITH {_NESTED}, {_OTHERS} SELECT level, count(*) AS n_rows, count(DISTINCT payload_id) AS n_payloads FROM (SELECT payload_id, CASE kind WHEN 'entity' THEN 'entities' WHEN 'relationship' THEN 'relationships' WHEN 'provenance' THEN 'entities.provenance' WHEN 'input_variable' THEN 'entities.properties.input_variables' WHEN 'disaggregation' THEN 'entities.properties.disaggregations' ELSE 'entities.properties.disaggregations.members' END AS level FROM found UNION ALL SELECT payload_id, level FROM others) GROUP BY level",
    "p2_found": f"WITH RECURSIVE {_LINKS} SELECT n.doc_id, n.node AS node_id, coalesce(w.root, '') AS root_id, coalesce(w.depth, -1)::INTEGER AS depth FROM nodes n LEFT JOIN walk w USING (doc_id, node)",
    "p2_paths": f"WITH RECURSIVE {_LINKS} SELECT n.doc_id, n.node AS node_id, coalesce(w.depth, -1)::INTEGER AS depth, w.path FROM nodes n LEFT JOIN walk w USING (doc_id, node)",
    "p2_descendants": f"""WITH RECURSIVE {_LINKS}, up AS (SELECT doc_id, depth, string_split(path, ' > ') AS p FROM walk),
each AS (SELECT doc_id, depth, unnest(p) AS node_id, generate_subscripts(p, 1) - 1 AS lvl FROM up)
SELECT doc_id, node_id, (count(*) - 1)::BIGINT AS n_descendants, max(depth - lvl)::INTEGER AS height FROM each GROUP BY ALL""",
    "p2_closure": f"""WITH RECURSIVE {_LINKS}, below AS (
  SELECT doc_id, parent AS ancestor_id, node AS node_id, 1 AS distance FROM links WHERE EXISTS (SELECT 1 FROM walk w WHERE w.doc_id IS NOT DISTINCT FROM links.doc_id AND w.node = links.node)
  UNION ALL SELECT b.doc_id, b.ancestor_id, l.node, b.distance + 1 FROM below b JOIN links l ON l.doc_id IS NOT DISTINCT FROM b.doc_id AND l.parent = b.node_id)
SELECT doc_id, ancestor_id, node_id, distance::INTEGER AS distance FROM below""",
    "p4_found": f"WITH {_REFS} SELECT rel_id, endpoint FROM probed WHERE status <> 'resolved'",
    # the same as if each period were the last one
    "p4_snapshot": """WITH ends AS (SELECT rel_id, 'subject' AS endpoint, doc_id, subject AS ref_id, ingested_at FROM kg_relationships UNION ALL SELECT rel_id, 'object', doc_id, object, ingested_at FROM kg_relationships),
refs AS (SELECT *, date_trunc('quarter', ingested_at) AS q FROM ends WHERE ref_id IS NOT NULL AND trim(ref_id) <> ''),
ents AS (SELECT *, date_trunc('quarter', ingested_at) AS q FROM kg_entities WHERE id IS NOT NULL),
cuts AS (SELECT DISTINCT q FROM (SELECT date_trunc('quarter', ingested_at) AS q FROM kg_entities UNION ALL SELECT date_trunc('quarter', ingested_at) FROM kg_relationships)),
parents AS (SELECT c.q, doc_id, id AS ref_id, min(ingested_at) FILTER (op = 'upsert') AS first_upsert, arg_max(op, (ingested_at, rec_id)) AS last_op FROM cuts c JOIN ents e ON e.q <= c.q GROUP BY ALL),
probed AS (SELECT c.q, r.endpoint, r.ingested_at, CASE WHEN p.first_upsert IS NULL THEN 'missing' WHEN p.last_op = 'delete' THEN 'deleted' WHEN p.first_upsert <= r.ingested_at THEN 'resolved' ELSE 'late' END AS status
  FROM cuts c JOIN refs r ON r.q <= c.q LEFT JOIN parents p ON p.q = c.q AND p.doc_id = r.doc_id AND p.ref_id = r.ref_id)
SELECT strftime(q, '%Y-%m-%d') AS as_of, endpoint, strftime(ingested_at, '%Y-%m') AS period, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'late') AS late, count(*) FILTER (status = 'deleted') AS deleted, count(*) AS "references" FROM probed GROUP BY ALL""",
    "p7_found": f"WITH {_SWEEP} SELECT * FROM spans",
    "p7_totals": f"WITH {_SWEEP} SELECT doc_id, run_id, kind, count(*) AS n, sum(page_to::BIGINT - page_from + 1)::BIGINT AS pages FROM spans GROUP BY ALL",
}
