"""Queries over the knowledge graph: gate, rules, cascade, report and graph operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import vocab
from tessella.operators import cascade, gate, graph, kg, layout, report, rules
from tessella.session import load, stage
from tessella.sources import reports


def _ents(spark: SparkSession, d: str) -> DataFrame:
    return kg.entities(load(spark, d, "kg_entities"))


def _rels(spark: SparkSession, d: str) -> DataFrame:
    return kg.relationships(load(spark, d, "kg_relationships"))


def _valid(spark: SparkSession, d: str) -> cascade.Validated:
    return cascade.validate(_ents(spark, d), _rels(spark, d))


def _rule_results(spark: SparkSession, d: str) -> DataFrame:
    v = _valid(spark, d)
    return rules.results(v.gated_ids, v.gated_rels)


def _documents(spark: SparkSession, d: str) -> DataFrame:
    v = _valid(spark, d)
    v.ends = stage(v.ends.select("doc_id", "subject", "predicate", "bad", "alive"), "ends")
    return report.documents(v, load(spark, d, "doc_metadata"), rules.results(v.gated_ids, v.gated_rels))


def dedup_entities(spark, d):
    return kg.dedup_entities(_ents(spark, d)).select("rec_id", "doc_id", "id")


def type_gate(spark, d):
    return _ents(spark, d).where(~gate.known_type()).select("rec_id", F.coalesce("type", F.lit("unknown")).alias("type"))


def gate_prompt(spark, d):
    return _ents(spark, d).where(gate.known_type()).select("rec_id", gate.prompt().alias("prompt"))


def gate_accuracy(spark, d):
    return gate.accuracy(gate.judged(_ents(spark, d)))


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    """A table of answers for the named entities: some say no, some do not say, some are missing."""
    ids = load(spark, d, "kg_entities").where("id is not null").select("doc_id", "id").distinct()
    n = F.length("id")
    return ids.where(n % 5 != 0).select("doc_id", "id", F.when(n % 7 != 0, n % 3 != 0).alias("is_correct"), F.concat(F.lit("asked about "), "id").alias("reasoning"))


def verdict_gate(spark, d):
    """The gate by a table of verdicts, with the reasons."""
    g = gate.judged(_ents(spark, d), gate.table_judge(_verdicts(spark, d)))
    return g.select("rec_id", "called", "mismatch", "reasoning")


def gate_entities(spark, d):
    return _valid(spark, d).gated.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("rec_id").alias("id_sum"))


def gate_relationships(spark, d):
    return _valid(spark, d).gated_rels.select("rel_id")


def cascade_entities(spark, d):
    return _valid(spark, d).entities.select("rec_id")


def cascade_relationships(spark, d):
    return _valid(spark, d).rels.select("rel_id")


def cascade_summary(spark, d):
    return cascade.retention(_valid(spark, d))


def vr001(spark, d):
    return rules.duplicate_rows(_valid(spark, d).gated)


def vr002(spark, d):
    f = rules.flags(_valid(spark, d).gated)
    return f.where("vr002").select("rec_id", F.array_join("missing", ",").alias("missing"))


def vr003(spark, d):
    return rules.flags(_valid(spark, d).gated).where("vr003").select("rec_id")


def vr004(spark, d):
    return rules.flags(_valid(spark, d).gated).where("vr004").select("rec_id")


def vr005(spark, d):
    r = _valid(spark, d).gated_rels
    return r.where(~F.coalesce(F.col("predicate"), F.lit("")).isin(vocab.PREDICATES)).select("rel_id", "predicate")


def vr006(spark, d):
    v = _valid(spark, d)
    return rules.unlinked(v.gated, v.gated_rels)


def rule_scores(spark, d):
    return _rule_results(spark, d)


def compliance(spark, d):
    return rules.compliance(_rule_results(spark, d))


def violation_stats(spark, d):
    return cascade.violation_stats(_rule_results(spark, d))


def rule_matrix(spark, d):
    return report.rule_matrix(_rule_results(spark, d))


def segment_retention(spark, d):
    v = _valid(spark, d)
    return cascade.segment_retention(v)


def mean_segment_retention(spark, d):
    v = _valid(spark, d)
    return cascade.mean_segment_retention(cascade.segment_retention(v))


def signature_check(spark, d):
    return rules.signature_violations(_ents(spark, d), _rels(spark, d), vocab.signatures(spark))


def type_distribution(spark, d):
    v = _valid(spark, d)
    return report.type_distribution(v.gate, v.entities)


def predicate_distribution(spark, d):
    return report.predicate_distribution(_valid(spark, d).ends)


def type_counts(spark, d):
    return report.type_counts(_ents(spark, d))


def provenance_coverage(spark, d):
    return report.provenance_coverage(_ents(spark, d))


def document_report(spark, d):
    return _documents(spark, d)


def grand_totals(spark, d):
    return report.grand_totals(_documents(spark, d))


def document_stages(spark, d):
    return report.summary(_valid(spark, d))


def validation_report(spark, d):
    """The lines of the report by section, in no order."""
    v = _valid(spark, d)
    v.ends = stage(v.ends.select("doc_id", "subject", "predicate", "bad", "alive"), "ends")
    return reports.validation_report(v, load(spark, d, "doc_metadata"), rules.results(v.gated_ids, v.gated_rels), _ents(spark, d)).select("section", "value")


def predicate_counts(spark, d):
    return report.predicate_counts(_rels(spark, d))


def report_examples(spark, d):
    v = _valid(spark, d)
    return report.examples(v)


def failed_entities(spark, d):
    v = _valid(spark, d)
    return graph.failed_entities(v)


def failures_per_document(spark, d):
    v = _valid(spark, d)
    return graph.failures_per_document(v)


def metric_merge(spark, d):
    return graph.merge_map(_ents(spark, d), _rels(spark, d))


def edge_redirect(spark, d):
    r = _rels(spark, d)
    return graph.redirect(r, graph.merge_map(_ents(spark, d), r))


def effective_type(spark, d):
    return _ents(spark, d).select("rec_id", graph.effective_type().alias("effective_type"))


def legend(spark, d):
    return graph.legend(_ents(spark, d))


def induced_edges(spark, d):
    return graph.induced(_rels(spark, d), _ents(spark, d)).select("rel_id")


def parent_map(spark, d):
    return graph.parents(_rels(spark, d))


def children_map(spark, d):
    return graph.children(_rels(spark, d))


def category_order(spark, d):
    return graph.drawing_order(_ents(spark, d), _rels(spark, d))


def model_order(spark, d):
    return graph.drawing_order(_ents(spark, d), _rels(spark, d), "Model")


def graph_layout(spark, d):
    return layout.layout(_ents(spark, d), _rels(spark, d))


def triples(spark, d):
    return graph.triples(_ents(spark, d), _rels(spark, d))


_NAMES = """dedup_entities type_gate gate_prompt gate_accuracy verdict_gate gate_entities gate_relationships cascade_entities cascade_relationships
cascade_summary vr001 vr002 vr003 vr004 vr005 vr006 rule_scores compliance violation_stats rule_matrix segment_retention
mean_segment_retention signature_check type_distribution predicate_distribution type_counts provenance_coverage document_report
grand_totals document_stages validation_report predicate_counts report_examples failed_entities failures_per_document metric_merge edge_redirect effective_type legend induced_edges
parent_map children_map category_order model_order graph_layout triples"""
QUERIES = {n: globals()[n] for n in _NAMES.split()}


def _in(names: list[str]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_FALSY = "coalesce(json_type({0}) = 'NULL' OR CAST({0} AS VARCHAR) IN ('null', '\"\"', '[]', '{{}}', '0', '0.0', '-0.0', 'false'), true)"


def _f(name: str) -> str:
    return f"json_extract(props, '$.{name}')"


def _bad(name: str) -> str:
    return f"({_FALSY.format(_f(name))} OR coalesce({_f(name)} ->> '$' = 'N/A', false))"


_ENT = f"""ent AS (
  SELECT rec_id, doc_id, pos, id, type, label, provenance, source IS NULL AS no_source,
    CASE WHEN json_valid(properties) THEN CASE WHEN json_type(properties) = 'OBJECT' THEN properties END END AS props,
    CASE WHEN NOT coalesce(json_valid(properties), false) THEN 'absent' WHEN json_type(properties) = 'NULL' THEN 'null' WHEN json_type(properties) = 'OBJECT' THEN 'object' ELSE 'other' END AS props_kind,
    coalesce(type, 'unknown') IN {_in(vocab.ENTITY_TYPES)} AS known, (length(label) + length(coalesce(id, ''))) % 7 = 3 AS wrong
  FROM kg_entities WHERE op = 'upsert')"""
_GATE = f"""{_ENT},
gate AS (SELECT *, NOT known OR coalesce(wrong, false) AS mismatch, known AND label IS NOT NULL AS called FROM ent),
bad AS (SELECT DISTINCT doc_id, id FROM gate WHERE mismatch AND id <> ''),
gated AS (SELECT * FROM gate g WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.doc_id = g.doc_id AND b.id = g.id)),
grels AS (SELECT * FROM kg_relationships r WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.doc_id = r.doc_id AND b.id = r.subject)
  AND NOT EXISTS (SELECT 1 FROM bad b WHERE b.doc_id = r.doc_id AND b.id = r.object))"""
_VALID = f"""{_GATE},
removal AS (SELECT doc_id, id FROM bad UNION SELECT doc_id, id FROM gated GROUP BY doc_id, id HAVING count(*) > 1),
vent AS (SELECT * FROM gate g WHERE NOT EXISTS (SELECT 1 FROM removal x WHERE x.doc_id = g.doc_id AND x.id IS NOT DISTINCT FROM g.id)),
vids AS (SELECT DISTINCT doc_id, id FROM vent),
vrel AS (SELECT * FROM kg_relationships r WHERE EXISTS (SELECT 1 FROM vids v WHERE v.doc_id = r.doc_id AND v.id IS NOT DISTINCT FROM r.subject)
  AND EXISTS (SELECT 1 FROM vids v WHERE v.doc_id = r.doc_id AND v.id IS NOT DISTINCT FROM r.object))"""

_MISSING = ", ".join(
    [f"CASE WHEN coalesce({c}, '') = '' THEN '{c}' END" for c in ("id", "type", "label")]
    + ["CASE WHEN no_source THEN 'source' END"]
    + [f"CASE WHEN type = '{t}' AND props_kind IN ('object', 'absent') AND {_f(f)} IS NULL THEN 'properties.{f}' END" for t, fs in vocab.REQUIRED_PROPERTIES.items() for f in fs]
    + ["CASE WHEN type = 'Industry' AND props_kind IN ('null', 'other') THEN 'properties' END"]
)
_FLAGS = f"""{_GATE},
flags AS (
  SELECT *, list_filter([{_MISSING}], lambda x: x IS NOT NULL) AS missing,
    coalesce(type = 'Metric' AND (coalesce(({_f("metric_type")} ->> '$') IN ('DirectMetric', 'CalculatedMetric') AND {_bad("code")}, false)
      OR coalesce(({_f("measurement_type")} ->> '$') = 'Quantitative' AND {_bad("unit")}, false)), false) AS vr003,
    coalesce(type = 'Model' AND ({_bad("input_variables")} OR CASE WHEN json_type({_f("input_variables")}) = 'ARRAY'
      THEN len(list_filter(CAST({_f("input_variables")} AS JSON[]), lambda x: NOT {_FALSY.format("x")})) = 0 ELSE false END), false) AS vr004,
    coalesce(type = 'Metric' AND ({_f("metric_type")} ->> '$') = 'CalculatedMetric', false) AS calculated,
    coalesce(type IN {_in(list(vocab.REQUIRED_PROPERTIES))} AND props_kind = 'null', false) AS crash2,
    coalesce(type = 'Metric' AND props_kind IN ('null', 'other'), false) AS crash3, coalesce(type = 'Model' AND props_kind IN ('null', 'other'), false) AS crash4
  FROM gated),
unlinked AS (SELECT f.* FROM flags f WHERE calculated AND NOT EXISTS (SELECT 1 FROM grels r WHERE r.doc_id = f.doc_id AND r.predicate = 'IsCalculatedBy' AND r.subject IS NOT DISTINCT FROM f.id))"""


def _rule(rule: str, bad: str, total: str, crash: str = "false") -> str:
    return f"""SELECT doc_id, '{rule}' AS rule_id, (CASE WHEN {crash} THEN -1 ELSE coalesce({bad}, 0) END)::BIGINT AS violation_count, (CASE WHEN {crash} THEN 0 ELSE coalesce({total}, 0) END)::BIGINT AS total_items FROM doc"""


_SCORES = f"""{_FLAGS},
a AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT coalesce(id, chr(1))) AS v1, count(DISTINCT CASE WHEN len(missing) > 0 THEN coalesce(id, chr(1)) END) AS v2,
  count(DISTINCT CASE WHEN vr003 THEN coalesce(id, chr(1)) END) AS v3, count(*) FILTER (vr004) AS v4, count(*) FILTER (type = 'Metric') AS metrics, count(*) FILTER (type = 'Model') AS models,
  count(*) FILTER (calculated) AS calc, bool_or(crash2) AS c2, bool_or(crash3) AS c3, bool_or(crash4) AS c4 FROM flags GROUP BY doc_id),
u AS (SELECT doc_id, count(*) AS v6 FROM unlinked GROUP BY doc_id),
b AS (SELECT doc_id, count(*) AS rels, count(*) FILTER (coalesce(predicate, '') NOT IN {_in(vocab.PREDICATES)}) AS v5 FROM grels GROUP BY doc_id),
doc AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.* EXCLUDE doc_id, b.* EXCLUDE doc_id, u.v6 FROM a FULL JOIN b ON a.doc_id = b.doc_id LEFT JOIN u ON u.doc_id = a.doc_id),
counted AS ({_rule("VR001", "v1", "n")} UNION ALL {_rule("VR002", "v2", "n", "coalesce(c2, false)")} UNION ALL {_rule("VR003", "v3", "metrics", "coalesce(c3, false)")}
  UNION ALL {_rule("VR004", "v4", "models", "coalesce(c4, false)")} UNION ALL {_rule("VR005", "v5", "rels")} UNION ALL {_rule("VR006", "v6", "calc", "coalesce(c3, false)")}),
scores AS (SELECT *, CASE WHEN total_items > 0 THEN round((total_items - violation_count)::DOUBLE / total_items * 100, 2) ELSE 100.0::DOUBLE END AS score, violation_count = 0 AS passed FROM counted),
comp AS (SELECT doc_id, (2 * sum(round(score * 100)::BIGINT) + count(*)) // (2 * count(*)) / 100.0::DOUBLE AS compliance, count(*) FILTER (NOT passed) AS critical_failures, count(*) FILTER (passed) AS passed_rules, sum(violation_count)::BIGINT AS total_violations,
  CASE WHEN bool_and(passed) THEN 'PASS' ELSE 'FAIL' END AS status FROM scores GROUP BY doc_id)"""
_ACC = "acc AS (SELECT doc_id, count(*) AS n_entities, count(*) FILTER (NOT mismatch) AS n_correct, round(count(*) FILTER (NOT mismatch)::DOUBLE / count(*) * 100, 2) AS accuracy, round(count(*) FILTER (called) * 0.0001::DOUBLE, 4) AS cost_usd FROM gate GROUP BY doc_id)"
_RET = """ret AS (
  SELECT e.doc_id, e.n AS entities_before, coalesce(v.n, 0) AS entities_after, coalesce(r.n, 0) AS rels_before, coalesce(w.n, 0) AS rels_after,
    round(coalesce(v.n, 0)::DOUBLE / e.n * 100, 2) AS entity_retention, CASE WHEN coalesce(r.n, 0) = 0 THEN 0.0::DOUBLE ELSE round(coalesce(w.n, 0)::DOUBLE / r.n * 100, 2) END AS rel_retention
  FROM (SELECT doc_id, count(*) AS n FROM ent GROUP BY doc_id) e LEFT JOIN (SELECT doc_id, count(*) AS n FROM vent GROUP BY doc_id) v USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM kg_relationships GROUP BY doc_id) r USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM vrel GROUP BY doc_id) w USING (doc_id))"""
# the rules look at the gated graph, the cascade at the whole one; both start from the same views
_ALL = _SCORES + "," + _VALID[len(_GATE) + 1 :] + "," + _ACC + "," + _RET
_SEG = f"""WITH {_VALID}, seg AS (
  SELECT a.doc_id, a.segment_id, a.n AS original, coalesce(b.n, 0) AS validated
  FROM (SELECT doc_id, coalesce(provenance['segment_id'], 'unknown') AS segment_id, count(*) AS n FROM ent GROUP BY ALL) a
  LEFT JOIN (SELECT doc_id, coalesce(provenance['segment_id'], 'unknown') AS segment_id, count(*) AS n FROM vent GROUP BY ALL) b USING (doc_id, segment_id))"""
_DOCS = f"""WITH {_ALL},
md AS (SELECT document_name AS doc_id, coalesce(max(total_pages), 0) AS total_pages, coalesce(max(total_segments), 0) AS total_segments FROM doc_metadata GROUP BY 1),
mt AS (SELECT doc_id, count(*) FILTER (type = 'Metric') AS n_metrics FROM ent GROUP BY doc_id),
docs AS (SELECT r.doc_id, coalesce(md.total_pages, 0) AS total_pages, coalesce(md.total_segments, 0) AS total_segments, r.entities_before, r.entities_after, mt.n_metrics, r.rels_before, r.rels_after,
  CASE WHEN r.entities_after > 0 THEN coalesce(comp.compliance, 0.0) ELSE 0.0 END::DOUBLE AS compliance, coalesce(acc.accuracy, 0.0)::DOUBLE AS accuracy,
  CASE WHEN r.entities_after > 0 THEN r.rel_retention ELSE 0.0 END::DOUBLE AS rel_retention, acc.cost_usd
  FROM ret r LEFT JOIN mt USING (doc_id) LEFT JOIN comp USING (doc_id) LEFT JOIN acc USING (doc_id) LEFT JOIN md USING (doc_id))"""
_KIND = f"({_f('metric_type')} ->> '$')"
_EFF = f"CASE WHEN type = 'Metric' AND CASE WHEN {_f('metric_type')} IS NULL THEN 'DirectMetric' ELSE {_KIND} END IN {_in(vocab.METRIC_TYPES)} THEN coalesce({_KIND}, 'DirectMetric') ELSE type END"
_MERGE = rf"""{_ENT},
m AS (SELECT e.doc_id, e.id, e.pos, e.rec_id, regexp_replace(lower(coalesce(label, '')), '^[\t-\r \p{{Z}}]+|[\t-\r \p{{Z}}]+$', '', 'g') AS key, {_KIND} AS kind,
    EXISTS (SELECT 1 FROM kg_relationships r WHERE r.doc_id = e.doc_id AND r.object = e.id AND r.predicate = 'ConsistOf') AS linked FROM ent e WHERE type = 'Metric' AND id IS NOT NULL),
k AS (SELECT *, CASE WHEN kind = 'DirectMetric' AND linked THEN 0 WHEN kind = 'DirectMetric' THEN 1 WHEN kind = 'CalculatedMetric' THEN 2 WHEN kind = 'InputMetric' THEN 3 END AS r FROM m),
g AS (SELECT doc_id, key, arg_min(id, (r, pos, rec_id)) FILTER (r IS NOT NULL) AS new_id, min((pos, rec_id)) AS at_ FROM k GROUP BY doc_id, key HAVING count(*) > 1),
merges AS (SELECT k.doc_id, k.id AS old_id, arg_max(g.new_id, g.at_) AS new_id FROM k JOIN g USING (doc_id, key) WHERE g.new_id IS NOT NULL AND k.id <> g.new_id GROUP BY ALL)"""


def _order(kind: str) -> str:
    return f"""WITH {_ENT}, c AS (SELECT doc_id, id, min((pos, rec_id)) AS at_ FROM ent WHERE type = '{kind}' AND id IS NOT NULL GROUP BY ALL),
n AS (SELECT doc_id, subject AS id, count(*) AS n FROM kg_relationships WHERE predicate IN ('ConsistOf', 'RequiresInputFrom') AND object IS NOT NULL GROUP BY ALL),
t AS (SELECT c.doc_id, c.id, coalesce(n.n, 0) AS n_children, c.at_ FROM c LEFT JOIN n USING (doc_id, id)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, n_children = 0 ORDER BY n_children DESC, at_) AS r, count(*) FILTER (n_children = 0) OVER (PARTITION BY doc_id) AS bare FROM t),
s AS (SELECT *, CASE WHEN n_children > 0 THEN 'middle' WHEN r <= bare // 2 THEN 'left' ELSE 'right' END AS side FROM k)
SELECT doc_id, id, n_children, row_number() OVER (PARTITION BY doc_id ORDER BY CASE side WHEN 'left' THEN 0 WHEN 'middle' THEN 1 ELSE 2 END, r)::INTEGER AS k, side FROM s"""


def _report() -> str:
    """The lines of the validation report by section."""
    line = lambda n, text: f"SELECT {n} AS section, unnest(['{text}', repeat('=', length('{text}'))]) AS value"
    head = lambda n, text, cols: f"SELECT {n} AS section, unnest(['{text}', repeat('=', length('{text}')), {cols}, repeat('-', length({cols}))]) AS value"
    dist = lambda n, key, sql: f"SELECT {n}, printf('%-24s %10d %10d %8.1f', substring({key}, 1, 24), n_before, n_after, retention) FROM ({sql})"
    doc = "substring(coalesce(doc_id, ''), 1, 40)"
    names = ["Entity Uniqueness", "Entity Type-Specific Schema Compliance", "Metric Property Values", "Model Property Values", "Relationship Predicate Validity", "CalculatedMetric-Model Links"]
    facts = ["documents", "pages", "segments", "entities", "validated", "metrics"]
    return f"""{_DOCS}, td AS ({_TYPES}), pd AS ({_PREDICATES}),
tot AS (SELECT count(*) AS documents, sum(total_pages) AS pages, sum(total_segments) AS segments, sum(entities_before) AS entities, sum(entities_after) AS validated, sum(n_metrics) AS metrics FROM docs),
ce AS (SELECT d.doc_id, r.rule, r.name, coalesce((CASE WHEN s.passed THEN 'PASS' WHEN s.passed IS NOT NULL THEN 'FAIL (' || s.violation_count || ')' END), 'N/A') AS cell
  FROM (SELECT DISTINCT doc_id FROM scores) d CROSS JOIN (SELECT unnest(['VR001', 'VR002', 'VR003', 'VR004', 'VR005', 'VR006']) AS rule, unnest({names}) AS name) r LEFT JOIN scores s ON s.doc_id = d.doc_id AND s.rule_id = r.rule)
SELECT section::INTEGER AS section, value FROM (
{line(1, "1. OVERALL STATISTICS")} UNION ALL SELECT 1, printf('%-24s %12d', k, x::BIGINT) FROM (SELECT unnest(['Documents', 'Pages', 'Segments', 'Entities extracted', 'Entities validated', 'Metrics']) AS k, unnest([{", ".join(f + "::BIGINT" for f in facts)}]) AS x FROM tot)
UNION ALL {head(2, "2. QUALITY METRICS", "printf('%-40s %10s %10s %11s', 'Document', 'Schema %', 'Accuracy %', 'Rels kept %')")} UNION ALL SELECT 2, printf('%-40s %10.2f %10.2f %11.2f', {doc}, compliance, accuracy, rel_retention) FROM docs
UNION ALL {head(3, "3. DOCUMENT SUMMARY", "printf('%-40s %7s %9s %9s %9s %9s %9s', 'Document', 'Pages', 'Segments', 'Entities', 'Valid', 'Rels', 'Valid')")} UNION ALL SELECT 3, printf('%-40s %7d %9d %9d %9d %9d %9d', {doc}, total_pages, total_segments, entities_before, entities_after, rels_before, rels_after) FROM docs
UNION ALL {head(4, "4. ENTITY TYPES", "printf('%-24s %10s %10s %8s', 'Type', 'Extracted', 'Validated', 'Kept %')")} UNION ALL {dist(4, 'type', 'SELECT * FROM td')}
UNION ALL {head(5, "5. RELATIONSHIP PREDICATES", "printf('%-24s %10s %10s %8s', 'Predicate', 'Extracted', 'Validated', 'Kept %')")} UNION ALL {dist(5, 'predicate', 'SELECT * FROM pd')}
UNION ALL {head(6, "6. VALIDATION RULES", "printf('%-6s %-40s %-40s Result', 'Rule', 'Name', 'Document')")} UNION ALL SELECT 6, printf('%-6s %-40s %-40s %s', rule, name, {doc}, cell) FROM ce
UNION ALL {head(7, "7. PROVENANCE", "printf('%-40s %9s %10s %8s', 'Document', 'Entities', 'Segment %', 'Time %')")} UNION ALL SELECT 7, printf('%-40s %9d %10.1f %8.1f', {doc}, count(*), round(count(*) FILTER (coalesce(provenance['segment_id'], '') <> '')::DOUBLE / count(*) * 100, 1), round(count(*) FILTER (coalesce(provenance['extraction_timestamp'], '') <> '')::DOUBLE / count(*) * 100, 1)) FROM ent GROUP BY doc_id)"""


_TYPES = f"""SELECT coalesce(type, 'TOTAL') AS type, sum(b)::BIGINT AS n_before, sum(a)::BIGINT AS n_after, CASE WHEN sum(b) = 0 THEN 0.0::DOUBLE ELSE round(sum(a)::DOUBLE / sum(b) * 100, 1) END AS retention
FROM (SELECT t.type, (SELECT count(*) FROM ent WHERE ent.type = t.type) AS b, (SELECT count(*) FROM vent WHERE vent.type = t.type) AS a FROM (SELECT unnest({vocab.ENTITY_TYPES}) AS type) t) GROUP BY ROLLUP (type)"""
_PREDICATES = """SELECT CASE WHEN grouping(p) = 1 THEN 'TOTAL' ELSE p END AS predicate, sum(x)::BIGINT AS n_before, sum(y)::BIGINT AS n_after, CASE WHEN sum(x) = 0 THEN 0.0::DOUBLE ELSE round(sum(y)::DOUBLE / sum(x) * 100, 1) END AS retention
FROM (SELECT a.p, a.n AS x, coalesce(b.n, 0) AS y FROM (SELECT coalesce(predicate, 'Unknown') AS p, count(*) AS n FROM kg_relationships GROUP BY 1) a LEFT JOIN (SELECT coalesce(predicate, 'Unknown') AS p, count(*) AS n FROM vrel GROUP BY 1) b ON a.p = b.p) GROUP BY ROLLUP (p)"""


def _spread(n: str, least: int, most: int) -> str:
    return f"CASE WHEN {n} <= 1 THEN {most + 5} WHEN {n} = 2 THEN {most} WHEN {n} = 3 THEN {most - 2} WHEN {n} = 4 THEN {most - 4} WHEN {n} = 5 THEN {most - 6} WHEN {n} = 6 THEN {most - 8} ELSE {least} END"


def _under(name: str, bands: str, head: str) -> str:
    """Items of some bands below the heads of another: dense groups a row each, sparse ones packed, the rest at the end."""
    return f"""{name}_i AS (SELECT n.doc_id, n.id, n.band, n.o, h.id AS grp, h.k AS gk, h.x AS hx FROM nd n LEFT JOIN par p ON p.doc_id = n.doc_id AND p.node = n.id LEFT JOIN {head} h ON h.doc_id = n.doc_id AND h.id = p.parent WHERE n.band IN ({bands})),
{name}_j AS (SELECT *, row_number() OVER (PARTITION BY doc_id, grp ORDER BY o) AS j, count(*) OVER (PARTITION BY doc_id, grp) AS m FROM {name}_i),
{name}_g AS (SELECT DISTINCT doc_id, grp, gk, hx, m FROM {name}_j WHERE grp IS NOT NULL),
{name}_d AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY gk) AS row FROM {name}_g WHERE m > 3),
{name}_s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY gk) AS q FROM {name}_g WHERE m <= 3),
{name}_w AS (SELECT doc_id, grp, gk, m, q, m AS fill, 1 AS row FROM {name}_s WHERE q = 1
  UNION ALL SELECT s.doc_id, s.grp, s.gk, s.m, s.q, CASE WHEN w.fill + s.m > 10 THEN s.m ELSE w.fill + s.m END, CASE WHEN w.fill + s.m > 10 THEN w.row + 1 ELSE w.row END FROM {name}_w w JOIN {name}_s s ON s.doc_id = w.doc_id AND s.q = w.q + 1),
{name}_x AS (SELECT doc_id, grp, row, coalesce(sum(m * 28 + 6) OVER (PARTITION BY doc_id, row ORDER BY gk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - (sum((m - 1) * 28 + 6) OVER (PARTITION BY doc_id, row) - 6) / 2.0::DOUBLE AS x0, 28 AS step FROM {name}_w),
{name}_r AS (SELECT doc_id, grp, row, hx - (m - 1) * step / 2.0::DOUBLE AS x0, step FROM (SELECT *, CASE m WHEN 4 THEN 30 WHEN 5 THEN 28 WHEN 6 THEN 27 ELSE 26 END AS step FROM {name}_d)
  UNION ALL SELECT x.doc_id, grp, row + coalesce(n, 0), x0, step FROM {name}_x x LEFT JOIN (SELECT doc_id, count(*) AS n FROM {name}_d GROUP BY 1) USING (doc_id)),
{name}_t AS (SELECT doc_id, coalesce(r, 0) AS rows, coalesce(a, 0) AS alone FROM (SELECT doc_id, max(row) AS r FROM {name}_r GROUP BY 1) FULL JOIN (SELECT doc_id, count(*) AS a FROM {name}_i WHERE grp IS NULL GROUP BY 1) USING (doc_id)),
{name} AS (SELECT j.doc_id, j.id, j.band, CASE WHEN j.grp IS NULL THEN (j - 1 - (alone - 1) / 2.0::DOUBLE) * {_spread('alone', 23, 32)} ELSE x0 + (j - 1) * step END AS x, CASE WHEN j.grp IS NULL THEN rows ELSE row - 1 END AS down
  FROM {name}_j j LEFT JOIN {name}_r r ON r.doc_id = j.doc_id AND r.grp = j.grp LEFT JOIN {name}_t t ON t.doc_id = j.doc_id)"""


def _layout() -> str:
    one = lambda name, band, src, lo, hi: f"{name} AS (SELECT doc_id, id, k, (k - 1 - (n - 1) / 2.0::DOUBLE) * {_spread('n', lo, hi)} AS x, '{band}' AS band FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM ({src})))"
    plain = lambda band: f"SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS k FROM nd WHERE band = '{band}'"
    ordered = lambda band: f"""SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN n > 0 THEN 1 WHEN r <= bare // 2 THEN 0 ELSE 2 END, r) AS k FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, n = 0 ORDER BY n DESC, o) AS r, count(*) FILTER (n = 0) OVER (PARTITION BY doc_id) AS bare FROM (SELECT nd.*, coalesce(c.n, 0) AS n FROM nd LEFT JOIN ch c ON c.doc_id = nd.doc_id AND c.subject = nd.id WHERE band = '{band}'))"""  # noqa: E731
    return f"""WITH RECURSIVE {_ENT}, ev AS (SELECT doc_id, id, pos, rec_id, {_EFF} AS band FROM ent WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, id ORDER BY pos, rec_id) = 1),
nd AS (SELECT doc_id, id, band, (CASE band WHEN 'CalculatedMetric' THEN 1 WHEN 'Metric' THEN 2 ELSE 0 END, pos, rec_id) AS o FROM ev),
tree AS (SELECT * FROM kg_relationships WHERE predicate IN ('ConsistOf', 'RequiresInputFrom') AND subject IS NOT NULL AND object IS NOT NULL),
par AS (SELECT doc_id, object AS node, arg_max(subject, (pos, rel_id)) AS parent FROM tree GROUP BY ALL), ch AS (SELECT doc_id, subject, count(*) AS n FROM tree GROUP BY ALL),
{one('fw', 'ReportingFramework', plain('ReportingFramework'), 24, 34)}, {one('ind', 'Industry', plain('Industry'), 25, 35)}, {one('cat', 'Category', ordered('Category'), 32, 42)}, {one('mod', 'Model', ordered('Model'), 30, 40)},
{_under('met', "'DirectMetric', 'CalculatedMetric', 'Metric'", 'cat')}, {_under('inp', "'InputMetric'", 'mod')},
tops AS (SELECT doc_id, CASE WHEN a THEN 26 ELSE 0 END AS y1, CASE WHEN b THEN 26 ELSE 0 END AS y2, CASE WHEN c THEN 26 ELSE 0 END AS y3, CASE WHEN m THEN 26 ELSE 0 END AS y4, coalesce(t.rows, 0) + CASE WHEN coalesce(t.alone, 0) > 0 THEN 1 ELSE 0 END AS tall
  FROM (SELECT doc_id, bool_or(coalesce(band = 'ReportingFramework', false)) AS a, bool_or(coalesce(band = 'Industry', false)) AS b, bool_or(coalesce(band = 'Category', false)) AS c, bool_or(coalesce(band = 'Model', false)) AS m FROM nd GROUP BY 1) LEFT JOIN met_t t USING (doc_id)),
al AS (SELECT doc_id, id, band, x, down FROM met UNION ALL SELECT doc_id, id, band, x, down FROM inp UNION ALL SELECT doc_id, id, band, x, 0 FROM (SELECT * FROM fw UNION ALL SELECT * FROM ind UNION ALL SELECT * FROM cat UNION ALL SELECT * FROM mod))
SELECT al.doc_id, id, band, x::DOUBLE AS x, 0.0 - (CASE band WHEN 'ReportingFramework' THEN 0 WHEN 'Industry' THEN y1 WHEN 'Category' THEN y1 + y2 WHEN 'Model' THEN y1 + y2 + y3 + tall * 20 WHEN 'InputMetric' THEN y1 + y2 + y3 + tall * 20 + y4 ELSE y1 + y2 + y3 END + down * 20)::DOUBLE AS y
FROM al JOIN tops USING (doc_id)"""


_PYLIST = "CASE WHEN json_type(v) = 'ARRAY' THEN '[' || array_to_string(list_transform(CAST(v AS JSON[]), lambda x: CASE json_type(x) WHEN 'NULL' THEN 'None' WHEN 'VARCHAR' THEN '''' || (x ->> '$') || '''' ELSE CAST(x AS VARCHAR) END), ', ') || ']' ELSE v ->> '$' END"

ORACLE = {
    "dedup_entities": f"WITH {_ENT} SELECT rec_id, doc_id, id FROM ent QUALIFY id IS NULL OR row_number() OVER (PARTITION BY doc_id, id ORDER BY pos, rec_id) = 1",
    "type_gate": f"WITH {_ENT} SELECT rec_id, coalesce(type, 'unknown') AS type FROM ent WHERE NOT known",
    "gate_prompt": f"WITH {_ENT} SELECT rec_id, 'Label: ' || coalesce(label, '') || CASE WHEN type IN ('Metric', 'Model') AND coalesce({_f('description')} ->> '$', '') <> '' THEN chr(10) || 'Description: ' || ({_f('description')} ->> '$') ELSE '' END AS prompt FROM ent WHERE known",
    "gate_accuracy": f"WITH {_GATE}, {_ACC} SELECT * FROM acc",
    "verdict_gate": f"""WITH {_ENT}, j AS (SELECT *, id IS NOT NULL AND length(id) % 5 <> 0 AS answered, CASE WHEN length(id) % 7 <> 0 THEN length(id) % 3 <> 0 ELSE false END AS ok FROM ent)
SELECT rec_id, known AND answered AS called, NOT known OR (answered AND NOT ok) AS mismatch,
  CASE WHEN NOT known THEN 'SEMANTIC FAILURE: Unknown/invalid type "' || coalesce(type, 'unknown') || '" not in ontology schema. Only 4 types allowed: Industry, Category, Metric, Model.' WHEN answered AND NOT ok THEN 'asked about ' || id END AS reasoning FROM j""",
    "gate_entities": f"WITH {_GATE} SELECT doc_id, count(*) AS n, sum(rec_id)::BIGINT AS id_sum FROM gated GROUP BY doc_id",
    "gate_relationships": f"WITH {_GATE} SELECT rel_id FROM grels",
    "cascade_entities": f"WITH {_VALID} SELECT rec_id FROM vent",
    "cascade_relationships": f"WITH {_VALID} SELECT rel_id FROM vrel",
    "cascade_summary": f"WITH {_VALID}, {_RET} SELECT * FROM ret",
    "vr001": f"WITH {_GATE}, n AS (SELECT *, first_value(label) OVER w AS first_label, row_number() OVER w AS k FROM gated WINDOW w AS (PARTITION BY doc_id, id ORDER BY pos, rec_id)) SELECT rec_id, doc_id, id, first_label AS first_occurrence, label AS duplicate_label FROM n WHERE k > 1",
    "vr002": f"WITH {_FLAGS} SELECT rec_id, array_to_string(missing, ',') AS missing FROM flags WHERE len(missing) > 0",
    "vr003": f"WITH {_FLAGS} SELECT rec_id FROM flags WHERE vr003",
    "vr004": f"WITH {_FLAGS} SELECT rec_id FROM flags WHERE vr004",
    "vr005": f"WITH {_GATE} SELECT rel_id, predicate FROM grels WHERE coalesce(predicate, '') NOT IN {_in(vocab.PREDICATES)}",
    "vr006": f"WITH {_FLAGS} SELECT rec_id FROM unlinked",
    "rule_scores": f"WITH {_SCORES} SELECT doc_id, rule_id, violation_count, total_items, score, passed FROM scores",
    "compliance": f"WITH {_SCORES} SELECT * FROM comp",
    "violation_stats": f"WITH {_SCORES} SELECT rule_id, sum(violation_count)::BIGINT AS violations, sum(total_items)::BIGINT AS items, count(*) FILTER (passed) AS documents_passed, count(*) AS documents FROM scores GROUP BY rule_id",
    "rule_matrix": f"""WITH {_SCORES}, cells AS (SELECT doc_id, rule_id, CASE WHEN passed THEN 'PASS' ELSE 'FAIL (' || violation_count || ')' END AS cell FROM scores)
SELECT doc_id, {", ".join(f"coalesce(max(cell) FILTER (rule_id = '{r}'), 'N/A') AS {r.lower()}" for r in ('VR001', 'VR002', 'VR003', 'VR004', 'VR005', 'VR006'))} FROM cells GROUP BY doc_id""",
    "segment_retention": f"{_SEG} SELECT * FROM seg",
    "mean_segment_retention": f"{_SEG} SELECT doc_id, count(*) AS n_segments, (2 * sum(round(validated::DOUBLE / original * 1e11)::BIGINT) + count(*) * 10000000) // (2 * count(*) * 10000000) / 100.0::DOUBLE AS avg_segment_retention FROM seg GROUP BY doc_id",
    "signature_check": f"""WITH {_ENT}, ty AS (SELECT doc_id, id, arg_min(coalesce(type, chr(1)), (pos, rec_id)) AS type FROM ent WHERE id IS NOT NULL GROUP BY ALL),
tp AS (SELECT r.rel_id, r.doc_id, nullif(s.type, chr(1)) AS subject_type, r.predicate, nullif(o.type, chr(1)) AS object_type FROM kg_relationships r JOIN ty s ON s.doc_id = r.doc_id AND s.id = r.subject JOIN ty o ON o.doc_id = r.doc_id AND o.id = r.object)
SELECT * FROM tp WHERE coalesce((subject_type, predicate, object_type) NOT IN ({", ".join(str(s) for s in vocab.SIGNATURES)}), true)""",
    "type_distribution": f"""WITH {_VALID}, t AS (SELECT unnest({vocab.ENTITY_TYPES}) AS type), c AS (
SELECT t.type, (SELECT count(*) FROM ent WHERE ent.type = t.type) AS b, (SELECT count(*) FROM vent WHERE vent.type = t.type) AS a FROM t)
SELECT coalesce(type, 'TOTAL') AS type, sum(b)::BIGINT AS n_before, sum(a)::BIGINT AS n_after, CASE WHEN sum(b) = 0 THEN 0.0::DOUBLE ELSE round(sum(a)::DOUBLE / sum(b) * 100, 1) END AS retention FROM c GROUP BY ROLLUP (type)""",
    "predicate_distribution": f"""WITH {_VALID}, a AS (SELECT coalesce(predicate, 'Unknown') AS p, count(*) AS n FROM kg_relationships GROUP BY 1), b AS (SELECT coalesce(predicate, 'Unknown') AS p, count(*) AS n FROM vrel GROUP BY 1),
c AS (SELECT coalesce(a.p, b.p) AS p, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM a FULL JOIN b ON a.p = b.p)
SELECT CASE WHEN grouping(p) = 1 THEN 'TOTAL' ELSE p END AS predicate, sum(x)::BIGINT AS n_before, sum(y)::BIGINT AS n_after, CASE WHEN sum(x) = 0 THEN 0.0::DOUBLE ELSE round(sum(y)::DOUBLE / sum(x) * 100, 1) END AS retention FROM c GROUP BY ROLLUP (p)""",
    "type_counts": f"WITH {_ENT} SELECT doc_id, {', '.join(f"count(*) FILTER (type = '{t}') AS {t.lower()}" for t in vocab.ENTITY_TYPES)}, count(*) FILTER (coalesce(type, '') NOT IN {_in(vocab.ENTITY_TYPES)}) AS other FROM ent GROUP BY doc_id",
    "provenance_coverage": f"WITH {_ENT} SELECT doc_id, count(*) AS n_entities, round(count(*) FILTER (coalesce(provenance['segment_id'], '') <> '')::DOUBLE / count(*) * 100, 1) AS with_provenance, round(count(*) FILTER (coalesce(provenance['extraction_timestamp'], '') <> '')::DOUBLE / count(*) * 100, 1) AS with_timestamp FROM ent GROUP BY doc_id",
    "document_report": f"{_DOCS} SELECT * FROM docs",
    "grand_totals": f"{_DOCS} SELECT count(*) AS documents, sum(total_pages)::BIGINT AS pages, sum(total_segments)::BIGINT AS segments, sum(entities_before)::BIGINT AS entities, sum(entities_after)::BIGINT AS validated, sum(n_metrics)::BIGINT AS metrics, round(sum(cost_usd), 4) AS cost_usd, round(avg(cost_usd), 6) AS mean_cost_usd FROM docs",
    "report_examples": f"WITH {_VALID} SELECT doc_id, floor(coalesce(v.n, 0)::DOUBLE / e.n * 100)::BIGINT AS percent_kept FROM (SELECT doc_id, count(*) AS n FROM ent GROUP BY 1) e LEFT JOIN (SELECT doc_id, count(*) AS n FROM vent GROUP BY 1) v USING (doc_id)",
    "failed_entities": f"""WITH {_VALID}, l AS (SELECT *, row_number() OVER (PARTITION BY doc_id, id ORDER BY pos DESC, rec_id DESC) AS k FROM gate WHERE id IS NOT NULL),
w AS (SELECT doc_id, id, CASE WHEN known THEN '"' || label || '" does not read like a ' || type ELSE 'SEMANTIC FAILURE: Unknown/invalid type "' || coalesce(type, 'unknown') || '" not in ontology schema. Only 4 types allowed: Industry, Category, Metric, Model.' END AS reason
  FROM gate WHERE id IS NOT NULL AND mismatch QUALIFY row_number() OVER (PARTITION BY doc_id, id ORDER BY pos DESC, rec_id DESC) = 1)
SELECT l.doc_id, l.id AS entity_id, coalesce(l.type, 'Unknown') AS entity_type, coalesce(l.label, 'No label') AS entity_label, coalesce(w.reason, 'Entity removed during validation (detailed reasoning not available)') AS failure_reason
FROM l LEFT JOIN w ON w.doc_id = l.doc_id AND w.id = l.id WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM vids v WHERE v.doc_id = l.doc_id AND v.id = l.id)""",
    "failures_per_document": f"WITH {_VALID} SELECT doc_id, count(DISTINCT id) FILTER (id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM vids v WHERE v.doc_id = gate.doc_id AND v.id = gate.id)) AS n_failed FROM gate GROUP BY doc_id",
    "metric_merge": f"WITH {_MERGE} SELECT * FROM merges",
    "edge_redirect": f"""WITH {_MERGE}, t AS (SELECT r.rel_id, r.pos, r.doc_id, coalesce(s.new_id, r.subject) AS subject, r.predicate, coalesce(o.new_id, r.object) AS object FROM kg_relationships r
LEFT JOIN merges s ON s.doc_id = r.doc_id AND s.old_id = r.subject LEFT JOIN merges o ON o.doc_id = r.doc_id AND o.old_id = r.object)
SELECT rel_id, doc_id, subject, predicate, object FROM t WHERE subject IS DISTINCT FROM object QUALIFY row_number() OVER (PARTITION BY doc_id, subject, predicate, object ORDER BY pos, rel_id) = 1""",
    "effective_type": f"WITH {_ENT} SELECT rec_id, {_EFF} AS effective_type FROM ent",
    "legend": f"WITH {_ENT} SELECT coalesce(CASE WHEN {_EFF} IN ('DirectMetric', 'InputMetric') THEN 'Direct/InputMetric' ELSE {_EFF} END, 'Unknown') AS legend, count(*) AS n FROM ent GROUP BY 1",
    "induced_edges": f"WITH {_ENT} SELECT rel_id FROM kg_relationships r WHERE EXISTS (SELECT 1 FROM ent e WHERE e.doc_id = r.doc_id AND e.id = r.subject) AND EXISTS (SELECT 1 FROM ent e WHERE e.doc_id = r.doc_id AND e.id = r.object)",
    "parent_map": "SELECT doc_id, object AS node, arg_max(subject, (pos, rel_id)) AS parent FROM kg_relationships WHERE predicate IN ('ConsistOf', 'RequiresInputFrom') AND subject IS NOT NULL AND object IS NOT NULL GROUP BY ALL",
    "children_map": """SELECT doc_id, subject AS parent, row_number() OVER (PARTITION BY doc_id, subject ORDER BY pos, rel_id)::INTEGER AS ord, object AS child
FROM kg_relationships WHERE predicate IN ('ConsistOf', 'RequiresInputFrom') AND subject IS NOT NULL AND object IS NOT NULL""",
    "category_order": _order("Category"),
    "model_order": _order("Model"),
    "predicate_counts": "SELECT doc_id, coalesce(predicate, 'Unknown') AS predicate, count(*) AS n FROM kg_relationships GROUP BY 1, 2",
    "validation_report": _report(),
    "document_stages": f"""WITH {_VALID} SELECT e.doc_id, e.n AS extracted, coalesce(g.n, 0) AS gated, coalesce(v.n, 0) AS validated, coalesce(r.n, 0) AS rels_extracted, coalesce(gr.n, 0) AS rels_gated, coalesce(w.n, 0) AS rels_validated
FROM (SELECT doc_id, count(*) AS n FROM ent GROUP BY 1) e LEFT JOIN (SELECT doc_id, count(*) AS n FROM gated GROUP BY 1) g USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM vent GROUP BY 1) v USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM kg_relationships GROUP BY 1) r USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM grels GROUP BY 1) gr USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM vrel GROUP BY 1) w USING (doc_id)""",
    "graph_layout": _layout(),
    "triples": f"""WITH {_ENT}, named AS (SELECT * FROM ent WHERE id IS NOT NULL),
pr AS (SELECT doc_id, id, k, json_extract(props, '$."' || k || '"') AS v FROM (SELECT *, unnest(json_keys(props)) AS k FROM named WHERE props IS NOT NULL)),
pv AS (SELECT doc_id, id, unnest(map_entries(provenance)) AS e FROM named)
SELECT DISTINCT * FROM (
SELECT doc_id, id AS s, 'rdf:type' AS p, coalesce(type, 'Entity') AS o, 'uri' AS o_kind FROM named
UNION ALL SELECT doc_id, id, 'rdfs:label', label, 'literal' FROM named WHERE label <> ''
UNION ALL SELECT doc_id, id, 'esg:' || k, {_PYLIST}, 'literal' FROM pr WHERE NOT {_FALSY.format("v")} AND coalesce(v ->> '$' <> 'N/A', true)
UNION ALL SELECT doc_id, id, 'esg:provenance_' || e.key, e.value, 'literal' FROM pv WHERE e.value <> ''
UNION ALL SELECT doc_id, subject, coalesce(predicate, 'Unknown'), object, 'uri' FROM kg_relationships WHERE subject IS NOT NULL AND object IS NOT NULL)""",
}
