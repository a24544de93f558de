"""Small graphs for each trap of the gate, the rules, the cascade and the graph operators."""

import json
import re

import pytest
from pyspark.sql import functions as F

from tessella import vocab
from tessella.functions.values import is_falsy
from tessella.operators import cascade, gate, graph, kg, layout, report, rules
from tessella.plans import graph_queries
from tessella.sources import reports

SF = "/root/testdata/sf0.001"
RAW = "rec_id long, doc_id string, pos int, id string, type string, label string, properties string, source struct<doc_id:string,page:int>, provenance map<string,string>, op string"
REL = "rel_id long, doc_id string, pos int, subject string, predicate string, object string, source struct<doc_id:string>"
FULL = {"measurement_type": "Quantitative", "metric_type": "DirectMetric", "unit": "t", "code": "C", "description": "x"}


def ents(spark, *rows):
    out = []
    for i, r in enumerate(rows):
        r = {"doc_id": "d", "id": f"e{i}", "type": "Metric", "label": "abc", "properties": json.dumps(FULL), "source": ("d", 1), "provenance": {"segment_id": "s1"}, **r}
        p = r["properties"] if r["properties"] is None or isinstance(r["properties"], str) else json.dumps(r["properties"])
        out.append((i, r["doc_id"], i, r["id"], r["type"], r["label"], p, r["source"], r["provenance"], "upsert"))
    return kg.entities(spark.createDataFrame(out, RAW))


def rels(spark, *rows):
    return kg.relationships(spark.createDataFrame([(i, "d", i, s, p, o, None) for i, (s, p, o) in enumerate(rows)], REL))


def judge(*wrong):
    return lambda df: df.withColumn("is_correct", ~F.coalesce(F.col("id").isin(*wrong), F.lit(False))).withColumn("failed", F.lit(False))


@pytest.mark.parametrize(("text", "want"), [("null", True), ('""', True), ("[]", True), ("{}", True), ("0", True), ("false", True), ('"0"', False), ("[0]", False), ("1", False), ('" "', False)])
def test_falsy(spark, text, want):
    assert spark.range(1).select(is_falsy(F.try_parse_json(F.lit(text))).alias("x")).first().x is want


def test_gate_removes_every_row_of_a_mismatched_id_but_no_row_without_id(spark):
    e = ents(spark, {"id": "a"}, {"id": "a"}, {"id": None, "type": "Standard"}, {"id": "b", "type": None}, {"id": "c"})
    v = cascade.validate(e, rels(spark), judge("a"))
    assert {r.key for r in v.ids.where("bad").collect()} == {"=a", "=b"}
    assert sorted(r.rec_id for r in v.gated.collect()) == [2, 4]
    for acc in (gate.accuracy(v.gate).first(), gate.accuracy(v.ids).first()):
        assert (acc.n_entities, acc.n_correct, acc.accuracy, acc.cost_usd) == (5, 1, 20.0, 0.0003)


def test_open_gate_has_no_mismatch_and_no_accuracy(spark):
    v = cascade.validate(ents(spark, {"type": "Standard"}), rels(spark), None)
    assert v.entities.count() == 1 and gate.accuracy(v.gate).first().accuracy == gate.accuracy(v.ids).first().accuracy == 0.0


def test_verdict_table(spark):
    v = spark.createDataFrame([("d", "e0", True, 1), ("d", "e1", None, 1)], "doc_id string, id string, is_correct boolean, extra int")
    g = {r.id: (r.mismatch, r.called) for r in gate.judged(ents(spark, {}, {}, {}), gate.table_judge(v)).collect()}
    assert g == {"e0": (False, True), "e1": (True, True), "e2": (False, False)}


def test_tables_with_a_row_for_each_id_are_never_broadcast(spark):
    v = cascade.validate(ents(spark, {"id": "a"}, {"id": "b"}), rels(spark, ("a", "ConsistOf", "b")), judge("a"))
    # only lists of hot keys, which are cut at a fixed number, are broadcast
    for df, merges in ((v.gated_rels, 2), (v.ends, 2), (v.gated, 1), (v.entities, 1), (cascade.segment_retention(v), 1), (rules.unlinked(v.gated, v.gated_rels), 1)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastExchange") == plan.count("TakeOrderedAndProject") and plan.count("SortMergeJoin") >= merges


def broadcasts(spark, name):
    """The columns of each broadcast in all plans that a query runs, those of its staged tables included."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty(30_000)
    done = store.executionsCount()
    graph_queries.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
    bus.waitUntilEmpty(30_000)
    ran = store.executionsList(done, 1000)
    plans = [ran.apply(i).physicalPlanDescription() for i in range(ran.size())]
    assert any("SortMergeJoin" in p for p in plans)
    return [c for p in plans for c in re.findall(r"\) BroadcastExchange\s*\nInput \[\d+\]: \[(.*)\]", p)]


@pytest.mark.parametrize("name", ["document_report", "gate_relationships", "compliance", "document_stages", "rule_matrix", "predicate_distribution", "vr005", "rule_scores", "grand_totals", "vr006", "validation_report"])
def test_queries_broadcast_nothing_but_lists_of_hot_keys(spark, name):
    found = broadcasts(spark, name)
    assert found and [c for c in found if "_hot#" not in c] == []


def test_the_two_relationship_filters_differ_on_dangling_ends(spark):
    e = ents(spark, {"id": "a"}, {"id": "b"}, {"id": "c"})
    r = rels(spark, ("a", "ConsistOf", "b"), ("a", "ConsistOf", "nowhere"), ("c", "ConsistOf", "a"), (None, "ConsistOf", "a"))
    v = cascade.validate(e, r, judge("c"))
    assert sorted(x.rel_id for x in v.gated_rels.collect()) == [0, 1, 3]
    assert [x.rel_id for x in v.rels.collect()] == [0]


def test_duplicates_remove_the_first_occurrence_too(spark):
    e = ents(spark, {"id": "a"}, {"id": "a", "label": "again"}, {"id": None}, {"id": None}, {"id": "b"})
    v = cascade.validate(e, rels(spark, ("a", "Include", "b")), judge())
    assert [r.id for r in v.entities.collect()] == ["b"] and v.rels.count() == 0
    dup = {(r.rec_id, r.first_occurrence) for r in rules.duplicate_rows(v.gated).collect()}
    assert dup == {(1, "abc"), (3, "abc")}
    r = cascade.retention(v).first()
    assert (r.entities_before, r.entities_after, r.rels_after, r.entity_retention, r.rel_retention) == (5, 1, 0, 20.0, 0.0)


def score(spark, e, r=None, **kw):
    return {x.rule_id: (x.violation_count, x.total_items, x.score) for x in rules.results(e, r if r is not None else rels(spark), **kw).collect()}


def test_rules_on_values(spark):
    def p(**kw):
        return {**FULL, **kw}

    e = ents(
        spark, {"properties": p(code="N/A")}, {"properties": p(code=0)}, {"properties": {k: v for k, v in FULL.items() if k != "code"}}, {"properties": p(unit="")}, {"properties": p(measurement_type="Qualitative", unit="")},
        {"properties": p(metric_type="InputMetric", code=None)}, {"type": "Model", "properties": {"description": "", "equation": "", "input_variables": []}}, {"type": "Model", "properties": {"description": 1, "equation": 1, "input_variables": ["", None]}},
        {"type": "Model", "properties": {"description": 1, "equation": 1, "input_variables": "text"}}, {"type": "Model", "properties": {"description": 1, "equation": 1, "input_variables": "N/A"}}, {"label": "", "source": None}, {"properties": None},
    )
    s = score(spark, e)
    assert s["VR003"][:2] == (4, 8) and s["VR004"][:2] == (3, 4)
    # absent code; nothing at all; no label and no source
    assert s["VR002"][0] == 3 and s["VR001"] == (0, 12, 100.0)


def test_rules_on_links(spark):
    e = ents(spark, {"properties": {**FULL, "metric_type": "CalculatedMetric"}}, {"properties": {**FULL, "metric_type": "CalculatedMetric"}}, {"type": "Category", "properties": {"section_title": ""}})
    s = score(spark, e, rels(spark, ("e0", "IsCalculatedBy", "nothing"), ("e1", "isCalculatedBy", "e2"), ("e1", None, "e2")))
    assert s["VR005"] == (2, 3, 33.33) and s["VR006"] == (1, 2, 50.0)


def test_a_crashing_rule_scores_full_marks_only_in_strict_mode(spark):
    e = ents(spark, {"properties": "null"}, {"type": "Model", "properties": "[]"})
    s = score(spark, e)
    assert s["VR002"] == s["VR003"] == s["VR004"] == (-1, 0, 100.0)
    assert score(spark, e, strict=False)["VR002"] == (-1, 0, 0.0)
    c = rules.compliance(rules.results(e, rels(spark))).first()
    assert c.status == "FAIL" and c.compliance == 100.0 and c.critical_failures == 4


def test_compliance_is_the_mean_of_rounded_scores(spark):
    e = ents(spark, {"source": None}, {}, {})
    c = rules.compliance(rules.results(e, rels(spark))).first()
    # (5 * 100 + 66.67) / 6 is 94.445: an exact tie goes up
    assert c.compliance == 94.45


def test_reports(spark):
    e = ents(spark, {"id": "a"}, {"id": "b", "type": "Odd"}, {"id": "c", "type": "Model", "provenance": None})
    v = cascade.validate(e, rels(spark, ("a", None, "c")), judge("a"))
    t = {r.type: (r.n_before, r.n_after, r.retention) for r in report.type_distribution(v.gate, v.entities).collect()}
    assert t["Metric"] == (1, 0, 0.0) and t["Category"] == (0, 0, 0.0) and t["TOTAL"] == (2, 1, 50.0) and "Odd" not in t
    p = {r.predicate: (r.n_before, r.n_after) for r in report.predicate_distribution(v.ends).collect()}
    assert p == {"Unknown": (1, 0), "TOTAL": (1, 0)}
    seg = {r.segment_id: (r.original, r.validated) for r in cascade.segment_retention(v).collect()}
    assert seg == {"s1": (2, 0), "unknown": (1, 1)}
    assert cascade.mean_segment_retention(cascade.segment_retention(v)).first().avg_segment_retention == 50.0


def test_merge_and_redirect(spark):
    def m(kind):
        return {**FULL, "metric_type": kind}

    e = ents(
        spark, {"id": "i", "label": " Water ", "properties": m("InputMetric")}, {"id": "d1", "label": "water", "properties": m("DirectMetric")}, {"id": "d2", "label": "WATER", "properties": m("DirectMetric")},
        {"id": "u1", "label": "odd", "properties": m("Other")}, {"id": "u2", "label": "odd", "properties": m(None)}, {"id": "cat", "type": "Category"},
    )
    r = rels(spark, ("cat", "ConsistOf", "d2"), ("i", "X", "d1"), ("i", "Y", "cat"), ("d1", "Y", "cat"), ("u1", "Z", "u1"))
    merges = graph.merge_map(e, r)
    assert {(x.old_id, x.new_id) for x in merges.collect()} == {("i", "d2"), ("d1", "d2")}
    assert {(x.rel_id, x.subject, x.object) for x in graph.redirect(r, merges).collect()} == {(0, "cat", "d2"), (2, "d2", "cat")}
    kinds = {x.id: x.k for x in e.select("id", graph.effective_type().alias("k")).collect()}
    assert kinds["u1"] == "Metric" and kinds["i"] == "InputMetric"


def test_triples(spark):
    e = ents(spark, {"id": "a", "label": "", "properties": {"x": "N/A", "y": [1, "b", None], "z": 0}, "provenance": {"segment_id": "", "t": "1"}})
    t = {(r.p, r.o) for r in graph.triples(e, rels(spark, ("a", "Include", "b"), ("a", "Include", "b"))).collect()}
    assert t == {("rdf:type", "Metric"), ("esg:y", "[1, 'b', None]"), ("esg:provenance_t", "1"), ("Include", "b")}


def test_empty_graph(spark):
    e, r = ents(spark).limit(0), rels(spark).limit(0)
    v = cascade.validate(e, r)
    assert v.entities.count() == 0 and rules.results(e, r).count() == 0
    assert {x.n_before for x in report.type_distribution(v.gate, v.entities).collect()} == {0}
    assert graph.merge_map(e, r).count() == 0 and graph.triples(e, r).count() == 0


def test_predicates_however_spelled(spark):
    df = spark.createDataFrame([("Is-Calculated By",), ("CONSIST_OF",), (" include ",), ("Discloses",), ("",), (None,)], "p string")
    assert [r.x for r in df.select(vocab.is_ontology_predicate(F.col("p")).alias("x")).collect()] == [True, True, True, False, False, False]


def test_failures_carry_the_reasoning_of_the_judge(spark):
    v = spark.createDataFrame([("d", "a", False, "no metric"), ("d", "b", True, "fine"), ("d", "x", True, "")], "doc_id string, id string, is_correct boolean, reasoning string")
    e = ents(spark, {"id": "a"}, {"id": "b"}, {"id": "b", "label": "second"}, {"id": "x", "type": None, "label": None}, {"id": None}, {"id": "free"})
    failed = graph.failed_entities(cascade.validate(e, rels(spark), gate.table_judge(v)))
    assert reports.failures_table(failed).columns == ["Document", "Entity_ID", "Entity_Type", "Entity_Label", "Failure_Reason"]
    got = {r.entity_id: (r.entity_type, r.entity_label, r.failure_reason) for r in failed.collect()}
    assert got == {
        "a": ("Metric", "abc", "no metric"), "b": ("Metric", "second", graph.DEFAULT_REASON),
        "x": ("Unknown", "No label", 'SEMANTIC FAILURE: Unknown/invalid type "unknown" not in ontology schema. Only 4 types allowed: Industry, Category, Metric, Model.'),
    }


def test_a_rule_of_ones_own(spark):
    mine = rules.Rule("X1", "Alive", "Ids with one row", "count_if(n > 1)", "count(1)")
    e = ents(spark, {"id": "a"}, {"id": "a"}, {"id": "b"})
    got = {r.rule_id: (r.violation_count, r.total_items) for r in rules.results(e, rels(spark), rules=[*rules.RULES, mine]).collect()}
    assert got["X1"] == (1, 2) and got["VR001"] == (1, 3) and len(got) == 7
    assert rules.registry(spark, [mine]).first().over == "entities"


def test_childless_nodes_stand_half_left_half_right(spark):
    e = ents(spark, *[{"id": f"c{i}", "type": "Category"} for i in range(6)])
    r = rels(spark, ("c3", "ConsistOf", "x"), ("c1", "RequiresInputFrom", "y"), ("c1", "ConsistOf", "z"), ("c1", "Include", "z"))
    order = sorted((x.k, x.id, x.side) for x in graph.drawing_order(e, r).collect())
    assert order == [(1, "c0", "left"), (2, "c2", "left"), (3, "c1", "middle"), (4, "c3", "middle"), (5, "c4", "right"), (6, "c5", "right")]
    assert [(x.parent, x.ord, x.child) for x in graph.children(r).orderBy("parent", "ord").collect()] == [("c1", 1, "y"), ("c1", 2, "z"), ("c3", 1, "x")]


@pytest.mark.parametrize("chunk", [2, 3, 100])
def test_rows_are_filled_alike_in_any_number_of_chunks(spark, chunk):
    import random

    rng = random.Random(chunk)
    sizes = [(d, i, rng.randint(1, 3)) for d in ("a", "b", None) for i in range(12)]
    want = set()
    for d in ("a", "b", None):
        row, fill = 1, 0
        for _, i, m in [x for x in sizes if x[0] == d]:
            if fill and fill + m > 10:
                row, fill = row + 1, 0
            fill += m
            want.add((d, i, row))
    df = spark.createDataFrame(sizes, "doc_id string, gk int, m int")
    assert {(r.doc_id, r.gk, r.row) for r in layout.fill_rows(df, ["doc_id"], [F.asc("gk")], "m", chunk=chunk).collect()} == want


def test_layout(spark):
    e = ents(spark, {"id": "f", "type": "ReportingFramework"}, {"id": "c1", "type": "Category"}, {"id": "c2", "type": "Category"}, *[{"id": f"m{i}"} for i in range(5)], {"id": "lone"}, {"id": "odd", "type": "Other"})
    r = rels(spark, *[("c1", "ConsistOf", f"m{i}") for i in range(4)], ("c2", "ConsistOf", "m4"))
    at = {x.id: (x.x, x.y) for x in layout.layout(e, r).collect()}
    assert at["f"] == (0.0, 0.0) and at["c1"] == (-21.0, -26.0) and at["c2"] == (21.0, -26.0) and "odd" not in at
    assert [at[f"m{i}"] for i in range(4)] == [(-21.0 - 45.0 + 30.0 * i, -52.0) for i in range(4)] and at["m4"] == (0.0, -72.0) and at["lone"] == (0.0, -92.0)


def test_validated_files_round_trip(spark, tmp_path):
    from tessella.sources import readers, sinks

    e = ents(spark, {"id": "a"}, {"id": "b"}, {"id": "c", "doc_id": "gone", "type": "Odd"})
    r = rels(spark, ("a", "ConsistOf", "b"), ("a", "ConsistOf", "zzz"))
    v = cascade.validate(e, r, judge())
    results = rules.results(v.gated_ids, v.gated_rels)
    meta = cascade.validated_metadata(v, results, "now")
    m = meta.first()
    assert meta.count() == 1 and (m.doc_id, m.validation_metadata.validated_entity_count, m.validation_metadata.critical_violations_removed, m.validation_metadata.rule_scores["VR001"]) == ("d", 2, 1, 100.0)
    parts = {(x.doc_id, x.part) for x in sinks.validated_json(v.entities, v.rels, meta).collect()}
    assert parts == {("d", "metadata"), ("d", "entity"), ("d", "relationship")}
    (tmp_path / "d x_validated.json").write_text('{"validation_metadata": ' + sinks.validated_json(v.entities, v.rels, meta).where("part = 'metadata'").first().value + "}")
    (tmp_path / "odd_validated.json").write_text("{}")
    got = {x.document_name: (x.original_entities, x.validated_entities, x.semantic_accuracy) for x in readers.validated_files(spark, str(tmp_path)).collect()}
    assert got == {"d x": (2, 2, 100.0), "odd": (0, 0, 0.0)}
    lines = reports.validation_report(v, spark.createDataFrame([("d", 3, 4)], "document_name string, total_pages int, total_segments int"), results, e)
    text = [x.value for x in lines.orderBy("section", "ord").collect()]
    assert text[0].startswith("1. OVERALL") and any(x.startswith("Entities extracted") and x.endswith(" 3") for x in text) and any(x.startswith("VR006") for x in text)
    assert [x for x in text if x.startswith("TOTAL")][0].split() == ["TOTAL", "2", "2", "100.0"]


def test_compliance_of_known_documents(spark):
    """Five documents of which all break VR002 throughout and some VR003: known figures."""
    known = [("a", 42, 1, 27, 82.72), ("b", 62, 3, 38, 82.02), ("c", 68, 6, 54, 81.48), ("d", 66, 0, 52, 83.33), ("e", 57, 7, 36, 80.09)]
    rows = [(d, f"VR00{k}", bad, total, round((total - bad) / total * 100, 2), bad == 0) for d, n, v3, metrics, _ in known for k, bad, total in ((1, 0, n), (2, n, n), (3, v3, metrics), (4, 0, 1), (5, 0, 1), (6, 0, 1))]
    got = rules.compliance(spark.createDataFrame(rows, "doc_id string, rule_id string, violation_count long, total_items long, score double, passed boolean"))
    assert {r.doc_id: r.compliance for r in got.collect()} == {d: c for d, *_, c in known}
