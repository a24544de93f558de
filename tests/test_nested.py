import json

from tessella.operators import nested
from tessella.operators.nested import payload_rows

SCHEMA = "payload_id long, doc_id string, payload string, pos1 int, value string"
GRAPH = {
    "entities": [
        None, "text", {"id": "a", "provenance": [{"s": 1}, None, {"s": 2}], "properties": json.dumps({"input_variables": "x"})},
        {"id": "b", "provenance": {"s": 1}, "properties": {"input_variables": ["a", None, ["n"]], "disaggregations": [None, "by site", {"members": ["n", None, "s"]}, {"members": "one"}, {"members": None}]}},
        {"id": "c", "provenance": None, "properties": [1]}, {"id": "d", "properties": "no json"},
    ],
    "relationships": {"subject": "a", "object": "b"},
}
ROWS = {
    ("entity", 2, -1, -1), ("entity", 3, -1, -1), ("entity", 4, -1, -1), ("entity", 5, -1, -1), ("relationship", 0, -1, -1),
    ("provenance", 2, 0, -1), ("provenance", 2, 2, -1), ("provenance", 3, 0, -1), ("input_variable", 2, 0, -1), ("input_variable", 3, 0, -1), ("input_variable", 3, 2, -1),
    ("disaggregation", 3, 1, -1), ("disaggregation", 3, 2, -1), ("disaggregation", 3, 3, -1), ("disaggregation", 3, 4, -1),
    ("disaggregation_member", 3, 2, 0), ("disaggregation_member", 3, 2, 2), ("disaggregation_member", 3, 3, 0),
}


def frame(spark, payloads):
    return spark.createDataFrame([(i, "d", p, 7, "clash") for i, p in enumerate(payloads)], SCHEMA)


def test_all_levels_and_envelopes(spark):
    g = json.dumps(GRAPH)
    base = json.dumps({"entities": [{"id": "top"}], "experiments": {"2_baseline_llm": GRAPH}})
    payloads = [g, f"Here:\n```json\n{g}\n```\nBye", f"Sure! {g} That is all.", base]
    got = {}
    for r in payload_rows(frame(spark, payloads)).collect():
        got.setdefault(r.payload_id, set()).add((r.kind, r.pos1, r.pos2, r.pos3))
    assert got == {i: ROWS for i in range(4)}


def test_unreadable_and_graphless(spark):
    failed = json.dumps({"entities": [{"id": 1}], "experiments": {"2_baseline_llm": {"status": "failed"}}})
    null_exp = json.dumps({"entities": [{"id": 1}], "experiments": {"2_baseline_llm": None}})
    other = json.dumps({"experiments": {"1_ontology_guided": GRAPH}})
    assert payload_rows(frame(spark, [None, "", "  ", "nothing", json.dumps(GRAPH)[:-9], "[1, 2]", failed, null_exp, other])).collect() == []
    assert payload_rows(frame(spark, [])).collect() == []


def test_shape_and_keys(spark):
    p = nested.read_payloads(frame(spark, [json.dumps(GRAPH)]))
    e = p.shape.below["entities"]
    assert e.kinds == nested.ARRAY | nested.OBJECT | nested.STRING | nested.NULL and e.below["id"].kinds == nested.STRING
    assert p.shape.below["relationships"].kinds == nested.OBJECT and ("relationships",) in p.levels
    parents = {(r.payload_id, r.pos1) for r in p.table(nested.ENTITIES).collect()}
    assert {(r.payload_id, r.pos1) for r in p.table(nested.PROVENANCE).collect()} <= parents


def test_the_schema_says_what_is_a_level(spark):
    """A list that no contract names, lists in lists, odd names, and a place that only ever holds single values."""
    g = {"entities": [{"id": "a", "tags": ["x", None, ["y", ["z"]]], "it's": {"odd?": [{"v": 1}]}, "note": {"one": 1}}], "log": {"steps": [1, 2]}}
    p = nested.read_payloads(frame(spark, [json.dumps(g)]))
    assert p.levels == [("entities",), ("entities", "tags"), ("log", "steps"), ("entities", "it's", "odd?"), ("entities", "tags", "[]"), ("entities", "tags", "[]", "[]")]
    got = {(p.levels[r.level], r.pos1, r.pos2, r.pos3, r.pos4) for r in p.rows(values=False).collect()}
    assert got == {
        (("entities",), 0, -1, -1, -1), (("entities", "tags"), 0, 0, -1, -1), (("entities", "tags"), 0, 2, -1, -1), (("entities", "tags", "[]"), 0, 2, 0, -1), (("entities", "tags", "[]"), 0, 2, 1, -1),
        (("entities", "tags", "[]", "[]"), 0, 2, 1, 0), (("entities", "it's", "odd?"), 0, 0, -1, -1), (("log", "steps"), 0, -1, -1, -1), (("log", "steps"), 1, -1, -1, -1),
    }
    assert [r.v for r in p.table(("entities", "it's", "odd?")).collect()] == [1] and [r["note.one"] for r in p.table(("entities",)).select("`note.one`").collect()] == [1]
    counts = {r.level: (r.n_rows, r.n_payloads) for r in nested.level_counts(frame(spark, [json.dumps(g)])).collect()}
    assert counts["log.steps"] == (2, 1) and counts["entities.tags.[]"] == (2, 1)


def test_without_a_schema_there_are_no_rows(spark, monkeypatch):
    monkeypatch.setattr(nested, "infer_shape", lambda *a: nested.Node())
    assert payload_rows(frame(spark, [json.dumps(GRAPH)])).count() == 0


def test_open_key_sets_are_one_map(spark):
    many = [json.dumps({"entities": [{"id": "a", "by": {f"k{i}_{j}": i for j in range(300)}}]}) for i in range(5)]
    p = nested.read_payloads(frame(spark, many).repartition(3))
    assert list(p.shape.below["entities"].below["by"].below) == [nested.MAP]
    t = p.table(nested.ENTITIES)
    assert dict(t.dtypes)["by"] == "variant" and t.count() == 5


def test_lists_in_maps_are_levels_and_the_contract_is_no_map(spark):
    """More than a thousand keys beside the fields of the contract, and lists as values of a map and further down."""
    wide = {f"k{j:04d}": {"x": [j, j]} for j in range(1200)} | {"input_variables": ["u", "w"], "disaggregations": [{"members": ["n"]}]}
    by = {f"m{j:04d}": [j, None, {"v": j}] if j % 2 else j for j in range(1100)}
    g = {"entities": [{"id": "a", "properties": json.dumps(wide)}, {"id": "b", "by": by}]}
    f = frame(spark, [json.dumps(g)])
    got = {(r.kind, r.pos1, r.pos2, r.pos3) for r in payload_rows(f).collect()}
    assert got == {("entity", 0, -1, -1), ("entity", 1, -1, -1), ("input_variable", 0, 0, -1), ("input_variable", 0, 1, -1), ("disaggregation", 0, 0, -1), ("disaggregation_member", 0, 0, 0)}
    counts = {r.level: r.n_rows for r in nested.level_counts(f).collect()}
    assert counts == {
        "entities": 2, "entities.properties.input_variables": 2, "entities.properties.disaggregations": 1, "entities.properties.disaggregations.members": 1, "entities.properties.{}": 1200,
        "entities.properties.{}.x": 2400, "entities.by.{}": 1100, "entities.by.{}.[]": 550 * 2 + 550,
    }
    p = nested.read_payloads(f)
    keys = {(r.pos1, r.pos2): r.key for r in p.table(("entities", "properties", "{}")).collect()}
    assert all(keys[r.pos1, r.pos2] == f"k{int(r.value):04d}" for r in p.table(("entities", "properties", "{}", "x")).collect()) and len(keys) == 1200


def test_flat_tables_have_the_fields_as_typed_columns(spark):
    g = {
        "entities": [
            {"id": "a", "rank": 1, "ok": True, "mixed": 1, "properties": json.dumps({"unit": "t", "deep": {"x": 2.5}}), "provenance": [{"s": 1}, {"s": 2, "p": "q"}]},
            {"id": "b", "rank": None, "mixed": "m", "properties": {"unit": "kg", "input_variables": ["u", "w"]}},
        ],
        "relationships": [{"subject": "a", "object": "b"}],
    }
    p = nested.read_payloads(frame(spark, [json.dumps(g)]))
    e = p.table(nested.ENTITIES)
    kinds = dict(e.dtypes)
    assert (kinds["id"], kinds["rank"], kinds["ok"], kinds["mixed"], kinds["properties.deep.x"]) == ("string", "bigint", "boolean", "variant", "double")
    got = {r["id"]: (r["pos1"], r["rank"], r["ok"], r["properties.unit"], r["properties.deep.x"]) for r in e.drop("mixed").collect()}
    assert got == {"a": (0, 1.0, True, "t", 2.5), "b": (1, None, None, "kg", None)}
    assert {(r.pos1, r.pos2, r.s, r.p) for r in p.table(nested.PROVENANCE).collect()} == {(0, 0, 1.0, None), (0, 1, 2.0, "q")}
    assert {(r.pos1, r.pos2, r.value) for r in p.table(nested.INPUTS).collect()} == {(1, 0, "u"), (1, 1, "w")}
    assert {(r.subject, r.object) for r in p.table(nested.RELATIONSHIPS).collect()} == {("a", "b")}
    assert p.table(nested.MEMBERS).count() == 0
