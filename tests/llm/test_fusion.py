import json
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tessella.llm import fusion

SCHEMA = "rec_id long, doc_id string, id string, label string, properties string, provenance map<string,string>, op string, field string, at long"


def frame(spark, rows):
    return spark.createDataFrame([(i, d, e, label, p, v, op, "clash", 0) for i, (d, e, label, p, v, op) in enumerate(rows)], SCHEMA)


def us(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp() * 1_000_000)


TIMES = [
    ("2024-01-05T16:26:58.366814", us(2024, 1, 5, 16, 26, 58, 366814)), ("2024-01-05 16:26:58", us(2024, 1, 5, 16, 26, 58)), ("2024/01/05 16:26:58", us(2024, 1, 5, 16, 26, 58)),
    ("2024-01-05T16:26:58Z", us(2024, 1, 5, 16, 26, 58)), ("2024-01-05T16:26:58+02:00", us(2024, 1, 5, 14, 26, 58)), ("2024-01-05T16:26:58-0700", us(2024, 1, 5, 23, 26, 58)), ("05 Jan 2024 16:26:58", us(2024, 1, 5, 16, 26, 58)),
    ("1704472018", 1704472018 * 10**6), ("1704472018123", 1704472018123 * 1000), ("2024-01-05", us(2024, 1, 5)), ("unknown", None), ("", None), ("2024-13-40 99:00:00", None), ("12", None), (None, None),
]


def test_instants(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TIMES)], "i int, t string").orderBy("i")
    assert [r.x for r in df.select(fusion.instant(F.col("t")).alias("x")).collect()] == [w for _, w in TIMES]


@pytest.mark.parametrize(
    ("value", "want"),
    [("x", True), (" ", False), ("", False), ("N/A", False), ("n.a.", False), ("Not Specified", False), ("—", False), ("?", False), ("TBD", False), ("none of the sites", True), (None, False), ([], False), (["", None, "NA"], False), (["", "x"], True), (0, True), (False, True), ({"a": 1}, True)],
)
def test_values_that_count(spark, value, want):
    got = spark.range(1).select(fusion.value_counts(F.try_parse_json(F.lit(json.dumps(value)))).alias("x")).first().x
    assert got is want


def test_latest_value_of_each_field_wins(spark):
    t = lambda x: {"extraction_timestamp": x}
    rows = [
        ("d", "a", "old", json.dumps({"unit": "t", "code": "C1", "x": []}), t("2024-01-01"), "upsert"),
        ("d", "a", "N/A", json.dumps({"unit": "TBD", "code": "C2"}), t("2024-03-01"), "upsert"),
        ("d", "a", "new", None, t("2024-02-01"), "upsert"),
        ("d", "a", "gone", json.dumps({"unit": "kg"}), t("2025-01-01"), "delete"),
        ("d", "b", "tie", "{broken", t("1704067200"), "upsert"), ("d", "b", "tie2", "[1]", t("2024-01-01T00:00:00Z"), "upsert"), ("d", "b", "no time", "null", None, "upsert"),
        ("d", "single", "x", None, None, "upsert"), ("d", None, "x", None, None, "upsert"), ("d", None, "y", None, None, "upsert"),
        (None, "n", "p", None, {}, "upsert"), (None, "n", "q", None, None, "upsert"), ("d", "empty", "?", "{}", None, "upsert"), ("d", "empty", None, None, None, "upsert"),
    ]
    got = {(r.keep_id, r.field, r.rec_id) for r in fusion.latest(frame(spark, rows)).collect()}
    assert got == {(0, "label", 2), (0, "unit", 0), (0, "code", 1), (4, "label", 4), (10, "label", 10)}
    assert fusion.latest(frame(spark, [])).collect() == []


def test_hot_group(spark):
    rng = random.Random(1)
    rows = [("d", "hot", f"v{i}", json.dumps({"k": i}), {"extraction_timestamp": str(1_700_000_000 + rng.randrange(10**6))}, "upsert") for i in range(400)]
    best = max(range(400), key=lambda i: (int(rows[i][4]["extraction_timestamp"]), -i))
    assert {(r.keep_id, r.field, r.rec_id) for r in fusion.latest(frame(spark, rows)).collect()} == {(0, "label", best), (0, "k", best)}


def test_fusion_discounts_copied_votes(spark):
    """Two copiers repeat a bad source. Where four good sources speak they are found out; where only two
    do, three equal votes must not outweigh them."""
    rows = []
    for i in range(60):
        p = lambda s, k: {"segment_id": s, "extraction_timestamp": f"2024-01-01 00:00:{k:02d}"}
        good = ["g1", "g2", "g3", "g4"] if i < 40 else ["g1", "g2"]
        rows += [("d", f"e{i}", "right", None, p(g, k), "upsert") for k, g in enumerate(good)]
        rows += [("d", f"e{i}", "false" if i % 2 else "right", None, p(s, 10 + k), "upsert") for k, s in enumerate(("bad", "c1", "c2"))]
    got = fusion.fuse(frame(spark, rows)).collect()
    assert len(got) == 60 and all(r.value == "right" for r in got)


def test_fusion_has_the_fields_of_latest(spark):
    rows = [("d", "a", "x", json.dumps({"u": "1"}), {"segment_id": "s"}, "upsert"), ("d", "a", "y", None, None, "upsert"), ("d", "b", "y", None, None, "upsert")]
    df = frame(spark, rows)
    assert {(r.keep_id, r.field) for r in fusion.fuse(df).collect()} == {(r.keep_id, r.field) for r in fusion.latest(df).collect()}
    assert fusion.fuse(frame(spark, [])).collect() == []


def test_planted_truth_is_found_better_than_by_counting_votes(spark):
    """Sources of known accuracy, four copiers of one bad source, segments of one name in two documents."""
    rng = random.Random(11)
    rows, truth, votes = [], {}, {}
    for d, accuracy in (("d1", {"s1": 0.9, "s2": 0.9, "s3": 0.85, "bad": 0.3}), ("d2", {"s1": 0.3, "s2": 0.9, "s3": 0.9, "bad": 0.95})):
        for i in range(150):
            said = {s: f"v{i}" if rng.random() < a else f"x{i}_{rng.randrange(10)}" for s, a in accuracy.items()}
            if d == "d1":
                said |= {f"c{k}": said["bad"] for k in range(4)}
            key = len(rows)
            truth[key] = f"v{i}"
            for k, (s, v) in enumerate(said.items()):
                rows.append((d, f"e{i}", v, None, {"segment_id": s, "extraction_timestamp": f"2024-01-01 00:00:{k:02d}"}, "upsert"))
                votes.setdefault(key, []).append(v)
    got = {r.keep_id: r.value for r in fusion.fuse(frame(spark, rows)).where("field = 'label'").collect()}
    right = sum(got[k] == v for k, v in truth.items()) / len(truth)
    counted = sum(max(sorted(set(votes[k])), key=votes[k].count) == v for k, v in truth.items()) / len(truth)
    assert right >= 0.93 and right > counted + 0.2


def test_rows_without_a_segment_are_no_common_source(spark):
    rows = [("d", f"e{i}", f"a{i}", None, None, "upsert") for i in range(30)] + [("d", f"e{i}", f"b{i}", None, None, "upsert") for i in range(30)]
    rows += [("d", f"e{i}", f"b{i}", None, {}, "upsert") for i in range(30)]
    got = {r.keep_id: r.value for r in fusion.fuse(frame(spark, rows)).collect()}
    assert got == {i: f"b{i}" for i in range(30)}


def test_fusion_of_a_hot_item(spark):
    rows = [("d", "hot", f"v{i % 3}", None, {"segment_id": f"s{i}"}, "upsert") for i in range(301)]
    r = fusion.fuse(frame(spark, rows)).collect()
    assert [(x.value, x.n_values) for x in r] == [("v0", 3)]
