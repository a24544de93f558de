import random
import unicodedata

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import dedup

SCHEMA = "rec_id long, label string, type string, keep_id long, lo long"


def fold(s):
    return "".join(c.casefold() if len(c.casefold()) == 1 else c.lower()[0] for c in s or "" if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd")


def brute(rows):
    groups = {}
    for rec, a, b, *_ in rows:
        x, y = fold(a), fold(b)
        if x and y:
            groups.setdefault(tuple(sorted((x, y))), []).append(rec)
    return {(min(g), r) for g in groups.values() for r in g if r != min(g)}


def spellings(rng, s):
    return "".join(rng.choice(["", " ", "_", "​", "\n", "«"]) + (c.upper() if rng.random() < 0.4 else c) for c in s)


def rows(n=300):
    rng = random.Random(7)
    words = ["Ålund port 1", "water", "x" * 5000, "", " — ", None, "Metric", "ﬁne", "日本", "1 2"]
    out = []
    for i in range(n):
        a, b = rng.choice(words), rng.choice(words)
        a, b = (None if a is None else spellings(rng, a)), (None if b is None else spellings(rng, b))
        out.append((i, *((a, b) if rng.random() < 0.5 else (b, a)), 1, 1))
    return out


def test_against_brute_force(spark):
    data = rows()
    got = [tuple(r) for r in dedup.find_copies(spark.createDataFrame(data, SCHEMA), "rec_id", "label", "type").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(data)


def test_collapse_counts_every_row_once(spark):
    data = rows()
    got = dedup.collapse(spark.createDataFrame(data, SCHEMA), "rec_id", "label", "type").collect()
    assert sum(r.n_copies for r in got) == sum(bool(fold(a) and fold(b)) for _, a, b, *_ in data)


def test_true_collisions_are_told_apart(spark, monkeypatch):
    # hashes that all collide: only the comparison of characters is left
    def flat(batches):
        import pyarrow as pa

        for b in batches:
            same = pa.array([1] * b.num_rows, pa.int64())
            keep = pa.array([True] * b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("rec"), same, same, b.column("a"), b.column("b")], names=["rec", "lo", "hi", "a", "b"]).filter(keep)

    monkeypatch.setattr(dedup, "_hashed", flat)
    data = [(i, w, "t", 0, 0) for i, w in enumerate(["a", "b", "A", "c", "B!", "a"])] + [(9, "T", "a.", 0, 0)]
    got = {tuple(r) for r in dedup.find_copies(spark.createDataFrame(data, SCHEMA), "rec_id", "label", "type").collect()}
    assert got == brute(data)


def test_empty(spark):
    assert dedup.find_copies(spark.createDataFrame([], SCHEMA), "rec_id", "label", "type").collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=1, max_size=8))
def test_hash_and_comparison_agree_with_folding(texts):
    arr = pa.array([*texts, None], pa.string())
    h = dedup.poly_hash(arr)
    folded = [fold(t) for t in texts] + [""]
    for i, x in enumerate(folded):
        assert (h[i] == -1) == (x == "")
        same = dedup.skip_equal(pa.array([arr[i].as_py()] * len(arr), pa.string()), arr)
        assert [bool(s) for s in same] == [x == y for y in folded]
        assert all((h[i] == h[j]) or x != y for j, y in enumerate(folded))
