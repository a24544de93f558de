import random
from datetime import datetime, timedelta

from tessella.operators.orphans import OrphanState, find_orphans, snapshots

ENT = "rec_id long, doc_id string, id string, op string, ingested_at timestamp_ntz, status string"
REL = "rel_id long, doc_id string, subject string, object string, ingested_at timestamp_ntz, endpoint string"
T0 = datetime(2024, 1, 1)


def data(seed, n=150):
    rng = random.Random(seed)
    at = lambda: rng.choice([None, *[T0 + timedelta(days=i) for i in range(60)]])
    name = lambda: rng.choice([None, "", " ", " ", *"abcdefgh"])
    ents = [(i, rng.choice(["x", "y", None]), name(), rng.choice(["upsert", "upsert", "delete"]), at(), "s") for i in range(n // 3)]
    rels = [(i, rng.choice(["x", "y", None]), name(), name(), at(), "e") for i in range(n)]
    return ents, rels


def brute(ents, rels):
    out = {}
    for rid, doc, s, o, at, _ in rels:
        for end, ref in (("subject", s), ("object", o)):
            if ref is None or not ref.strip():
                continue
            rows = [e for e in ents if doc is not None and e[1] == doc and e[2] == ref]
            ups = [e[4] for e in rows if e[3] == "upsert" and e[4] is not None]
            last = max(rows, key=lambda e: (e[4] is not None, e[4] or T0, e[0]), default=None)
            status = "missing" if not ups else "deleted" if last[3] == "delete" else "resolved" if at is not None and min(ups) <= at else "late"
            out[rid, end] = status
    return out


def rows(df):
    got = [((r.rel_id, r.endpoint), r.status) for r in df.collect()]
    assert len(got) == len(dict(got))
    return dict(got)


def test_one_batch(spark):
    ents, rels = data(1)
    assert rows(find_orphans(spark.createDataFrame(rels, REL), spark.createDataFrame(ents, ENT))) == brute(ents, rels)


def test_batches_end_in_the_same_state(spark):
    ents, rels = data(2)
    state = OrphanState(spark, 5)
    for part in range(3):
        before = state
        state = state.advance(spark.createDataFrame(ents[part::3], ENT), spark.createDataFrame(rels[part::3], REL))
        before.release(state)
        done_e, done_r = [e for p in range(part + 1) for e in ents[p::3]], [r for p in range(part + 1) for r in rels[p::3]]
        assert rows(state.all_refs()) == brute(done_e, done_r)
    want = brute(ents, rels)
    snap = state.snapshot().collect()
    assert sum(r.missing + r.late + r.deleted for r in snap) == sum(v != "resolved" for v in want.values())
    assert sum(r.references for r in snap) == len(want)


def test_a_batch_leaves_the_buckets_of_other_keys_alone(spark):
    ents, rels = data(5)
    state = OrphanState(spark, 16).advance(spark.createDataFrame(ents, ENT), spark.createDataFrame(rels, REL))
    after = state.advance(spark.createDataFrame([(900, "x", "a", "delete", T0 + timedelta(days=90), "s")], ENT), spark.createDataFrame([], REL))
    assert sum(after.refs[b] != state.refs[b] for b in state.refs) == 1 and sum(after.parents[b] != state.parents[b] for b in state.parents) == 1
    want = brute([*ents, (900, "x", "a", "delete", T0 + timedelta(days=90), "s")], rels)
    assert rows(after.all_refs()) == want and "deleted" in want.values()


def test_snapshots_at_the_end_of_each_period(spark):
    ents, rels = data(6)
    got = {}
    for r in snapshots(spark.createDataFrame(rels, REL), spark.createDataFrame(ents, ENT), "month").collect():
        a = got.setdefault(r.as_of, [0, 0])
        a[0] += r.missing + r.late + r.deleted
        a[1] += r.references
    for as_of, end in (("0000", T0), ("2024-01-01", datetime(2024, 2, 1)), ("2024-02-01", datetime(2024, 3, 1))):
        so_far = lambda rows: [r for r in rows if r[4] is None or (r[4] < end and as_of != "0000")]  # noqa: E731, B023
        want = brute(so_far(ents), so_far(rels))
        assert got[as_of] == [sum(v != "resolved" for v in want.values()), len(want)]


def test_empty_tables(spark):
    ents, rels = data(3, 9)
    no_e, no_r = spark.createDataFrame([], ENT), spark.createDataFrame([], REL)
    assert find_orphans(no_r, spark.createDataFrame(ents, ENT)).collect() == []
    assert find_orphans(no_r, no_e).collect() == [] and snapshots(no_r, no_e).collect() == []
    assert set(rows(find_orphans(spark.createDataFrame(rels, REL), no_e)).values()) == {"missing"}
