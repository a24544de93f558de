import random
from collections import defaultdict

from tessella.operators.intervals import page_periods, sweep

SCHEMA = "doc_id string, run_id string, page_start int, page_end int, x string, d int"


def brute(rows):
    pages = defaultdict(set)
    for doc, run, a, b, *_ in rows:
        if a is not None and b is not None and a <= b:
            pages[doc, run].update(range(a, b + 1))
    out = set()
    for key, s in pages.items():
        if not s:
            continue
        s = sorted(s)
        start = prev = s[0]
        for p in [*s[1:], None]:
            if p is None or p > prev + 1:
                out.add((*key, "period", start, prev))
                if p is not None:
                    out.add((*key, "gap", prev + 1, p - 1))
                    start = p
            prev = p
    return out


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), rng.choice(["r", "s", None]), rng.choice([None, *range(60)]), rng.choice([None, *range(60)]), "x", 1) for _ in range(300)]
    rows = [(a, b, c, None if e is None or c is None else min(e, c + 3), x, d) for a, b, c, e, x, d in rows]
    got = {tuple(r) for r in page_periods(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_small_buckets_give_the_same(spark):
    rng = random.Random(2)
    rows = [("a", "r", s := rng.randrange(500), s + rng.randrange(4), "", 0) for _ in range(150)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {(r.kind, r.range_from, r.range_to) for r in sweep(df, ["doc_id", "run_id"], "page_start", "page_end").collect()}
    got = {(r.kind, r.range_from, r.range_to) for r in sweep(df, ["doc_id", "run_id"], "page_start", "page_end", bucket=7).collect()}
    assert got == want == {x[2:] for x in brute(rows)}


def test_neighbours_repeats_and_extremes(spark):
    rows = [("a", "r", 1, 2, "", 0), ("a", "r", 3, 4, "", 0), ("a", "r", 3, 4, "", 0), ("a", "r", 2147483647, 2147483647, "", 0), ("b", "r", 5, 4, "", 0)]
    got = {tuple(r) for r in page_periods(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("a", "r", "period", 1, 4), ("a", "r", "gap", 5, 2147483646), ("a", "r", "period", 2147483647, 2147483647)}


def test_empty(spark):
    assert page_periods(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sparse_places_share_buckets(spark):
    """Boundaries far apart, as times are: the same result as with one bucket, in few buckets a key."""
    rng = random.Random(9)
    rows = [("k", t, t + rng.randrange(10**8)) for t in (rng.randrange(10**12) for _ in range(400))]
    df = spark.createDataFrame(rows, "k string, a long, b long")
    own = {tuple(r) for r in sweep(df, ["k"], "a", "b").collect()}
    assert own == {tuple(r) for r in sweep(df, ["k"], "a", "b", bucket=10**13).collect()} and len(own) > 300
