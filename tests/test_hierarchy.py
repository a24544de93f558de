import random

from pyspark.sql import functions as F

from tessella.operators.hierarchy import closure, descendants, hierarchy

SCHEMA = "rel_id long, doc_id string, subject string, predicate string, object string, depth int, path string"


def brute(rows):
    parent, nodes = {}, set()
    for _, doc, s, p, o, *_ in rows:
        if s and o and p and p.lower().replace("-", "").replace(" ", "") in ("consistof", "include"):
            parent[doc, o] = min(parent.get((doc, o), s), s)
            nodes |= {(doc, s), (doc, o)}
    out = set()
    for n in nodes:
        x, seen = n, []
        while x in parent and x not in seen:
            seen.append(x)
            x = (x[0], parent[x])
        out.add((*n, "", -1) if x in seen else (*n, x[1], len(seen)))
    return out


def forest(rng, n):
    rows = []
    for i in range(n):
        doc = rng.choice(["d1", "d2", None])
        kind = rng.random()
        parent = f"n{rng.randrange(i)}" if i and kind < 0.8 else f"n{rng.randrange(n)}"
        rows.append((i, doc, parent, rng.choice(["ConsistOf", "consist-of", "Include", "Other", None]), f"n{i}", 1, "x"))
    return rows


def check(spark, rows, size):
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in hierarchy(df, size).select("doc_id", "node_id", "root_id", "depth").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_random_forests(spark):
    rng = random.Random(3)
    for n, size in ((60, 1000), (200, 40), (200, 9)):
        check(spark, forest(rng, n), size)


def test_deep_chain_and_long_ring_over_many_partitions(spark):
    chain = [(i, "d", f"c{i}", "ConsistOf", f"c{i + 1}", 1, "") for i in range(300)]
    ring = [(1000 + i, "d", f"r{i}", "Include", f"r{(i + 1) % 90}", 1, "") for i in range(90)] + [(2000, "d", "r5", "Include", "below", 1, "")]
    order = list(range(300))
    random.Random(4).shuffle(order)
    scattered = [(10_000 + order[i], "e", f"c{i}", "ConsistOf", f"c{i + 1}", 1, "") for i in range(300)]
    check(spark, chain + ring + scattered, 25)


def test_self_loop_repeats_blanks_and_empty(spark):
    rows = [(1, "d", "a", "Include", "a", 0, ""), (2, "d", "a", "Include", "b", 0, ""), (3, "d", "x", "Include", "y", 0, ""), (4, "d", "x", "Include", "y", 0, ""), (5, "d", "", "Include", "z", 0, ""), (6, "d", None, "Include", "q", 0, "")]
    check(spark, rows, 100)
    assert hierarchy(spark.createDataFrame([], SCHEMA)).collect() == []


def test_paths_and_descendants(spark):
    rows = [(1, "d", "a", "Include", "b", 0, ""), (2, "d", "b", "Include", "c", 0, ""), (3, "d", "b", "Include", "e", 0, ""), (4, "d", "r", "Include", "s", 0, ""), (5, "d", "s", "Include", "r", 0, "")]
    for size in (100, 1):
        tree = hierarchy(spark.createDataFrame(rows, SCHEMA), size, paths=True)
        assert {r.node_id: r.path for r in tree.collect()} == {"a": ["a"], "b": ["a", "b"], "c": ["a", "b", "c"], "e": ["a", "b", "e"], "r": None, "s": None}
        below = descendants(spark.createDataFrame(rows, SCHEMA), size)
        assert {(r.node_id, r.n_descendants, r.height) for r in below.collect()} == {("a", 3, 2), ("b", 2, 1), ("c", 0, 0), ("e", 0, 0)}
        assert {(r.ancestor_id, r.node_id, r.distance) for r in closure(tree).collect()} == {("a", "b", 1), ("a", "c", 2), ("a", "e", 2), ("b", "c", 1), ("b", "e", 1)}


def test_registered_closure_lists_every_descendant(spark, tmp_path):
    from tessella.plans import catalog

    rows = [(1, "d", "a", "Include", "b", 0, ""), (2, "d", "b", "Include", "c", 0, ""), (3, "d", "b", "Include", "e", 0, ""), (4, "d", "r", "Include", "s", 0, ""), (5, "d", "s", "Include", "r", 0, ""), (6, "x", "b", "Include", "a", 0, "")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "kg_relationships.parquet"))
    got = sorted(tuple(r) for r in catalog.queries()["p2_closure"](spark, str(tmp_path)).collect())
    assert got == [("d", "a", "b", 1), ("d", "a", "c", 2), ("d", "a", "e", 2), ("d", "b", "c", 1), ("d", "b", "e", 1), ("x", "b", "a", 1)]
    assert "p2_closure" in catalog.oracle_sql()


def test_descendants_of_random_forests(spark):
    rng = random.Random(8)
    rows = forest(rng, 150)
    tree = brute(rows)
    parent = {}
    for _, doc, s, p, o, *_ in rows:
        if p and p.lower().replace("-", "") in ("consistof", "include"):
            parent[doc, o] = min(parent.get((doc, o), s), s)
    want = {(d, n): [0, 0] for d, n, root, depth in tree if depth >= 0}
    for d, n in list(want):
        x, k = (d, n), 0
        while x in parent:
            x, k = (x[0], parent[x]), k + 1
            want[x] = [want[x][0] + 1, max(want[x][1], k)]
    for size in (1000, 40, 12):
        got = {(r.doc_id, r.node_id): [r.n_descendants, r.height] for r in descendants(spark.createDataFrame(rows, SCHEMA), size).collect()}
        assert got == want


def test_a_very_deep_chain_is_many_fragments(spark):
    n = 200_000
    rows = spark.range(n).selectExpr("id AS rel_id", "'d' AS doc_id", "concat('c', id) AS subject", "'Include' AS predicate", "concat('c', id + 1) AS object")
    got = hierarchy(rows, 30_000).agg(F.max("depth"), F.sum("depth"), F.countDistinct("root_id")).first()
    assert tuple(got) == (n, n * (n + 1) // 2, 1)
