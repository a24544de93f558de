"""Parent-child links to full hierarchies by recursive contraction.

Links are laid out so that neighbours in the source stay together. Each partition follows its own
parent chains to the first node whose parent lies elsewhere (the exit of the fragment). Only exits
that have a parent themselves form the quotient forest, which is solved the same way and is smaller;
then every node adds the solution of its exit to its own distance. Rings inside a partition are found
by following chains further than there are rows; longer rings shrink until they lie in one partition.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import hot_join, stage
from tessella.vocab import is_ontology_predicate

PARTITION_ROWS = 250_000
# A forest of no more rows than these is solved in one piece: the end of the recursion.
LAST_ROWS = 4_096
SHRINK = 0.7
# Ids in one batch of paths.
PATH_IDS = 1_000_000


def links(rels: DataFrame) -> DataFrame:
    """(doc_id, node, parent, ord): one row for each child. Links count once however often repeated; if
    a child has several parents against the contract, the smallest parent in string order is taken."""
    named = rels.where("subject is not null and subject <> '' and object is not null and object <> ''").where(is_ontology_predicate(F.col("predicate")))
    return named.groupBy("doc_id", F.col("object").alias("node")).agg(F.min("subject").alias("parent"), F.min("rel_id").alias("ord"))


class Fragment:
    """The rows of one partition and the parent chains among them."""

    def __init__(self, batches: list[pa.RecordBatch]):
        self.table = pa.Table.from_batches(batches).combine_chunks()
        self.doc, self.node, self.parent = (self.table.column(c).combine_chunks() for c in ("doc_id", "node", "exit"))
        self.n = self.table.num_rows
        tag = pc.fill_null(pc.binary_join_element_wise("d", self.doc, ""), "n")
        keys = pc.binary_join_element_wise(tag, self.node, "\x1f")
        self.up = pc.fill_null(pc.index_in(pc.binary_join_element_wise(tag, self.parent, "\x1f"), value_set=keys), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.last = self.up < 0

    def numbers(self, name: str) -> np.ndarray:
        return self.table.column(name).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)

    def climb(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(top, distance, ring): the last row of each chain within the fragment and the sum of the weights below it;
        a row that never gets to an end goes round in a ring or hangs on one."""
        own = np.arange(self.n)
        top, gone = np.where(self.last, own, self.up), np.where(self.last, 0, weight)
        for _ in range(max(1, math.ceil(math.log2(self.n + 1)) + 1)):
            gone = gone + gone[top]
            top = top[top]
        return top, gone, ~self.last[top]

    def sums(self, depth: np.ndarray, ring: np.ndarray, size: np.ndarray, reach: np.ndarray, weight: np.ndarray) -> tuple[list[int], list[int]]:
        """Size and reach of the part of each row's subtree that lies in the fragment, from the deepest row up."""
        sizes, reaches, up, w = size.tolist(), reach.tolist(), self.up.tolist(), weight.tolist()
        for i in np.argsort(-depth, kind="stable").tolist():
            j = up[i]
            if j >= 0 and not ring[i]:
                sizes[j] += sizes[i]
                reaches[j] = max(reaches[j], reaches[i] + w[i])
        return sizes, reaches

    def paths(self, depth: np.ndarray, ring: np.ndarray) -> Iterator[pa.Array]:
        """The path of each row from the top of its chain, batch by batch; null for rings.

        Rows are laid out so that the heaviest chain through each subtree lies in one stretch; a path is a
        few stretches, however deep it is."""
        n, up = self.n, self.up.tolist()
        ones = np.ones(n, dtype=np.int64)
        sizes, _ = self.sums(depth, ring, ones, ones, ones)
        heavy = [-1] * n
        down = np.argsort(depth, kind="stable").tolist()
        for i in down:
            j = up[i]
            if j >= 0 and not ring[i] and (heavy[j] < 0 or sizes[i] > sizes[heavy[j]]):
                heavy[j] = i
        head = list(range(n))
        for i in down:
            if up[i] >= 0 and not ring[i] and heavy[up[i]] == i:
                head[i] = head[up[i]]
        order = np.lexsort((depth, np.array(head, dtype=np.int64)))
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        below = self.table.column("path").combine_chunks().take(pa.array(order))
        ends, values = below.offsets.to_numpy(), below.values
        spans: list[np.ndarray] = []
        lengths: list[int] = []
        held = 0

        def batch() -> pa.Array:
            offsets = np.concatenate([[0], np.cumsum([max(0, x) for x in lengths])])
            mask = pa.array([x < 0 for x in lengths])
            ids = values.take(pa.array(np.concatenate(spans))) if spans else pa.array([], pa.string())
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ids, mask=mask)

        for i in range(n):
            if ring[i]:
                lengths.append(-1)
                continue
            parts, j = [], i
            while j >= 0:
                h = head[j]
                parts.append(np.arange(ends[place[h]], ends[place[j] + 1]))
                j = up[h]
            spans += parts[::-1]
            lengths.append(sum(map(len, parts)))
            held += lengths[-1]
            if held >= PATH_IDS:
                yield batch()
                spans, lengths, held = [], [], 0
        if lengths:
            yield batch()


def _contractor(paths: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        f = Fragment(got)
        weight = f.numbers("dist")
        top, gone, ring = f.climb(weight)
        exits = pc.if_else(pa.array(ring), pa.scalar(None, pa.string()), pc.take(f.parent, pa.array(top)))
        dist = np.where(ring, -1, gone + weight[top])
        names = ["doc_id", "node", "exit", "dist", "ord"]
        flat = pa.Table.from_arrays([f.doc, f.node, exits, pa.array(dist, pa.int64()), f.table.column("ord").combine_chunks()], names=names)
        if not paths:
            yield from flat.to_batches(max_chunksize=10_000)
            return
        at = 0
        for part in f.paths(f.climb(np.ones(f.n, dtype=np.int64))[1], ring):
            yield from flat.slice(at, len(part)).append_column("path", part).to_batches()
            at += len(part)

    return contract


def _bit(level: int, *cols: str) -> F.Column:
    return F.pmod(F.xxhash64(F.lit(level), *[F.col(c) for c in cols]), F.lit(2))


def _hop(frag: DataFrame, level: int, paths: bool) -> DataFrame:
    """Skip about a quarter of the exits: an exit with coin 1 whose own exit has coin 0 is passed over, so
    nothing needs it any more. Keeps the forest shrinking where the layout has no locality."""
    over = frag.where("exit is not null").where((_bit(level, "doc_id", "node") == 1) & (_bit(level, "doc_id", "exit") == 0))
    over = over.select("doc_id", F.col("node").alias("exit"), F.col("exit").alias("_e"), F.col("dist").alias("_d"), *([F.col("path").alias("_p")] if paths else []))
    got = hot_join(frag, over, ["doc_id", "exit"], "left", spread=F.col("ord"))
    return got.select(
        "doc_id", "node", F.coalesce("_e", "exit").alias("exit"), F.when(F.col("_e").isNotNull(), F.col("dist") + F.col("_d")).otherwise(F.col("dist")).alias("dist"), "ord",
        *([F.when(F.col("_e").isNotNull(), F.concat("_p", "path")).otherwise(F.col("path")).alias("path")] if paths else []),
    )


def _parts(rows: DataFrame, n: int, partition_rows: int) -> int:
    """How many fragments: one for the last few rows, else enough to keep all cores at work and each in bounds."""
    if n <= min(LAST_ROWS, partition_rows):
        return 1
    return max(2 * rows.sparkSession.sparkContext.defaultParallelism if partition_rows > LAST_ROWS else 1, math.ceil(n / partition_rows))


def _solve(rows: DataFrame, n: int, level: int, partition_rows: int, paths: bool) -> DataFrame:
    schema = "doc_id string, node string, exit string, dist long, ord long" + (", path array<string>" if paths else "")
    parts = _parts(rows, n, partition_rows)
    laid = rows.coalesce(1) if parts <= 1 else rows.repartitionByRange(parts, "doc_id", "ord")
    frag = laid.mapInArrow(_contractor(paths), schema)
    if parts <= 1:
        return frag
    frag = stage(frag, f"fragments{level}")
    quotient, m = _quotient(frag)
    if m > SHRINK * n:
        frag = stage(_hop(frag, level, paths), f"hops{level}")
        quotient, m = _quotient(frag)
    if m == 0:
        return frag
    ringed = quotient.where("exit is null")
    solved = _solve(quotient.where("exit is not null"), m, level + 1, partition_rows, paths).unionByName(ringed)
    solved = solved.select("doc_id", F.col("node").alias("exit"), F.col("exit").alias("_e"), F.col("dist").alias("_d"), F.lit(True).alias("_s"), *([F.col("path").alias("_p")] if paths else []))
    out = hot_join(frag, solved, ["doc_id", "exit"], "left", spread=F.col("ord"))
    ring = F.col("_s") & F.col("_e").isNull()
    return out.select(
        "doc_id", "node",
        F.when(F.col("_s"), F.col("_e")).otherwise(F.col("exit")).alias("exit"),
        F.when(ring, F.lit(-1)).when(F.col("_s"), F.col("dist") + F.col("_d")).otherwise(F.col("dist")).alias("dist"),
        "ord",
        *([F.when(ring, None).when(F.col("_s"), F.concat("_p", "path")).otherwise(F.col("path")).alias("path")] if paths else []),
    )


def _quotient(frag: DataFrame) -> tuple[DataFrame, int]:
    wanted = frag.where("exit is not null").select("doc_id", F.col("exit").alias("node")).distinct()
    q = stage(frag.join(wanted, ["doc_id", "node"], "left_semi"), "quotient")
    return q, q.count()


def resolve(edges: DataFrame, partition_rows: int = PARTITION_ROWS, paths: bool = False) -> DataFrame:
    """(doc_id, node_id, root_id, depth[, path]) for every node of ``edges`` (doc_id, node, parent, ord).

    Depth of a root is 0. A node on a ring or below one has ``root_id`` '' and depth -1 (and a null
    path). Ids compare exactly and belong to their ``doc_id``; a null ``doc_id`` is a value of its own as
    long as all its links lie in one partition, so callers with null documents give them a name first.
    Empty input gives no rows. ``path`` runs from the root to the node, both included.
    """
    start = edges.select("doc_id", "node", F.col("parent").alias("exit"), F.lit(1).cast("long").alias("dist"), F.col("ord").cast("long").alias("ord"), *([F.array("node").alias("path")] if paths else []))
    rows = stage(start, "links")
    done = _solve(rows, rows.count(), 0, partition_rows, paths)
    done = stage(done, "resolved")
    ring = F.col("exit").isNull()
    nodes = done.select(
        "doc_id", F.col("node").alias("node_id"), F.when(ring, "").otherwise(F.col("exit")).alias("root_id"), F.when(ring, -1).otherwise(F.col("dist")).cast("int").alias("depth"),
        *([F.when(~ring, F.concat(F.array("exit"), "path")).alias("path")] if paths else []),
    )
    roots = done.where("exit is not null").select("doc_id", F.col("exit").alias("node_id")).distinct()
    roots = roots.select("doc_id", "node_id", F.col("node_id").alias("root_id"), F.lit(0).alias("depth"), *([F.array("node_id").alias("path")] if paths else []))
    return nodes.unionByName(roots)


def hierarchy(rels: DataFrame, partition_rows: int = PARTITION_ROWS, paths: bool = False) -> DataFrame:
    """The hierarchy of a relationships table; see :func:`links` and :func:`resolve`."""
    named = rels.withColumn("_d", F.coalesce(F.concat(F.lit("="), "doc_id"), F.lit("")))
    edges = links(named.drop("doc_id").withColumnRenamed("_d", "doc_id"))
    out = resolve(edges, partition_rows, paths)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != "", F.expr("substring(doc_id, 2)")))


def closure(tree: DataFrame) -> DataFrame:
    """(doc_id, ancestor_id, node_id, distance): every node with all nodes below it, from the paths.
    Nodes on or below a ring have no path and give no rows."""
    below = tree.where("path is not null").select("doc_id", "node_id", "depth", F.posexplode("path").alias("at", "ancestor_id"))
    return below.where("at < depth").select("doc_id", "ancestor_id", "node_id", (F.col("depth") - F.col("at")).alias("distance"))


SIZED = "doc_id string, node string, size long, reach long"


def _sized(rows: DataFrame, n: int, level: int, partition_rows: int, parts: int | None = None) -> DataFrame:
    """(doc_id, node, size, reach) of each subtree of a forest (doc_id, node, exit, dist, ord, size, reach), where a
    row brings a size and a reach of its own and ``dist`` is the length of the link to its parent.

    Each fragment sums its own part of the subtrees; its tops hang below rows of other fragments, so the
    forest of tops is smaller and solved the same way; what comes up from it is added where it hangs and
    each fragment sums once more. Every row is touched a fixed number of times a level. Where a layout
    without locality leaves most rows tops, the next level has a quarter of the fragments."""
    parts = _parts(rows, n, partition_rows) if parts is None else parts

    def local(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Fragment([b for b in batches if b.num_rows])
        one = np.ones(f.n, dtype=np.int64)
        _, depth, ring = f.climb(one)
        size, reach = f.sums(depth, ring, f.numbers("size"), f.numbers("reach"), f.numbers("dist"))
        yield from pa.Table.from_arrays([f.doc, f.node, pa.array(size, pa.int64()), pa.array(reach, pa.int64())], names=["doc_id", "node", "size", "reach"]).to_batches(max_chunksize=10_000)

    def tops(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Fragment([b for b in batches if b.num_rows])
        top, depth, ring = f.climb(np.ones(f.n, dtype=np.int64))
        _, far, _ = f.climb(f.numbers("dist"))
        size, reach = f.sums(depth, ring, f.numbers("size"), f.numbers("reach"), f.numbers("dist"))
        cols = [f.doc, f.node, pc.take(f.node, pa.array(top)), f.parent, pa.array(f.numbers("dist")), f.table.column("ord").combine_chunks(), pa.array(size, pa.int64()), pa.array(reach, pa.int64()), pa.array(far), pa.array(f.last)]
        yield from pa.Table.from_arrays(cols, names=["doc_id", "node", "top", "exit", "dist", "ord", "size", "reach", "far", "is_top"]).to_batches(max_chunksize=10_000)

    if parts <= 1:
        return rows.withColumn("_p", F.lit(0)).groupBy("_p").applyInArrow(local, SIZED)
    laid = stage(rows.repartitionByRange(parts, "doc_id", "ord").withColumn("_p", F.spark_partition_id()), f"sized{level}")
    parted = laid.groupBy("_p")
    known = stage(parted.applyInArrow(tops, "doc_id string, node string, top string, exit string, dist long, ord long, size long, reach long, far long, is_top boolean"), f"tops{level}")
    where = known.select("doc_id", F.col("node").alias("exit"), F.col("top").alias("_top"), F.col("far").alias("_far"))
    hung = hot_join(known.where("is_top"), where, ["doc_id", "exit"], "left", spread=F.col("ord"))
    hung = stage(hung.select("doc_id", "node", F.col("_top").alias("exit"), (F.col("dist") + F.coalesce("_far", F.lit(0))).alias("dist"), "ord", "size", "reach", F.col("exit").alias("hook"), F.col("dist").alias("own")), f"hung{level}")
    m = hung.count()
    solved = _sized(hung.drop("hook", "own"), m, level + 1, partition_rows, None if m < SHRINK * n else max(1, parts // 4))
    up = hung.select("doc_id", "node", "hook", "own").join(solved, ["doc_id", "node"])
    added = up.groupBy("doc_id", F.col("hook").alias("node")).agg(F.sum("size").alias("_s"), F.max(F.col("reach") + F.col("own")).alias("_r"))
    full = laid.join(added, ["doc_id", "node"], "left")
    full = full.withColumn("size", F.col("size") + F.coalesce("_s", F.lit(0))).withColumn("reach", F.greatest("reach", F.coalesce("_r", F.lit(0)))).drop("_s", "_r")
    return full.groupBy("_p").applyInArrow(local, SIZED)


def descendants(rels: DataFrame, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """(doc_id, node_id, n_descendants, height) of every node that is neither on nor below a ring, without any path."""
    named = rels.withColumn("_d", F.coalesce(F.concat(F.lit("="), "doc_id"), F.lit("")))
    edges = stage(links(named.drop("doc_id").withColumnRenamed("_d", "doc_id")), "edges")
    tree = stage(resolve(edges, partition_rows), "tree")
    sound = tree.where("depth >= 0").select("doc_id", F.col("node_id").alias("node"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    linked = edges.join(sound, ["doc_id", "node"]).select("doc_id", "node", F.col("parent").alias("exit"), one.alias("dist"), F.col("ord").cast("long").alias("ord"), one.alias("size"), none.alias("reach"))
    first = edges.groupBy("doc_id", F.col("parent").alias("node")).agg(F.min("ord").cast("long").alias("ord"))
    roots = tree.where("depth = 0").select("doc_id", F.col("node_id").alias("node")).join(first, ["doc_id", "node"], "left")
    roots = roots.select("doc_id", "node", F.lit(None).cast("string").alias("exit"), one.alias("dist"), F.coalesce("ord", none).alias("ord"), one.alias("size"), none.alias("reach"))
    rows = stage(linked.unionByName(roots), "sizes")
    out = _sized(rows, rows.count(), 0, partition_rows)
    return out.select(F.when(F.col("doc_id") != "", F.expr("substring(doc_id, 2)")).alias("doc_id"), F.col("node").alias("node_id"), (F.col("size") - 1).alias("n_descendants"), F.col("reach").cast("int").alias("height"))
