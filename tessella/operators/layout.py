"""Coordinates of a drawing of the graph: bands by type, rows under categories and models.

Places come from ranks over range partitions and from counts, so a document of any size is laid out by
many tasks. Only filling rows of at most ten with small groups depends on everything before it; there
each chunk first says what it would do from every fill of the row it starts in, and the true start of
each chunk follows from these short tables.
"""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.graph import drawing_order, effective_type, parents
from tessella.session import hot_join, rank_within, stage

# Spacing of the drawing.
ROW_GAP, BAND_GAP, GROUP_GAP, SPARSE_SPACING, ROW_ITEMS, SPARSE = 20.0, 26.0, 6.0, 28.0, 10, 3
SPACING = {"ReportingFramework": (24.0, 34.0), "Industry": (25.0, 35.0), "Category": (32.0, 42.0), "Model": (30.0, 40.0), "orphan": (23.0, 32.0)}
DENSE_SPACING = {4: 30.0, 5: 28.0, 6: 27.0}
WIDEST_DENSE = 26.0
CHUNK = 100_000


def adaptive(n: Column, least: float, most: float) -> Column:
    """Spacing of a row of n: the fewer, the wider."""
    return F.when(n <= 1, most + 5.0).when(n <= 6, most - 2.0 * (n - 2)).otherwise(least)


def centred(k: Column, n: Column, spacing: Column) -> Column:
    """The place of the k-th (from 1) of n around 0."""
    return (k - 1 - (n - 1) / 2) * spacing


def fill_rows(groups: DataFrame, keys: list[str], order: list[Column], size: str, capacity: int = ROW_ITEMS, chunk: int = CHUNK) -> DataFrame:
    """Adds ``row`` (from 1): groups of at most ``capacity`` items put into rows of ``capacity`` one after
    another; a group that does not fit begins the next row.

    ``chunk`` groups at a time are one task; what reaches the driver is a table of ``capacity + 1`` lines
    for the first and last key of each chunk."""
    ranked = stage(rank_within(groups, [], [*[F.asc_nulls_first(k) for k in keys], *order], "_pos").withColumn("_c", F.floor((F.col("_pos") - 1) / chunk)), "row-groups")
    names = [*keys, "_c", "_pos", size]

    def walk(sizes: Any, fill: int) -> tuple[list[int], int]:
        rows, row = [], 0 if fill else 1
        for s in sizes:
            if fill and fill + s > capacity:
                row, fill = row + 1, 0
            fill += s
            rows.append(row)
        return rows, fill

    def runs(pdf: pd.DataFrame) -> list[tuple[tuple, pd.DataFrame]]:
        pdf = pdf.sort_values("_pos")
        marks = pdf[keys].astype(object).where(pdf[keys].notna(), None).apply(tuple, axis=1)
        return [(g.iloc[0], pdf.loc[g.index]) for _, g in marks.groupby((marks != marks.shift()).cumsum(), sort=True)]

    def told(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = runs(pdf)
        out = []
        for i in sorted({0, len(parts) - 1}):
            mark, part = parts[i]
            for fill in range(capacity + 1):
                rows, end = walk(part[size], fill)
                out.append((int(part["_c"].iloc[0]), i, repr(mark), i == len(parts) - 1, fill, rows[-1], end))
        return pd.DataFrame(out, columns=["c", "i", "mark", "last", "fill", "rows", "after"])

    told_schema = "c long, i int, mark string, last boolean, fill int, rows int, after int"
    table = ranked.select(*names).groupBy("_c").applyInPandas(told, told_schema).orderBy("c", "i", "fill")
    steps: dict[tuple[int, int], list] = {}
    for r in table.toLocalIterator():
        steps.setdefault((r.c, r.i), []).append(r)
    starts: dict[int, tuple[int, int]] = {}
    mark, rows, fill = None, 0, 0
    for (c, i), options in sorted(steps.items()):
        if options[0].mark != mark:
            mark, rows, fill = options[0].mark, 0, 0
        if i == 0:
            starts[c] = (rows, fill)
        step = options[fill]
        rows, fill = rows + step.rows, step.after
    sent = groups.sparkSession.sparkContext.broadcast(starts)

    def placed(pdf: pd.DataFrame) -> pd.DataFrame:
        before, fill = sent.value[int(pdf["_c"].iloc[0])]
        out = []
        for i, (_, part) in enumerate(runs(pdf)):
            got, _ = walk(part[size], fill if i == 0 else 0)
            part = part.assign(row=[r + (before if i == 0 else 0) for r in got])
            out.append(part[["_pos", "row"]])
        return pd.concat(out)

    rows_of = ranked.select(*names).groupBy("_c").applyInPandas(placed, "_pos long, row int")
    return ranked.join(rows_of, "_pos").drop("_pos", "_c")


def _band(nodes: DataFrame, heads: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(placed nodes with their row below the band's top, rows per document) of the items under heads.

    ``nodes``: doc_id, id, parent, o (order); ``heads``: doc_id, id, k, x."""
    owners = heads.select("doc_id", F.col("id").alias("parent"), "k", F.col("x").alias("head_x"))
    t = hot_join(nodes, owners, ["doc_id", "parent"], "left", spread=F.xxhash64("id"))
    t = stage(t.withColumn("group", F.when(F.col("k").isNotNull(), F.col("parent"))), f"{prefix}-nodes")
    t = stage(rank_within(t, ["doc_id", "group"], [F.asc("o")], "j"), f"{prefix}-places")
    sizes = stage(t.groupBy("doc_id", "group").agg(F.count(F.lit(1)).alias("m"), F.max("k").alias("gk"), F.max("head_x").alias("hx")), f"{prefix}-groups")
    dense = rank_within(sizes.where(F.col("group").isNotNull() & (F.col("m") > SPARSE)), ["doc_id"], [F.asc("gk")], "row")
    wide = F.coalesce(*[F.when(F.col("m") == n, s) for n, s in DENSE_SPACING.items()], F.lit(WIDEST_DENSE))
    dense = dense.select("doc_id", "group", F.col("row").cast("int").alias("row"), (F.col("hx") - (F.col("m") - 1) * wide / 2).alias("x0"), wide.alias("step"))
    packed = fill_rows(sizes.where(F.col("group").isNotNull() & (F.col("m") <= SPARSE)), ["doc_id"], [F.asc("gk")], "m")
    packed = stage(packed, f"{prefix}-packed")
    in_row = Window.partitionBy("doc_id", "row")  # ten items at most
    before = F.coalesce(F.sum(F.col("m") * SPARSE_SPACING + GROUP_GAP).over(in_row.orderBy("gk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    width = F.sum((F.col("m") - 1) * SPARSE_SPACING + GROUP_GAP).over(in_row) - GROUP_GAP
    n_dense = dense.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_dense"))
    packed_at = packed.select("doc_id", "group", "row", (before - width / 2).alias("x0"), F.lit(SPARSE_SPACING).alias("step")).join(n_dense, "doc_id", "left")
    packed_at = packed_at.select("doc_id", "group", (F.col("row") + F.coalesce("n_dense", F.lit(0))).cast("int").alias("row"), "x0", "step")
    groups = stage(dense.unionByName(packed_at), f"{prefix}-rows")
    used = groups.groupBy("doc_id").agg(F.max("row").alias("rows"))
    alone = sizes.where(F.col("group").isNull()).select("doc_id", F.col("m").alias("alone"))
    tall = used.join(alone, "doc_id", "full_outer").select("doc_id", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("alone", F.lit(0)).alias("alone"))
    spread = F.xxhash64("id")
    t = hot_join(hot_join(t, groups, ["doc_id", "group"], "left", spread=spread), tall, ["doc_id"], "left", spread=spread)
    lone = centred(F.col("j"), F.col("alone"), adaptive(F.col("alone"), *SPACING["orphan"]))
    x = F.when(F.col("group").isNull(), lone).otherwise(F.col("x0") + (F.col("j") - 1) * F.col("step"))
    row = F.when(F.col("group").isNull(), F.col("rows")).otherwise(F.col("row") - 1)
    return t.select("doc_id", "id", "band", x.alias("x"), row.alias("down")), tall.select("doc_id", (F.col("rows") + F.when(F.col("alone") > 0, 1).otherwise(0)).alias("tall"))


def layout(ents: DataFrame, rels: DataFrame) -> DataFrame:
    """(doc_id, id, band, x, y) of every node: frameworks on top, then industries, categories, the metrics of each
    category, models, and the input metrics of each model.

    A node is an id of a document, its type that of its first row; nodes of other types are not drawn.
    Metrics without a category and inputs without a model share a row below their band."""
    first = ents.where("id is not null").withColumn("band", effective_type()).groupBy("doc_id", "id").agg(F.min(F.struct("pos", "rec_id", "band")).alias("f"))
    nodes = stage(first.select("doc_id", "id", F.struct("f.pos", "f.rec_id").alias("at"), F.col("f.band").alias("band")), "layout-nodes")
    up = parents(rels).select("doc_id", F.col("node").alias("id"), "parent")
    as_ents = nodes.select("doc_id", "id", F.col("band").alias("type"), F.col("at.pos").alias("pos"), F.col("at.rec_id").alias("rec_id"))

    def row_of(kind: str) -> DataFrame:
        """A band that is one row: (doc_id, id, k, x, n)."""
        if kind in ("Category", "Model"):
            t = drawing_order(as_ents, rels, kind)
        else:
            t = rank_within(nodes.where(F.col("band") == kind), ["doc_id"], [F.asc("at")], "k")
        t = stage(t.select("doc_id", "id", "k"), f"layout-{kind}")
        n = t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
        t = hot_join(t, n, ["doc_id"], "left", spread=F.xxhash64("id"))
        return t.select("doc_id", "id", F.lit(kind).alias("band"), "k", centred(F.col("k"), F.col("n"), adaptive(F.col("n"), *SPACING[kind])).alias("x"))

    rows = {kind: stage(row_of(kind), f"layout-row-{kind}") for kind in ("ReportingFramework", "Industry", "Category", "Model")}
    kinds = {"DirectMetric": 0, "CalculatedMetric": 1, "Metric": 2}
    place = F.coalesce(*[F.when(F.col("band") == b, F.lit(i)) for b, i in kinds.items()], F.lit(0))
    below = hot_join(nodes.where(F.col("band").isin(*kinds, "InputMetric")), up, ["doc_id", "id"], "left", spread=F.col("at.rec_id"))
    below = stage(below.select("doc_id", "id", "band", "parent", F.struct(place.alias("t"), "at").alias("o")), "layout-below")
    metrics, metric_rows = _band(below.where("band <> 'InputMetric'"), rows["Category"], "metric")
    inputs, _ = _band(below.where("band = 'InputMetric'"), rows["Model"], "input")
    has = lambda kind: rows[kind].select("doc_id").distinct().withColumn(kind, F.lit(BAND_GAP))
    tops = nodes.select("doc_id").distinct()
    for kind in rows:
        tops = tops.join(has(kind), "doc_id", "left")
    tops = tops.join(metric_rows, "doc_id", "left").na.fill(0)
    industry = F.col("ReportingFramework")
    category = industry + F.col("Industry")
    metric = category + F.col("Category")
    model = metric + F.col("tall") * ROW_GAP
    top = {"ReportingFramework": F.lit(0.0), "Industry": industry, "Category": category, "Model": model, "InputMetric": model + F.col("Model")}
    drawn = metrics.unionByName(inputs)
    for frame in rows.values():
        drawn = drawn.unionByName(frame.select("doc_id", "id", "band", "x", F.lit(0).alias("down")))
    drawn = hot_join(drawn, tops, ["doc_id"], "left", spread=F.xxhash64("id"))
    y = F.coalesce(*[F.when(F.col("band") == b, t) for b, t in top.items()], metric)
    return drawn.select("doc_id", "id", "band", F.col("x").cast("double").alias("x"), (0.0 - (y + F.col("down") * ROW_GAP)).alias("y"))
