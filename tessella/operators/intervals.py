"""Continuous periods and gaps of page ranges by a distributed sweep line."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 4096


def sweep(df: DataFrame, keys: list[str], start: str, end: str, bucket: int | None = None) -> DataFrame:
    """Merged periods and the gaps between them, per ``keys``.

    Each closed range ``[start, end]`` becomes a +1 event at ``start`` and a -1 event at ``end + 1``.
    Events of one place are summed before the shuffle, so a hot key shrinks to its distinct boundaries.
    The prefix sum has two levels (whole buckets, then places within a bucket). Unless given, the width of
    a bucket follows from the range of all places and the number of rows: a key has at most as many
    buckets as the root of the rows, and places of a wide, sparse range (times) are gathered alike.

    Result: keys, ``kind`` ('period' or 'gap'), ``range_from``, ``range_to`` (bigint, both included).
    Rows with a null end or ``start > end`` cover nothing; repeated rows change nothing; null keys form
    a key of their own; neighbours such as [1,2] and [3,4] are one period; an empty input gives no rows.
    """
    k = [f"_k{i}" for i in range(len(keys))]
    lo, hi = F.col(start).cast("long"), F.col(end).cast("long")
    base = df.select(*[F.col(c).alias(a) for c, a in zip(keys, k)], lo.alias("_lo"), hi.alias("_hi")).where("_lo <= _hi")
    if bucket is None:
        seen = base.agg(F.count(F.lit(1)).alias("n"), F.min("_lo").alias("lo"), F.max("_hi").alias("hi")).first()
        bucket = max(BUCKET, math.ceil((seen.hi - seen.lo + 1) / math.sqrt(2 * seen.n))) if seen.n else BUCKET
    events = (
        base.select(*k, F.explode(F.array(F.struct(F.col("_lo").alias("x"), F.lit(1).alias("d")), F.struct((F.col("_hi") + 1).alias("x"), F.lit(-1).alias("d")))).alias("e"))
        .groupBy(*k, F.col("e.x").alias("x"))
        .agg(F.sum("e.d").alias("d"))
        .where("d <> 0")
        .withColumn("b", F.floor(F.col("x") / F.lit(bucket)))
    )
    # running count of whole buckets
    per_bucket = events.groupBy(*k, "b").agg(F.sum("d").alias("s"))
    before = Window.partitionBy(*k).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.select(*[F.col(c).alias("o" + c) for c in k], F.col("b").alias("ob"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("open_before"))
    same = F.col("b") == F.col("ob")
    for c in k:
        same = same & F.col(c).eqNullSafe(F.col("o" + c))
    inside = Window.partitionBy(*k, "b").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    counted = events.join(per_bucket, same).withColumn("after", F.col("open_before") + F.sum("d").over(inside)).withColumn("prior", F.col("after") - F.col("d"))
    turns = counted.where("(prior = 0) <> (after = 0)").select(*k, "b", "x", (F.col("after") > 0).alias("opens"))
    # the next turn: within the bucket, else the first of the next bucket that has one
    firsts = turns.groupBy(*k, "b").agg(F.min("x").alias("fx"))
    firsts = firsts.select(*[F.col(c).alias("o" + c) for c in k], F.col("b").alias("ob"), F.lead("fx").over(Window.partitionBy(*k).orderBy("b")).alias("next_x"))
    nxt = F.lead("x").over(Window.partitionBy(*k, "b").orderBy("x"))
    out = turns.withColumn("nx", nxt).join(firsts, same, "left").withColumn("nx", F.coalesce("nx", "next_x")).where("nx is not null")
    kind = F.when(F.col("opens"), F.lit("period")).otherwise(F.lit("gap"))
    return out.select(*[F.col(a).alias(c) for c, a in zip(keys, k)], kind.alias("kind"), F.col("x").alias("range_from"), (F.col("nx") - 1).alias("range_to"))


def page_periods(segments: DataFrame) -> DataFrame:
    """Covered page periods and gaps of each standard and run."""
    out = sweep(segments, ["doc_id", "run_id"], "page_start", "page_end")
    return out.select("doc_id", "run_id", "kind", F.col("range_from").cast("int").alias("page_from"), F.col("range_to").cast("int").alias("page_to"))
