"""Session helpers: table access, shared staging folder, skew-proof joins."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_HOT_KEYS = 1024
_SALTS = 64


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once per application, so that jobs need no path set up."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        home = os.path.dirname(os.path.abspath(__file__))
        base = os.path.join(tempfile.mkdtemp(prefix="tessella-code-"), "tessella")
        spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(home), os.path.basename(home)))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the input folder, read by name."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder shared by all executors, as the session names it in ``spark.checkpoint.dir``.

    Where the setting is absent a local session gets a folder of its own; a cluster without the
    setting is an error, since a machine-local folder would be lost with its machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may already be gone
        pass


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder, removed with the session at the latest."""
    ship(spark)
    path = f"{shared_root(spark)}/tessella/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete files of the shared folder that no later plan reads."""
    for path in paths:
        if "/tessella/" in path:
            _remove(spark, path)


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged table that no later plan reads."""
    discard(df.sparkSession, sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()}))


def hot_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "left",
    spread: Column | None = None,
    hot: DataFrame | None = None,
    hot_keys: int = _HOT_KEYS,
    salts: int = _SALTS,
    grows: bool = False,
) -> DataFrame:
    """Equi-join of ``left`` with ``right``, which holds at most one row per key, safe for hot keys.

    The ``hot_keys`` most frequent keys of ``left`` are found by a pre-aggregated count; that list has at
    most ``hot_keys`` rows whatever the input, so broadcasting it is bounded. Rows of these keys are
    dealt to ``salts`` shares and the matching right rows repeated once per share. Any other key holds at
    most ``1 / hot_keys`` of the rows. The list decides only how rows travel, never which rows join.
    ``hot`` may hand over the counts (keys and ``_n``) if they are known already. ``grows`` says that ``right``
    grows with the input: both sides are sorted and merged, whatever Spark takes the size of ``right`` to be.
    """
    spread = F.xxhash64(*[F.col(c) for c, t in left.dtypes if not t.startswith(("map", "variant"))]) if spread is None else spread
    if hot is None:
        hot = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = hot.where("_n > 1").orderBy(F.desc("_n")).limit(hot_keys).select(*keys, F.lit(True).alias("_hot"))
    hot = F.broadcast(hot)
    salted_left = left.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(spread, F.lit(salts))).otherwise(F.lit(0)).cast("int")).drop("_hot")
    shares = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted_right = right.join(hot, keys, "left").withColumn("_salt", F.explode(shares)).drop("_hot")
    return salted_left.join(merged(salted_right) if grows else salted_right, [*keys, "_salt"], how).drop("_salt")


def merged(right: DataFrame) -> DataFrame:
    """``right`` as the side of a join that is never broadcast.

    Spark takes the size of a staged table to be that of the columns read in its compressed files, a few bytes a
    row. By that size a table with a row for each id is broadcast, though the driver cannot hold it."""
    return right.hint("merge")


def rank_within(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: the place (from 1) of each row among those of its key, for keys of any size.

    Rows are sorted by range partitions, so no task holds a whole key; places follow from the rows of the
    partitions before (one number a partition, bounded by their number) and the first place of each key.
    ``order`` must leave no ties, else equal rows get places in any order."""
    laid = df.repartitionByRange(*[F.asc_nulls_first(k) for k in keys], *order).sortWithinPartitions(*[F.asc_nulls_first(k) for k in keys], *order)
    laid = stage(laid.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = laid.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.broadcast(sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before")))
    t = laid.withColumn("_p", part).join(before, "_p").withColumn("_g", F.col("_before") + row)
    if keys:
        kept = {k: f"_k{i}" for i, k in enumerate(keys)}
        named = t.select("*", *[F.to_json(F.struct(k)).alias(v) for k, v in kept.items()])
        first = named.groupBy(*kept.values()).agg(F.min("_g").alias("_first"))
        t = hot_join(named, first, list(kept.values()), "left", spread=F.col("_g")).drop(*kept.values())
    else:
        t = t.withColumn("_first", F.lit(0))
    return t.withColumn(name, F.col("_g") - F.col("_first") + 1).drop("_at", "_p", "_before", "_g", "_first")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
