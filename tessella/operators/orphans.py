"""References whose target never came, came later or was deleted."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import discard, fresh_path, hot_join, stage, union_all

KEY = ["doc_id", "ref_id"]
PARENTS = "doc_id string, ref_id string, first_upsert timestamp_ntz, last struct<at:timestamp_ntz,rec:bigint,gone:boolean>"
REFS = "rel_id bigint, endpoint string, doc_id string, ref_id string, ref_at timestamp_ntz, status string"
# Rows of references a bucket of the state is made for, and how many buckets there are.
BUCKET_ROWS = 1_000_000
LEAST_BUCKETS, MOST_BUCKETS = 8, 4096
STATUSES = ("missing", "late", "deleted")


def endpoints(rels: DataFrame) -> DataFrame:
    """One row per named end of a relationship: (rel_id, endpoint, doc_id, ref_id, ref_at)."""
    ends = F.array(F.struct(F.lit("subject").alias("endpoint"), F.col("subject").alias("ref_id")), F.struct(F.lit("object").alias("endpoint"), F.col("object").alias("ref_id")))
    out = rels.select("rel_id", "doc_id", F.col("ingested_at").alias("ref_at"), F.explode(ends).alias("e")).select("rel_id", "e.endpoint", "doc_id", "e.ref_id", "ref_at")
    return out.where(F.col("ref_id").isNotNull() & F.regexp_like("ref_id", F.lit(r"[^\s\p{Z}]")))


def parent_index(entities: DataFrame) -> DataFrame:
    """Keyed state of the parents: first upsert and the latest row's operation.

    Of rows ingested at one instant the largest ``rec_id`` counts as the latest. Rows without a time are
    older than all others.
    """
    last = F.struct(F.col("ingested_at").alias("at"), F.col("rec_id").alias("rec"), (F.col("op") == "delete").alias("gone"))
    return entities.where("id is not null").groupBy("doc_id", F.col("id").alias("ref_id")).agg(F.min(F.when(F.col("op") == "upsert", F.col("ingested_at"))).alias("first_upsert"), F.max(last).alias("last"))


def probe(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Status of each reference: resolved, missing (no upsert ever), late (first upsert after the
    reference) or deleted (latest row of the key is a delete, whenever it came)."""
    joined = hot_join(refs, parents, KEY, "left", spread=F.col("rel_id"))
    status = (
        F.when(F.col("first_upsert").isNull(), "missing")
        .when(F.coalesce(F.col("last.gone"), F.lit(False)), "deleted")
        .when(F.coalesce(F.col("first_upsert") <= F.col("ref_at"), F.lit(False)), "resolved")
        .otherwise("late")
    )
    return joined.select("rel_id", "endpoint", *KEY, "ref_at", status.alias("status"))


@dataclass
class OrphanState:
    """Keyed state between batches: the parent index and every reference with its status.

    Both lie in the shared folder by buckets of the key. A batch reads and writes the buckets of its own
    keys only; the files of all others stay as they are."""

    spark: SparkSession
    buckets: int = LEAST_BUCKETS
    parents: dict[int, str] = field(default_factory=dict)
    refs: dict[int, str] = field(default_factory=dict)

    @staticmethod
    def sized(spark: SparkSession, references: int) -> "OrphanState":
        """An empty state for about so many references; any number works with any."""
        return OrphanState(spark, max(LEAST_BUCKETS, min(MOST_BUCKETS, references // BUCKET_ROWS)))

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int").alias("bucket")

    def _read(self, held: dict[int, str], schema: str, buckets: list[int] | None = None) -> DataFrame:
        paths = sorted(p for b, p in held.items() if buckets is None or b in buckets)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, label: str, buckets: list[int]) -> dict[int, str]:
        """Write buckets anew; a bucket with a hot key is cut into several files by the rebalancing."""
        path = fresh_path(self.spark, label)
        df.select("*", self._bucket()).hint("rebalance", "bucket").write.option("compression", "zstd").partitionBy("bucket").parquet(path)
        held = {r[0] for r in self.spark.read.schema("doc_id string, bucket int").parquet(path).select("bucket").distinct().collect()}
        return {b: f"{path}/bucket={b}" for b in buckets if b in held}

    def advance(self, entities: DataFrame, rels: DataFrame) -> "OrphanState":
        """Take in one batch: new references probe the index; parents that arrive resolve waiting
        references and deletes reopen them, for the touched keys only."""
        delta = stage(parent_index(entities).select("*", self._bucket()), "orphan-delta")
        fresh = stage(endpoints(rels).select("*", self._bucket()), "orphan-new")
        by_parents = sorted(r[0] for r in delta.select("bucket").distinct().collect())
        touched = sorted({*by_parents, *(r[0] for r in fresh.select("bucket").distinct().collect())})
        delta, fresh = delta.drop("bucket"), fresh.drop("bucket")
        merged = self._read(self.parents, PARENTS, by_parents).unionByName(delta).groupBy(*KEY).agg(F.min("first_upsert").alias("first_upsert"), F.max("last").alias("last"))
        parents = self.parents | self._write(merged, "orphan-parents", by_parents)
        now = OrphanState(self.spark, self.buckets, parents)
        waiting = self._read(self.refs, REFS, touched)
        moved = delta.select(*KEY).withColumn("_moved", F.lit(True))
        waiting = hot_join(waiting, moved, KEY, "left", spread=F.col("rel_id"))
        same = waiting.where("_moved is null").drop("_moved")
        again = waiting.where("_moved").select("rel_id", "endpoint", *KEY, "ref_at")
        probed = probe(again.unionByName(fresh), now._read(parents, PARENTS, touched))
        now.refs = self.refs | self._write(same.unionByName(probed), "orphan-refs", touched)
        return now

    def release(self, after: "OrphanState") -> None:
        """Delete the files of this state that the one after it no longer reads."""
        kept = {*after.parents.values(), *after.refs.values()}
        discard(self.spark, [p for p in (*self.parents.values(), *self.refs.values()) if p not in kept])

    def all_refs(self) -> DataFrame:
        return self._read(self.refs, REFS)

    def open_refs(self) -> DataFrame:
        return self.all_refs().where("status <> 'resolved'")

    def snapshot(self) -> DataFrame:
        """Orphans and all references per end (table) and month of the reference."""
        return self.all_refs().groupBy("endpoint", F.date_format("ref_at", "yyyy-MM").alias("period")).agg(
            *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.count(F.lit(1)).alias("references")
        )


def replay(entities: DataFrame, rels: DataFrame, every: str = "quarter", snapshots: bool = False) -> tuple[OrphanState, DataFrame | None]:
    """The state after taking in both tables in the order of ``ingested_at``, one batch each ``every`` period,
    and, if asked for, the snapshots at the end of each period (``as_of``).

    Rows are laid out by period once. Rows without a time come first. Nulls: a null or blank end is no
    reference; a reference without ``ingested_at`` finds no parent in time; entity rows without an id are no
    parents. Repeated rows count each by their ``rel_id``."""
    spark = rels.sparkSession
    period = F.coalesce(F.date_format(F.date_trunc(every, "ingested_at"), "yyyy-MM-dd"), F.lit("0000")).alias("batch")
    sources = {"entities": entities.select("rec_id", "doc_id", "id", "op", "ingested_at"), "rels": rels.select("rel_id", "doc_id", "subject", "object", "ingested_at")}
    paths = {name: fresh_path(spark, f"orphan-{name}") for name in sources}
    found: dict[str, set[str]] = {}
    for name, df in sources.items():
        df.select("*", period).write.option("compression", "zstd").partitionBy("batch").parquet(paths[name])
        found[name] = {r[0] for r in spark.read.schema("rec_id bigint, batch string").parquet(paths[name]).select("batch").distinct().collect()}

    def part(name: str, batch: str) -> DataFrame:
        df = sources[name]
        return spark.read.schema(df.schema).parquet(f"{paths[name]}/batch={batch}") if batch in found[name] else df.limit(0)

    state = OrphanState.sized(spark, 2 * spark.read.schema("rel_id bigint").parquet(paths["rels"]).count() if found["rels"] else 0)
    taken = []
    for batch in sorted(found["entities"] | found["rels"]):
        after = state.advance(part("entities", batch), part("rels", batch))
        state.release(after)
        state = after
        if snapshots:
            taken.append(stage(state.snapshot().select(F.lit(batch).alias("as_of"), "*"), "orphan-snapshot"))
    discard(spark, list(paths.values()))
    return state, union_all(taken) if taken else None


def find_orphans(rels: DataFrame, entities: DataFrame) -> DataFrame:
    """All references with their status after a replay of both tables (see :func:`replay`)."""
    return replay(entities, rels)[0].all_refs()


def snapshots(rels: DataFrame, entities: DataFrame, every: str = "quarter") -> DataFrame:
    """(as_of, endpoint, period, missing, late, deleted, references): at the end of each period of the replay, the
    orphans and all references so far, per end and month of the reference. Empty input has none."""
    taken = replay(entities, rels, every, True)[1]
    schema = "as_of string, endpoint string, period string, missing bigint, late bigint, deleted bigint, `references` bigint"
    return taken if taken is not None else rels.sparkSession.createDataFrame([], schema)
