"""Incremental runs over arriving files: gate results per batch, windowed usage, keyed orphan state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.operators import gate, kg
from tessella.session import shared_root, ship

EVENT = "doc_id string, ref_id string, share int, kind string, row_id long, endpoint string, at_us long"
RESULT = "doc_id string, ref_id string, rel_id long, endpoint string, status string"
# Shares that the references of a key are dealt to, so that the state of a hot key is many small ones.
SHARES = 16
# per key and share: first upsert, time / row / kind of the latest entity row, and every reference with its time and status
STATE = "first_us long, last_us long, last_row long, gone boolean, refs array<struct<rel_id:long,endpoint:string,at_us:long,status:string>>"


def validate_new_files(spark: SparkSession, folder: str, schema: Any, out: str, name: str = "gate") -> StreamingQuery:
    """Judge the entities of each new file once and append the results; restarts go on after the last batch."""

    def each(batch: DataFrame, epoch: int) -> None:
        judged = gate.judged(kg.entities(batch)).select("rec_id", "doc_id", "id", "mismatch", "called")
        judged.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    ship(spark)
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(folder)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{shared_root(spark)}/tessella/stream-{name}").trigger(availableNow=True).start()


def usage_windows(usage: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Tokens and calls per model and time window, late calls taken in within the watermark."""
    t = usage.withColumn("at", F.try_to_timestamp("call_timestamp")).where("at is not null").withWatermark("at", late)
    return t.groupBy(F.window("at", width), "model").agg(F.count(F.lit(1)).alias("n_calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def orphan_events(entities: DataFrame, rels: DataFrame, shares: int = SHARES) -> DataFrame:
    """Both tables as one stream of keyed events: a reference goes to one share of its key, a parent to all."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    e = entities.where("id is not null").select("doc_id", F.col("id").alias("ref_id"), F.col("op").alias("kind"), F.col("rec_id").alias("row_id"), F.lit(None).cast("string").alias("endpoint"), us("ingested_at").alias("at_us"))
    e = e.select("*", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    ends = F.array(F.struct(F.lit("subject").alias("endpoint"), F.col("subject").alias("ref_id")), F.struct(F.lit("object").alias("endpoint"), F.col("object").alias("ref_id")))
    r = rels.select("doc_id", "rel_id", "ingested_at", F.explode(ends).alias("x")).where(F.regexp_like("x.ref_id", F.lit(r"[^\s\p{Z}]")))
    r = r.select("doc_id", F.col("x.ref_id").alias("ref_id"), F.lit("ref").alias("kind"), F.col("rel_id").alias("row_id"), F.col("x.endpoint").alias("endpoint"), us("ingested_at").alias("at_us"), F.pmod(F.xxhash64("rel_id", "x.endpoint"), F.lit(shares)).cast("int").alias("share"))
    return e.unionByName(r)


def _status(first: Any, gone: bool, at: Any) -> str:
    if first is None:
        return "missing"
    if gone:
        return "deleted"
    return "resolved" if at is not None and first <= at else "late"


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    first, last, row, gone, refs = state.get if state.exists else (None, None, None, False, [])
    refs = [tuple(r) for r in (refs if refs is not None else [])]
    for f in frames:
        for kind, row_id, endpoint, at in zip(f["kind"], f["row_id"], f["endpoint"], f["at_us"]):
            at = None if pd.isna(at) else int(at)
            if kind == "ref":
                refs.append((int(row_id), endpoint, at, None))
                continue
            if kind == "upsert" and at is not None:
                first = at if first is None else min(first, at)
            mark = (-(2**62) if at is None else at, int(row_id))
            if last is None or mark > (last, row):
                last, row, gone = mark[0], mark[1], kind == "delete"
    now = [(rel, end, at, _status(first, gone, at)) for rel, end, at, _ in refs]
    changed = [(key[0], key[1], a[0], a[1], a[3]) for a, b in zip(now, refs) if a[3] != b[3]]
    state.update((first, last, row, gone, now))
    yield pd.DataFrame(changed, columns=["doc_id", "ref_id", "rel_id", "endpoint", "status"])


def orphan_stream(events: DataFrame) -> DataFrame:
    """Changes of status of every reference, by keyed pending state.

    New references probe the parent's state, arriving parents resolve waiting references, deletes reopen
    them; only changes are emitted. A hot key has its references dealt to shares with a state each."""
    return events.groupBy("doc_id", "ref_id", "share").applyInPandasWithState(_advance, RESULT, STATE, "update", GroupStateTimeout.NoTimeout)
