from datetime import datetime, timedelta

from tessella.operators.orphans import find_orphans
from tessella.streaming import incremental

ENT = "rec_id long, doc_id string, pos int, id string, type string, label string, properties string, source struct<doc_id:string>, provenance map<string,string>, op string, ingested_at timestamp_ntz"
REL = "rel_id long, doc_id string, subject string, object string, ingested_at timestamp_ntz"
T0 = datetime(2024, 1, 1)


def tables(spark):
    e = [(i, "d", i, f"e{i % 4}", "Metric", "label", None, None, None, "delete" if i == 6 else "upsert", T0 + timedelta(days=i)) for i in range(7)]
    r = [(i, "d", f"e{i % 5}", " " if i == 2 else f"e{i % 3}", T0 + timedelta(days=i % 6)) for i in range(8)]
    return spark.createDataFrame(e, ENT), spark.createDataFrame(r, REL)


def test_keyed_state_ends_like_the_batch(spark, tmp_path):
    ents, rels = tables(spark)
    events = incremental.orphan_events(ents, rels)
    for k, part in enumerate(events.randomSplit([0.5, 0.5], 3)):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = []

    def keep(batch, epoch):
        out.extend((epoch, r.rel_id, r.endpoint, r.status) for r in batch.collect())

    q = incremental.orphan_stream(stream).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    last = {(rel, end): status for _, rel, end, status in sorted(out)}
    assert last == {(r.rel_id, r.endpoint): r.status for r in find_orphans(rels, ents).collect()}


def test_new_files_are_judged_once(spark, tmp_path):
    ents, _ = tables(spark)
    ents.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        incremental.validate_new_files(spark, f"{tmp_path}/in", ents.schema, f"{tmp_path}/out", name=tmp_path.name).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6


def test_usage_windows(spark):
    u = spark.createDataFrame([("2024-01-01 01:00:00", "m", 1, 2), ("2024-01-01 23:00:00", "m", 1, 2), ("2024-01-02 00:00:00", "m", 5, 5), (None, "m", 9, 9)], "call_timestamp string, model string, input_tokens long, output_tokens long")
    assert sorted((r.n_calls, r.input_tokens) for r in incremental.usage_windows(u).collect()) == [(1, 5), (2, 2)]
