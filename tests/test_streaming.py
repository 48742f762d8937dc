"""Streaming jobs over file sources, against their batch twins."""

import random

import pytest
from pyspark.sql import functions as F

from shotweave.operators.sessions import held_scenes, hide_held, session_records, session_snapshot
from shotweave.sources.keyed import KeyedTable
from shotweave.streaming.jobs import held_table, incremental_enrich, job_state_stream, keep_held, live_snapshot, session_stream


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


SCHEMA = "event_id long, ts timestamp, code int, scene_id long, video_id string, status string"


def writes(spark, rows):
    return spark.createDataFrame(rows, "event_id long, code int, scene_id long, video_id string, status string").select("event_id", F.timestamp_seconds("event_id").alias("ts"), "code", "scene_id", "video_id", "status")


def source(spark, tmp_path, batches, schema):
    for k, b in enumerate(batches):
        b.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_job_state(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "PENDING"), (2, "a", "FAILED"), (3, "b", "LOADED"), (4, "a", "FETCHED")], "event_id long, video_id string, stage string").withColumn("ts", F.timestamp_seconds("event_id"))
    stream = source(spark, tmp_path, [rows.where("event_id < 3"), rows.where("event_id > 2")], rows.schema)
    q = job_state_stream(stream).writeStream.outputMode("complete").format("memory").queryName("jobs").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert {tuple(r) for r in spark.table("jobs").collect()} == {("a", "FETCHED", 1), ("b", "LOADED", 0)}


def test_incremental_enrichment_adds_each_row_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x"), (2, ""), (1, "x")], "id long, text string")
    double = lambda df: df.select("id", F.length("text").alias("n"))
    out = KeyedTable(spark, str(tmp_path / "out"), double(rows).schema, ["id"], 4)
    for run in range(2):
        stream = source(spark, tmp_path, [rows], rows.schema)
        incremental_enrich(stream, out, double, ["id"], str(tmp_path / f"c{run}")).awaitTermination(90)
    assert sorted(tuple(r) for r in out.read().collect()) == [(1, 1), (2, 0)]


def test_failures_stay_pending_and_a_repeated_batch_adds_nothing(spark, tmp_path):
    """Texts that hold 'bad' fail until `fixed`; a batch that ends between the two tables is run again."""
    rows = spark.createDataFrame([(1, "good"), (2, "bad one"), (3, "")], "id long, text string")
    more = spark.createDataFrame([(4, "good"), (2, "bad one")], "id long, text string")
    state = {"fixed": False, "halt": False}

    def transform(df):
        bad = F.col("text").contains("bad") & F.lit(not state["fixed"])
        return df.select("id", F.length("text").alias("n"), F.when(bad, "unreadable").alias("error"))

    out = KeyedTable(spark, str(tmp_path / "out"), transform(rows).drop("error").schema, ["id"], 4)
    pending = KeyedTable(spark, str(tmp_path / "failed"), spark.createDataFrame([], "id long, text string, error string, attempts int").schema, ["id"], 4)
    append = out.append_new
    out.append_new = lambda *a, **b: (_ for _ in ()).throw(RuntimeError("halt")) if state.pop("halt", False) else append(*a, **b)

    def run():
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        incremental_enrich(stream, out, transform, ["id"], str(tmp_path / "c"), pending).awaitTermination(90)

    rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    state["halt"] = True
    with pytest.raises(Exception, match="halt"):
        run()
    assert out.read().count() == 0
    run()
    assert sorted(map(tuple, out.read().collect())) == [(1, 4), (3, 0)] and [(r.id, r.error, r.attempts) for r in pending.read().collect()] == [(2, "unreadable", 1)]
    more.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert [(r.id, r.attempts) for r in pending.read().collect()] == [(2, 1)] or [(r.id, r.attempts) for r in pending.read().collect()] == [(2, 2)]
    state["fixed"] = True
    rows.where("id = 1").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert sorted(map(tuple, out.read().collect())) == [(1, 4), (2, 7), (3, 0), (4, 4)] and pending.read().count() == 0


def test_a_commit_leaves_other_files_alone(spark, tmp_path):
    df = spark.range(500).select("id", F.col("id").cast("string").alias("v"))
    t = KeyedTable(spark, str(tmp_path / "t"), df.schema, ["id"], 16)
    assert t.read().count() == 0 and t.upsert(df, ["id"], batch="a") and not t.upsert(df.limit(3), ["id"], batch="a")
    names = lambda: {str(p) for p in (tmp_path / "t").glob("part_=*/*.parquet")}
    before = names()
    change = spark.createDataFrame([(7, "new"), (7, "newer"), (9001, "x")], "id long, v string")
    touched = {f"part_={r[0]}" for r in change.select(t.part()).collect()}
    t.upsert(change, ["id"], ["v"])
    assert {n for n in before if not any(f"{x}/" in n for x in touched)} <= names() and not {n for n in before if any(f"{x}/" in n for x in touched)} & names()
    got = {r.id: r.v for r in t.read().collect()}
    assert got == {i: str(i) for i in range(500)} | {7: "newer", 9001: "x"} and t.read().count() == 501
    t.replace_for(df.limit(0), df.where("id < 480"))
    assert t.read().count() == 21
    with pytest.raises(ValueError, match="keys of an upsert"):
        t.upsert(change, ["v"])
    assert t.upsert(df.limit(0), ["id"]) and t.read().count() == 21


def test_session_stream_equals_the_batch_fold(spark, tmp_path):
    first = [(1, 1, 7, "v", "CORRECT"), (2, 1, 7, None, None), (3, 1, None, "v", "WRONG"), (4, 2, 8, "w", None)]
    later = [(5, 1, 7, None, "WRONG"), (6, 2, 8, None, "CORRECT"), (7, 2, 8, None, "INDETERMINATE")]
    stream = source(spark, tmp_path, [writes(spark, first), writes(spark, later)], SCHEMA)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = session_stream(stream).writeStream.outputMode("update").format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    seen = {tuple(r) for r in spark.table("sessions").collect()}
    batch = {(r.code, r.scene_id, r.status, r.video_id) for r in session_records(writes(spark, first + later)).collect()}
    assert batch == {(1, 7, "WRONG", "v"), (2, 8, "CORRECT", "w")} and batch <= seen


def test_session_stream_keeps_the_order_of_the_writes(spark, tmp_path):
    """A final write that arrives late, with an earlier time, does not replace a later one; an idle session's state ends."""
    first = [(5, 1, 7, "v", "WRONG"), (6, 2, 8, "w", None)]
    later = [(2, 1, 7, "u", "CORRECT"), (3, 1, 7, None, "INDETERMINATE")]
    last = [(20_000, 3, 9, "x", None)]
    stream = source(spark, tmp_path, [writes(spark, b) for b in (first, later, last)], SCHEMA)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = session_stream(stream, "0 seconds").writeStream.outputMode("update").format("memory").queryName("ordered").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    seen = {tuple(r) for r in spark.table("ordered").collect()}
    assert (1, 7, "WRONG", "v") in seen and (1, 7, "CORRECT", "u") not in seen and (3, 9, "INDETERMINATE", "x") in seen


def test_live_snapshot_equals_the_batch_after_every_batch(spark, tmp_path, rocks):
    rng = random.Random(3)
    rows = [(i + 1, rng.randrange(4), s, f"v{s % 5}", rng.choice(["CORRECT", "WRONG", "INDETERMINATE", "UNDECIDABLE", None])) for i in range(90) for s in [rng.randrange(9)]]
    now = {}
    for lo in range(0, 90, 30):
        writes(spark, rows[lo : lo + 30]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        q = live_snapshot(stream).writeStream.outputMode("update").foreachBatch(lambda b, _: now.update({r.code: tuple(r) for r in b.collect()})).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        own = writes(spark, rows[: lo + 30])
        assert now == {r.code: tuple(r) for r in session_snapshot(session_records(own)).collect()} == {r.code: tuple(r) for r in live_snapshot(own).collect()}


def test_a_snapshot_of_a_session_that_has_ended_is_empty(spark, tmp_path, rocks):
    seen = []
    stream = source(spark, tmp_path, [writes(spark, b) for b in ([(1, 1, 7, "v", None)], [(20_000, 3, 9, "x", None)])], SCHEMA)
    q = live_snapshot(stream, "0 seconds").writeStream.outputMode("update").foreachBatch(lambda b, _: seen.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [x for x in seen if x[0] == 1] == [(1, 1, 1, 1), (1, 0, 0, 0)] and (3, 1, 1, 1) in seen


def test_results_of_many_sessions_follow_the_live_state(spark, tmp_path, rocks):
    """Session 1 holds scene 7 until a final write frees it; session 2 takes scene 8; session 3 is unknown."""
    held = held_table(spark, str(tmp_path / "held"), 4)
    results = spark.createDataFrame([(q, q, s) for q in (1, 2, 3) for s in (7, 8)], "query_id int, code int, scene_id long")
    shown = lambda: sorted((r.code, r.scene_id) for r in hide_held(results, held_scenes(held.read())).collect())
    assert len(shown()) == 6

    def run(rows):
        writes(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        keep_held(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), held, str(tmp_path / "c"), "0 seconds").awaitTermination(120)

    run([(1, 1, 7, "v", None), (2, 1, 8, "v", "WRONG")])
    assert shown() == [(1, 8), (2, 7), (2, 8), (3, 7), (3, 8)]
    run([(3, 1, 7, "v", "WRONG"), (4, 2, 8, "v", "CORRECT")])
    assert shown() == [(1, 7), (1, 8), (2, 7), (3, 7), (3, 8)]
    run([(30_000, 3, 9, "w", None)])  # the others have been idle for too long
    run([(30_001, 3, 9, "w", None)])
    assert shown() == [(q, s) for q in (1, 2, 3) for s in (7, 8)] and {r.code for r in held.read().collect()} == {3}
