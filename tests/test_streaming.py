from pyspark.sql import functions as F

from foliant.operators import cast
from foliant.streaming import events


def run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        q.awaitTermination(300)
    finally:
        q.stop()
    return spark.table(name)


def folder(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.union(e.limit(50)).repartition(1).sortWithinPartitions("ts").write.parquet(f"{tmp_path}/in")
    return e, events.read(spark, f"{tmp_path}/in")


def test_distinct_and_daily(spark, tmp_path):
    e, stream = folder(spark, tmp_path)
    assert run(spark, events.distinct_events(stream, "40 days"), "distinct_events", "append").count() == e.dropDuplicates(["user_id", "event_type", "ts"]).count()
    got = {(r.day, r.event_type): r.n for r in run(spark, events.daily_counts(e_stream(spark, tmp_path, e)), "daily", "complete").collect()}
    want = {(r[0], r[1]): r[2] for r in e.groupBy(F.window("ts", "1 day").start.alias("d"), "event_type").count().collect()}
    assert got == want


def e_stream(spark, tmp_path, e):
    e.write.mode("overwrite").parquet(f"{tmp_path}/whole")
    return events.read(spark, f"{tmp_path}/whole")


def test_latest_and_schedules(spark, tmp_path):
    e, _ = folder(spark, tmp_path)
    got = sorted(map(tuple, run(spark, events.latest(e_stream(spark, tmp_path, e)), "latest", "complete").collect()))
    best = e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("x")).select("user_id", "x.ts", "x.event_id", "x.event_type")
    assert got == sorted(map(tuple, best.collect()))
    rows = run(spark, events.schedules(e_stream(spark, tmp_path, e)), "schedules", "update").collect()
    answers = e.select("user_id", "event_type", F.unix_millis("ts").alias("at"), F.col("event_id").alias("seq"), (F.col("value") > 20).alias("ok"))
    want = cast.schedules(answers, ["user_id", "event_type"]).select("user_id", "event_type", "reps", "lapses", "ease", "interval_days", "due_at", "last_at")
    assert sorted(map(tuple, rows)) == sorted(map(tuple, want.collect()))


def test_users_share_states(spark, tmp_path):
    """one state for the cards of neighbouring users, kept from batch to batch; users far apart or null have their own."""
    rows = [(i, 1000 * i, u, t, float(i * 7 % 40)) for i, (u, t) in enumerate([(u, t) for _ in range(3) for u in (*range(64), 2**60 + 1, 2**60 + 2, -1, None) for t in ("a", "b", None)])]
    e = spark.createDataFrame(rows, "event_id long, at long, user_id long, event_type string, value double").select("event_id", F.timestamp_millis("at").alias("ts"), "user_id", "event_type", "value", F.lit("").alias("props"))
    for half in (e.where("event_id < 300"), e.where("event_id >= 300")):
        half.coalesce(1).write.mode("append").parquet(f"{tmp_path}/halves")
    stream = spark.readStream.schema(events.SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/halves")
    q = events.schedules(stream).writeStream.format("memory").queryName("shared_states").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.lastProgress.stateOperators[0].numRowsTotal == 5
    last = {(r.user_id, r.event_type): tuple(r) for r in spark.table("shared_states").orderBy("last_at").collect()}
    answers = e.select("user_id", "event_type", F.unix_millis("ts").alias("at"), F.col("event_id").alias("seq"), (F.col("value") > 20).alias("ok"))
    want = cast.schedules(answers, ["user_id", "event_type"]).select("user_id", "event_type", "reps", "lapses", "ease", "interval_days", "due_at", "last_at")
    assert sorted(last.values(), key=str) == sorted(map(tuple, want.collect()), key=str)
