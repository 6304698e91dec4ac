"""Streams against their batch twins, in many micro-batches; state that is dropped with its day."""

import datetime
import random

from pyspark.sql import functions as F

from lattica.operators import records
from lattica.streaming import admission

DAY = datetime.datetime(2024, 3, 1, tzinfo=datetime.timezone.utc)


def events(seed, days):
    rng = random.Random(seed)
    rows = []
    for d in range(days):
        for k in range(120):
            user = "hot" if k % 3 == 0 else rng.choice("abcdefgh")
            rows.append((d * 1000 + k, user, DAY + datetime.timedelta(days=d, seconds=rng.randrange(0, 86_400))))
    return rows


def test_admission_in_many_batches(spark, tmp_path):
    rows = events(1, 6)
    frame = spark.createDataFrame(rows, "event_id long, user_id string, ts timestamp")
    for d in range(6):  # a file a day: one micro-batch each
        frame.where(F.floor(F.col("event_id") / 1000) == d).coalesce(1).write.parquet(f"file://{tmp_path}/in/{d}")
    stream = spark.readStream.schema(frame.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", admission.PROVIDER)
    try:
        out = admission.admitted(stream, "ts", "user_id", "event_id", 4, 21, "1 hour")
        q = out.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {r.id: r.admitted for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    want = {r.event_id: r.admitted for r in records.daily_admission(frame, "ts", "user_id", ["event_id"], 4, 21).collect()}
    assert got == want and sum(got.values()) == 6 * 21
    held = max(sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in q.recentProgress)
    last = sum(op["numRowsTotal"] for op in q.recentProgress[-1]["stateOperators"])
    keys = len({(d, u) for d in range(6) for _, u, _ in rows}) + 6
    assert last <= held < keys * 2  # counts and timers of some days, not of all


def test_admission_state_is_bounded_by_the_cap_not_by_users(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(admission, "LANES", 8)
    monkeypatch.setattr(admission, "BLOCK", 7)
    rng = random.Random(3)
    times = sorted(rng.randrange(0, 86_400) for _ in range(900))
    rows = [(k, None if k % 50 == 0 else f"u{rng.randrange(400)}", DAY + datetime.timedelta(seconds=t)) for k, t in enumerate(times)]
    frame = spark.createDataFrame(rows, "event_id long, user_id string, ts timestamp")
    for part, (low, high) in enumerate(((0, 12), (12, 30), (30, 900))):  # of one day, in the order of time
        frame.where(F.col("event_id").between(low, high - 1)).coalesce(1).write.parquet(f"file://{tmp_path}/in/{part}")
    stream = spark.readStream.schema(frame.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", admission.PROVIDER)
    try:
        out = admission.admitted(stream, "ts", "user_id", "event_id", 2, 25)
        q = out.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted((r.id, r.admitted) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    want = sorted((r.event_id, r.admitted) for r in records.daily_admission(frame, "ts", "user_id", ["event_id"], 2, 25).collect())
    assert got == want and sum(a for _, a in got) == 25
    held = max(sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in q.recentProgress)
    assert held <= 4 * (8 + 1)  # a value and a timer a lane, and indexes of the timers; users are some 360


def test_admission_at_the_edges(spark):
    at = [DAY, DAY, DAY + datetime.timedelta(hours=23, minutes=59), DAY + datetime.timedelta(days=1), None]
    frame = spark.createDataFrame([(k, "u", t) for k, t in enumerate(at)], "event_id long, user_id string, ts timestamp")
    got = {r.event_id: r.admitted for r in records.daily_admission(frame, "ts", "user_id", ["event_id"], 2, 1).collect()}
    assert got[0] and not got[1] and not got[2] and got[3]
    same = frame.where("event_id = 0").union(frame.where("event_id = 0"))
    assert sorted(r.admitted for r in records.daily_admission(same, "ts", "user_id", ["event_id"], 2, 1).collect()) == [False, True]
