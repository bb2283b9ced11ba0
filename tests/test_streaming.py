"""The decision log's stateful streams and its sink, batch by batch."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanforge.operators import sequence
from spanforge.streaming import decisions

SCHEMA = "log string, key string, call string, ts timestamp"


def at(text):
    return dt.datetime.fromisoformat(f"2026-{text}")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def feed(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def drain(out, folder, name):
    q = out.writeStream.format("parquet").option("path", str(folder / name)).option("checkpointLocation", str(folder / f"{name}-cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def marks(spark, folder, name):
    return spark.read.format("statestore").option("stateVarName", "mark").load(str(folder / f"{name}-cp")).count()


def test_state_goes_when_the_watermark_is_thirty_days_on(spark, tmp_path):
    first = [("l", "a", None, at("01-01 00:00:00")), ("l", "a", None, at("01-01 00:00:03")), ("l", "b", "c1", at("01-01 00:00:04")), ("l", "b", "c1", at("01-01 00:09:04")), ("m", "a", None, at("01-01 00:00:01"))]
    feed(spark, tmp_path / "in", first)
    run = lambda: drain(decisions.dedupe_stream(stream(spark, tmp_path / "in"), "log", "key", "ts", call_id="call"), tmp_path, "out")
    kept = lambda: sorted((r["log"], r["key"], str(r["ts"])[5:]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    run()
    assert kept() == [("l", "a", "01-01 00:00:00"), ("l", "b", "01-01 00:00:04"), ("m", "a", "01-01 00:00:01")]
    assert marks(spark, tmp_path, "out") == 2
    feed(spark, tmp_path / "in", [("l", "b", "c1", at("01-01 01:00:00")), ("n", "x", None, at("01-20 00:00:00"))])  # the call id repeats over batches
    run()
    assert len(kept()) == 4 and marks(spark, tmp_path, "out") == 3
    feed(spark, tmp_path / "in", [("n", "y", None, at("02-10 00:00:00"))])  # moves the watermark 30 days on
    run()
    feed(spark, tmp_path / "in", [("n", "z", None, at("02-10 00:00:09"))])
    run()
    assert marks(spark, tmp_path, "out") == 1  # of l and m nothing is left


def test_one_record_an_hour_and_its_state(spark, tmp_path):
    rows = [("p", "x", None, at(f"01-01 {t}")) for t in ("10:59:00", "11:01:00", "11:59:00", "12:58:59")] + [("q", "x", None, at("01-01 11:01:00"))]
    feed(spark, tmp_path / "in", rows)
    run = lambda: drain(decisions.once_an_hour(stream(spark, tmp_path / "in"), "log", "ts"), tmp_path, "out")
    run()
    assert sorted((r["log"], str(r["ts"])[11:16]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("p", "10:59"), ("p", "11:59"), ("q", "11:01")]
    for day in ("03-01 00:00:00", "03-01 00:00:09"):
        feed(spark, tmp_path / "in", [("z", "x", None, at(day))])
        run()
    assert marks(spark, tmp_path, "out") == 1


def test_log_sink_commits_each_batch_once(spark, tmp_path):
    """A replayed batch changes nothing; repeats go within and over batches; a lost commit leaves the old version."""
    log = decisions.DecisionLog(spark, str(tmp_path / "log"), ["key"], call_id="call")
    one = spark.createDataFrame([("l", "a", None, at("01-01 00:00:00")), ("l", "a", None, at("01-01 00:00:02")), ("l", "b", "c", at("01-01 00:00:04")), ("m", "a", None, at("01-01 00:00:01"))], SCHEMA)
    two = spark.createDataFrame([("l", "b", "c", at("01-01 05:00:00")), ("m", "a", None, at("01-01 00:00:03")), ("m", "a", None, at("01-01 00:00:09")), ("n", "a", None, at("01-01 00:00:03"))], SCHEMA)
    rows = lambda: sorted((r["log"], r["key"], str(r["ts"])[11:]) for r in log.read().collect())
    assert log.read() is None and log.add(one, 0)
    first = [("l", "a", "00:00:00"), ("l", "b", "00:00:04"), ("m", "a", "00:00:01")]
    assert rows() == first
    assert not log.add(two, 0) and rows() == first
    (tmp_path / "log" / "batches" / "1").write_text('["taken"]')  # another writer has committed the batch
    assert not log.store.write_once(str(tmp_path / "log" / "batches" / "1"), "[]")
    (tmp_path / "log" / "batches" / "1").unlink()
    assert log.add(two, 1) and not log.add(two, 1)
    assert rows() == [*first, ("m", "a", "00:00:09"), ("n", "a", "00:00:03")]
    both = one.union(two).withColumn("seq", F.monotonically_increasing_id())
    want = sequence.dedupe_window(both, ["key"], ["ts", "seq"], "ts", 3000, "call", ["log"])
    assert rows() == sorted((r["log"], r["key"], str(r["ts"])[11:]) for r in want.collect())
    assert log.add(one.limit(0), 2) and len(rows()) == 5


def test_log_sink_compacts_like_the_batch_operator(spark, tmp_path):
    log = decisions.DecisionLog(spark, str(tmp_path / "log"), ["key"], most=2500, target=1500, days=20)
    day = lambda i: at("01-01 00:00:00") + dt.timedelta(hours=i)
    batches = [spark.createDataFrame([("l", f"k{i}", None, day(i)) for i in range(a, a + 25)] + [("m", "k", None, day(a))], SCHEMA) for a in (0, 25, 50)]
    for i, b in enumerate(batches[:1]):
        assert log.add(b, i) and log.read().count() == 26
    assert log.add(batches[1], 1)
    whole = batches[0].union(batches[1]).withColumn("seq", F.row_number().over(Window.partitionBy("log").orderBy("ts")))
    size = F.octet_length(F.to_json(F.struct("log", "key", "call", "ts"))) + 1
    want = sequence.compact_log(whole, ["seq"], size, "ts", F.lit(day(49)), 2500, 1500, 20)
    names = lambda df: sorted((r["log"], r["key"], r["ts"]) for r in df.collect())
    assert names(log.read()) == names(want) and len(log.segments()) == 1 and log.read().count() < 40
    assert log.add(batches[2], 2) and log.vacuum() >= 1 and log.read().where("key = 'k74'").count() == 1


def test_log_sink_in_a_stream(spark, tmp_path):
    rows = [("l", "mail a.b@c.org", None, at("01-01 00:00:00")), ("l", "mail a.b@c.org", None, at("01-01 00:00:01"))]
    feed(spark, tmp_path / "in", rows)
    feed(spark, tmp_path / "in", [("l", "x", None, at("01-01 00:01:00"))])
    log = decisions.DecisionLog(spark, str(tmp_path / "log"), ["key"])
    for _ in range(2):  # the second start has nothing to do
        decisions.keep_log(stream(spark, tmp_path / "in"), log, str(tmp_path / "cp"), "key").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r["key"] for r in log.read().collect()) == ["mail <email>", "x"] and len(log.versions()) == 2
