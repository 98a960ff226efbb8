import datetime as dt

from tarn.operators.filters import attr
from tarn.streaming import hourly_stream, ingest

NOON = dt.datetime(2024, 1, 1, 12)


def test_a_stream_is_upserted_and_rolled_up(store, spark, tmp_path):
    store.schema("event").field("kind", "string").field("value", "double").field("date", "timestamp").sum("value", by="kind", at="date").count(by="kind", at="date").create()
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    schema = "uuid string, kind string, value double, date timestamp"
    for rows in ([("1", "a", 1.0, NOON), ("2", "b", 2.0, NOON)], [("1", "b", 5.0, NOON + dt.timedelta(hours=1)), ("3", "a", 4.0, NOON - dt.timedelta(days=400))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        ingest(spark.readStream.schema(schema).parquet(source), store, "event", checkpoint).awaitTermination()
    q = store.query("event")
    assert q.count() == 3 and q.sum("value") == 11
    assert q.filter(attr("kind") == "a").sum("value") == 4
    points = [(r["grp"], r["hour"], r["value"]) for r in q.series(NOON, NOON + dt.timedelta(hours=2), "value", "sum", "kind").collect()]
    assert points == [("a", NOON, 0), ("b", NOON, 2), ("b", NOON + dt.timedelta(hours=1), 5)]
    assert {r["uuid"] for r in q.frame().collect()} == {"1", "2", "3"}


def test_hourly_stream_keeps_late_rows(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "kind string, value double, date timestamp"
    spark.createDataFrame([("a", 1.0, NOON), ("a", 2.0, NOON - dt.timedelta(days=30)), (None, 3.0, NOON)], schema).write.parquet(source)
    out = hourly_stream(spark.readStream.schema(schema).parquet(source), "date", "kind", "value")
    run = out.writeStream.outputMode("update").format("memory").queryName("hourly").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert {(r["grp"], r["n"], r["total"]) for r in spark.table("hourly").collect()} == {("a", 1, 1.0), ("a", 1, 2.0), ("", 1, 3.0)}


def test_streams_beside_direct_writes(store, spark, tmp_path):
    store.schema("event").field("value", "double").sum("value").count().create()
    schema = "uuid string, value double"

    def step(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        ingest(spark.readStream.schema(schema).parquet(str(tmp_path / name)), store, "event", str(tmp_path / f"{name}-checkpoint")).awaitTermination()

    step("one", [("a", 1.0)])
    store.write("event", [{"uuid": "b", "value": 2.0}])
    step("two", [("c", 4.0)])
    step("one", [("d", 8.0)])
    store.write("event", [{"uuid": "a", "value": 16.0}], batch=1)
    step("two", [("e", 32.0)])
    assert (store.query("event").count(), store.query("event").sum("value")) == (5, 2 + 4 + 8 + 16 + 32)
    assert store.query("event").frame().count() == 5
