import datetime as dt

from textloom.streaming.alerts import late_units_by_window, shared_unit_alerts

UNITS = "case_id string, unit_id string, pos long, group_name string, normalized string, comparable boolean, parsed_at timestamp, loaded_at timestamp"


def drain(spark, df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def test_alerts_and_late_units(spark, tmp_path):
    t = dt.datetime(2025, 1, 1, 12)
    rows = [("c", "u1", 1, "A", "同一段文字", True, t, t), ("c", "u1", 1, "A", "同一段文字", True, t, t), ("c", "u2", 2, "A", None, True, t, t + dt.timedelta(days=3)), ("d", "u3", 3, "A", "同一段文字", True, t, t)]
    spark.createDataFrame(rows, UNITS).write.parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([("c", "k1", 9, "B", "同一段文字", True, t, t), ("c", "k2", 8, "A", "同一段文字", True, t, t)], UNITS)
    stream = spark.readStream.schema(UNITS).parquet(str(tmp_path / "in"))
    got = drain(spark, shared_unit_alerts(stream, known), "alerts", "append")
    assert [(r["unit_id"], r["other_group"]) for r in got] == [("u1", "B")]
    windows = {r["start"].day: (r["units"], r["late"]) for r in drain(spark, late_units_by_window(stream), "late", "complete")}
    assert windows == {1: (3, 0), 4: (1, 1)}
