from faultline.streaming.histogram import entries_of_stream, minute_counts


def test_minutes_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("2026-07-28 12:34:01 ERROR [pay] boom 1\n\tat a.b(C.java:1)\n2026-07-28 12:34:59 WARN [pay] slow\n2026-07-28 12:35:00 INFO [pay] fine\n2026-07-28 12:35:01 ERROR [pay] boom 2\n")
    stream = spark.readStream.schema("value string").text(str(tmp_path / "in")).withColumnRenamed("value", "raw")
    q = minute_counts(entries_of_stream(stream)).writeStream.outputMode("complete").format("memory").queryName("minutes").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(str(r["minute"])[11:16], r["level"]): r["count"] for r in spark.table("minutes").collect()}
    assert got == {("12:34", "ERROR"): 1, ("12:34", "WARN"): 1, ("12:35", "ERROR"): 1}
