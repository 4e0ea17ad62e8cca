"""The streaming frame rollup over parquet readings, driven to completion in memory."""

import tempfile

from helpers import SMALL


def test_frames_stream_matches_batch_counts(spark):
    from roadwise.plans import medallion as MD
    from roadwise.streaming.frames_stream import frames_stream
    src = tempfile.mkdtemp(prefix="roadwise-stream-src-")
    b = MD.bronze_readings(spark, SMALL).select("station_id", "ts", "avg_speed_mph", "demanded_flow_vph",
                                                 "total_flow_vph", "incident_active")
    b.write.mode("overwrite").parquet(src)
    df = frames_stream(spark, src, b.schema, watermark="0 minutes")
    q = df.writeStream.outputMode("update").format("memory").queryName("frames_stream_test").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    out = spark.sql("SELECT station_id, time_bucket, sample_count FROM frames_stream_test")
    batch = b.selectExpr("station_id", "window(ts, '15 minutes').start AS time_bucket").groupBy(
        "station_id", "time_bucket").count()
    assert out.count() == batch.count()
    assert out.agg({"sample_count": "sum"}).first()[0] == b.count()
