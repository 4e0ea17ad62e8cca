"""Streaming 15-minute station frames from 5-minute readings.

Readings arrive as parquet files (schema of ``bronze_readings``); a 15-minute event-time
window per station with a watermark emits each bucket once it can no longer change
(append mode). State is bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.numeric import E


def frames_stream(spark: SparkSession, source_dir: str, schema, watermark: str = "30 minutes") -> DataFrame:
    # watermarks need TIMESTAMP; the UTC wall time is cast there and back (15-minute
    # boundaries do not depend on the zone offset used for the round trip)
    src = spark.readStream.schema(schema).parquet(source_dir).selectExpr("*", "CAST(ts AS TIMESTAMP) AS event_time")
    return (src.withWatermark("event_time", watermark)
               .groupBy(E("window(event_time, '15 minutes')").alias("w"), "station_id")
               .agg(E("count(1)").alias("sample_count"), E("avg(avg_speed_mph)").alias("avg_speed_mph"),
                    E("avg(demanded_flow_vph)").alias("avg_demanded_flow_vph"),
                    E("max(total_flow_vph)").alias("peak_flow_vph"), E("bool_or(incident_active)").alias("incident_active"))
               .selectExpr("CAST(w.start AS TIMESTAMP_NTZ) AS time_bucket", "station_id", "sample_count", "avg_speed_mph",
                           "avg_demanded_flow_vph", "peak_flow_vph", "incident_active"))


def start(df: DataFrame, sink_dir: str, checkpoint_dir: str):
    """Append finished buckets to parquet; ``checkpoint_dir`` must be a shared folder."""
    return (df.writeStream.outputMode("append").format("parquet")
              .option("path", sink_dir).option("checkpointLocation", checkpoint_dir).start())
