from pyspark.sql import functions as F

from arraylume.functions import expression as e
from arraylume.streaming.elements import map_stream, threshold_stream, windowed_histogram


def test_stream_equals_table(spark, tmp_path):
    table = spark.range(100).select(F.timestamp_seconds(F.col("id") * 30).alias("ts"), (F.col("id") % 10).cast("double").alias("value"))
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    steps = threshold_stream(map_stream(stream, "value", lambda x: e.sqrt(x)), "value", 2.0)
    query = steps.writeStream.format("memory").queryName("steps").option("checkpointLocation", str(tmp_path / "c1")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("SELECT sum(above) FROM steps").first()[0] == 60
    counts = windowed_histogram(stream, "value", "ts", "10 minutes", "1 minute", 5, 0.0, 10.0)
    query = counts.writeStream.format("memory").queryName("bins").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("SELECT sum(count), count(DISTINCT start) FROM bins").first() == (100, 5)
