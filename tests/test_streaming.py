import datetime as dt

from pyspark.sql import functions as F

from paperloom.streaming import ingest


def test_stream_equals_batch(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(t + dt.timedelta(minutes=20 * i), "view", float(i)) for i in range(10)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").repartition(3).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    want = {tuple(r) for r in ingest.windowed_counts(batch).collect()}
    got = {tuple(r) for r in ingest.drain(ingest.windowed_counts(ingest.stream(spark, str(tmp_path / "in"), batch.schema, 1))).collect()}
    assert got == want and len(got) == 4


def test_jobs_by_priority(spark, tmp_path):
    jobs = spark.createDataFrame([(1, "sunset.jpg"), (2, "invoice_7.jpg")], "seq long, image_name string")
    jobs.write.parquet(str(tmp_path / "jobs"))
    q = ingest.process_jobs(ingest.stream(spark, str(tmp_path / "jobs"), jobs.schema), lambda b: b.withColumn("status", F.lit("completed")), str(tmp_path / "log"), str(tmp_path / "state"))
    q.awaitTermination()
    log = {r.seq: r.priority for r in spark.read.parquet(str(tmp_path / "log")).collect()}
    assert log == {1: 1, 2: 0}
