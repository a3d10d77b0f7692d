from pyspark.sql import functions as F

from strandwise.streaming.sessions import first_seen, gap_sessions, histogram


def run(spark, tmp_path, make, mode="append"):
    rows = [(1, f"2024-01-01 00:{m:02d}:00", v) for m, v in ((0, 5), (3, 7), (20, 1), (21, 1))] + [(2, "2024-01-01 00:01:00", 9), (9, "2024-01-02 00:00:00", 0)]
    spark.createDataFrame(rows, "k int, t string, v int").select("k", F.to_timestamp("t").alias("t"), "v").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, t timestamp, v int").parquet(str(tmp_path / "in"))
    query = make(stream).writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table("out").collect()


def test_sessions(spark, tmp_path):
    got = run(spark, tmp_path, lambda s: gap_sessions(s, ["k"], "t", "5 minutes", "10 minutes", total=F.sum("v")))
    assert sorted((r.k, r.n, r.total) for r in got if r.k != 9) == [(1, 2, 2), (1, 2, 12), (2, 1, 9)]


def test_histogram(spark, tmp_path):
    got = run(spark, tmp_path, lambda s: histogram(s, ["k"], "t", F.expr("v div 5"), "10 minutes", "1 minute"))
    assert sorted((r.k, r.bucket, r.n) for r in got if r.k != 9) == [(1, 0, 2), (1, 1, 2), (2, 1, 1)]


def test_first_seen(spark, tmp_path):
    assert len(run(spark, tmp_path, lambda s: first_seen(s, ["k"], "t", "1 hour"))) == 3
