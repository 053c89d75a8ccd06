from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.streaming import files


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(1, "2 cups, 1 tbsp, stir"), (2, None), (3, "x")], "id int, text string")
    df.write.parquet(str(tmp_path / "in"))
    stream = files.score_stream(files.read_chunk_stream(spark, str(tmp_path / "in"), df.schema))
    files.run_available(stream, lambda part, _: part.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "cp"))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, files.score_stream(df).collect()))


def test_first_names_and_windows(spark, tmp_path):
    t = datetime(2025, 1, 1)
    df = spark.createDataFrame([("Pie", t), (" pie ", t + timedelta(hours=1)), ("Tart", t)], "name string, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = files.first_names(files.read_chunk_stream(spark, str(tmp_path / "in"), df.schema), "name", "ts")
    files.run_available(stream, lambda part, _: part.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "cp"))
    assert sorted(r["name_key"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["pie", "tart"]
    counts = files.start_counts(files.read_chunk_stream(spark, str(tmp_path / "in"), df.schema), "name", "ts", "1 hour", "1 hour")
    files.run_available(counts, lambda part, _: part.select(F.col("window.start"), "name", "starts").write.mode("append").parquet(str(tmp_path / "out2")), str(tmp_path / "cp2"), "complete")
    assert spark.read.parquet(str(tmp_path / "out2")).count() >= 3
