import os

import pytest

from tidemark.session import drop_stored, store, store_buckets


def test_stored_tables_come_back_and_can_be_dropped(spark):
    df = spark.createDataFrame([(1, [1.5, None], "a"), (2, None, None)], "id bigint, v array<double>, s string")
    kept = store(df)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, df.collect()))
    assert store(df.limit(0)).count() == 0
    folder = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    drop_stored(kept)
    assert not os.path.exists(folder)


def test_other_tables_are_not_dropped(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/mine")
    with pytest.raises(ValueError):
        drop_stored(spark.read.parquet(f"{tmp_path}/mine"))


def test_buckets_are_read_without_a_shuffle(spark):
    df = spark.range(100).selectExpr("id", "id % 7 as cell")
    kept = store_buckets(df, "cell", 4)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, df.collect()))
    grouped = kept.groupBy("cell").applyInArrow(lambda t: t, "id long, cell long")
    assert "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString()
    assert grouped.count() == 100
    assert store_buckets(df.limit(0), "cell", 4).count() == 0
