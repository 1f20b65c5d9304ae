"""The stream gives the rows of the batch, but for the windows that are still open."""

from pyspark.sql import functions as F

from kgspark.streaming import events

SF = "/root/testdata/sf0.01"


def rows(df):
    return sorted(map(tuple, df.collect()))


def streamed(spark, tmp_path, transform):
    table = spark.read.parquet(f"{SF}/events.parquet")
    for k in range(4):  # in order of time, as they arrive
        table.where((F.dayofmonth("ts") - 1) / 8 >= k).where((F.dayofmonth("ts") - 1) / 8 < k + 1).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    timed = events.with_time(events.stream(spark, f"{tmp_path}/in", 4), "1 hour")
    events.write(transform(timed), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination(120)
    return rows(spark.read.parquet(f"{tmp_path}/out")), rows(transform(events.with_time(table)))


def test_windows(spark, tmp_path):
    found, all_rows = streamed(spark, tmp_path, lambda df: events.per_window(df))
    last = max(r[0] for r in all_rows)
    assert found == [r for r in all_rows if r[0] < last] and len(found) == 145


def test_sessions(spark, tmp_path):
    found, all_rows = streamed(spark, tmp_path, lambda df: events.sessions(df))
    assert set(found) <= set(all_rows) and len(found) > 0.95 * len(all_rows)


def test_hopping_windows_count_twice(spark):
    table = events.with_time(spark.read.parquet(f"{SF}/events.parquet"))
    hopping = events.per_window(table, "2 days", (), "1 day")
    assert hopping.agg(F.sum("n")).first()[0] == 2 * table.count()
