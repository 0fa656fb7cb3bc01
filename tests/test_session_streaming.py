"""The session's settings, and the windowed profile as a table and as a stream."""

import datetime as dt

import pytest

from tallyweave.session import session
from tallyweave.streaming.profiles import windowed_profile


def test_session_keeps_what_is_there(spark):
    got = session("another", spark_sql_shuffle_partitions="4")
    assert got.sparkContext is spark.sparkContext and got.conf.get("spark.sql.session.timeZone") == "UTC" and got.conf.get("spark.sql.adaptive.enabled") == "true"


def test_windowed_profile_of_a_table_and_a_stream(spark, tmp_path):
    day = lambda d, h: dt.datetime(2024, 1, d, h)
    rows = [(day(1, 1), "a", 2.0, 1.0), (day(1, 5), "a", 4.0, 3.0), (day(2, 1), "a", 1.0, 1.0), (day(1, 2), "b", None, 1.0), (day(1, 2), "b", 5.0, 0.0), (day(1, 3), None, 7.0, 2.0)]
    df = spark.createDataFrame(rows, "at timestamp, g string, x double, w double")
    want = sorted([(1, "None", 1, 2.0, 14.0), (1, "a", 2, 4.0, 14.0), (2, "a", 1, 1.0, 1.0)])
    plain = lambda out: sorted((r.window.start.day, str(r.g), r.n, r.weight, r.weighted_sum) for r in out.collect())
    assert plain(windowed_profile(df, "at", ["g"], "x", "w")) == want
    df.write.parquet(f"{tmp_path}/in")
    stream = windowed_profile(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "at", ["g"], "x", "w")
    query = stream.writeStream.format("memory").queryName("windowed").outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert plain(spark.table("windowed")) == want
    with pytest.raises(Exception, match="absent"):
        windowed_profile(df, "at", ["absent"], "x", "w").collect()
