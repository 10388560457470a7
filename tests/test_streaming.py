import pytest

from snapquery import Snapshot, c, count, sum_
from snapquery.errors import UnsupportedOperation
from snapquery.streaming.replay import replay


def test_a_query_replayed_on_a_stream(spark, tmp_path):
    frame = spark.range(100).selectExpr("id", "id % 3 AS k", "timestamp_seconds(id) AS at")
    frame.write.parquet(str(tmp_path / "in"))
    query = Snapshot.from_df(frame, ["id"]).query().where(c.id >= 10).select("k", "id").group_by("k").agg(n=count(), total=sum_("id"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    replay(query, stream).writeStream.format("memory").queryName("replayed").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()
    assert sorted(map(tuple, spark.table("replayed").collect())) == sorted(map(tuple, query.to_list()))
    with pytest.raises(UnsupportedOperation):
        replay(query.take(1), stream)


def test_windows_of_event_time(spark, tmp_path):
    frame = spark.range(100).selectExpr("id % 2 AS k", "timestamp_seconds(id) AS at")
    frame.write.parquet(str(tmp_path / "in"))
    query = Snapshot.from_df(frame).query().group_by("k").agg(n=count())
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    replay(query, stream, "at", "1 minute", "10 seconds").writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert [r.n for r in spark.table("windowed").collect()] == [5] * 20
