import dataclasses
import datetime as dt
import decimal
import io
import warnings

import pyarrow as pa
import pytest

from snapquery import ReadOptions, Snapshot, c, count, field
from snapquery import types as t
from snapquery.errors import SchemaError
from snapquery.schema import RecordSchema

ALL = [("i8", t.Int8), ("i16", t.Int16), ("i32", t.Int32), ("i64", t.Int64), ("u8", t.UInt8), ("u16", t.UInt16), ("u32", t.UInt32), ("u64", t.UInt64), ("h", t.Half), ("f", t.Float), ("d", t.Double), ("b", t.Bool), ("m", t.Decimal), ("s", t.String), ("y", t.Binary), ("ts", t.Timestamp)]
VALUES = (-128, -32768, -(2**31), -(2**63), 255, 65535, 2**32 - 1, 2**64 - 1, 1.5, 0.25, 1e300, True, decimal.Decimal("123.456789"), "ä", b"\x00\xff", dt.datetime(2020, 1, 2, 3, 4, 5, 678000))


@pytest.mark.parametrize("codec", [None, "lz4", "zstd"])
def test_ipc_keeps_every_type(spark, tmp_path, codec):
    s = Snapshot.from_rows(spark, [VALUES, (None,) * len(ALL)], [(n, k | None) for n, k in ALL])
    data = s.to_ipc_bytes(codec)
    types = pa.ipc.open_stream(data).schema.types
    assert types == [k.arrow for _, k in ALL]
    again = Snapshot.from_ipc(spark, data, [(n, k | None) for n, k in ALL])
    assert again.query().to_list() == s.query().to_list()
    assert tuple(again.query().first()) == (*VALUES[:7], decimal.Decimal(2**64 - 1), *VALUES[8:14], bytearray(VALUES[14]), VALUES[15])
    s.write_ipc(str(tmp_path / "out"), codec)
    folder = Snapshot.from_ipc(spark, str(tmp_path / "out"), [(n, k | None) for n, k in ALL])
    assert sorted(map(str, folder.query().to_list())) == sorted(map(str, s.query().to_list()))


def test_ipc_of_many_batches_and_inputs(spark):
    table = pa.table({"k": pa.array([1, 2, 3], pa.uint16()), "v": pa.array(["a", "b", "a"]).dictionary_encode()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        for b in table.to_batches(max_chunksize=1):
            w.write_batch(b)
    data = sink.getvalue().to_pybytes()
    for source in (data, [data[:10], data[10:]], io.BytesIO(data), pa.py_buffer(data)):
        assert [tuple(r) for r in Snapshot.from_ipc(spark, source).query().to_list()] == [(1, "a"), (2, "b"), (3, "a")]


def test_folder_of_streams_is_read_in_parallel(spark, tmp_path):
    s = Snapshot.from_df(spark.range(1000).repartition(4), ["id"])
    s.write_ipc(str(tmp_path / "x"), "zstd")
    back = Snapshot.from_ipc(spark, str(tmp_path / "x"), order_by=["id"])
    assert back.query().sum("id") == 499500 and back.query().take(2).to_list()[1].id == 1
    assert len([p for p in (tmp_path / "x").iterdir() if p.suffix == ".arrows"]) == 4


def test_evolution(spark):
    wide = Snapshot.from_rows(spark, [(1, "x", 2.5)], [("a", t.Int32), ("b", t.String), ("c", t.Double)]).to_ipc_bytes()
    narrow = [("c", t.Double), ("a", t.Int64)]
    assert tuple(Snapshot.from_ipc(spark, wide, narrow).query().first()) == (2.5, 1)
    more = [("a", t.Int32), ("n", t.Int32), ("s", t.String), ("f", t.Bool), ("o", t.Int32 | None), ("w", t.Timestamp)]
    assert tuple(Snapshot.from_ipc(spark, wide, more).query().first()) == (1, 0, None, False, None, dt.datetime(1, 1, 1))
    with pytest.raises(SchemaError, match="unknown columns: b"):
        Snapshot.from_ipc(spark, wide, narrow, ReadOptions(unknown="throw"))
    with pytest.raises(SchemaError, match="missing columns: n"):
        Snapshot.from_ipc(spark, wide, more, ReadOptions(missing="throw"))
    with pytest.raises(ValueError):
        ReadOptions(unknown="maybe")


def test_declarations(spark):
    @dataclasses.dataclass
    class Record:
        Id: t.Int32 = field("record_id")
        Name: str = field("record_name")
        Weight: float | None = None

    schema = RecordSchema.of(Record)
    assert schema.names == ["record_id", "record_name", "Weight"] and schema.columns[2].nullable
    s = Snapshot.from_rows(spark, [Record(7, "x", 1.0), Record(8, None)], Record)
    assert s.columns == schema.names and s.query().where(c.record_id == 8).first().Weight is None
    with pytest.raises(SchemaError):
        RecordSchema.of([])
    with pytest.raises(SchemaError):
        RecordSchema.of([("x", list)])
    with pytest.raises(SchemaError):
        RecordSchema.of([("x", t.Int32), ("x", t.Int32)])

    @dataclasses.dataclass
    class Unnamed:
        Id: t.Int32 = field()

    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        RecordSchema.of(Unnamed)
    assert seen


def test_parquet_is_pushed_down(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id % 7 AS k", "cast(id AS string) AS s").write.parquet(str(tmp_path / "p"))
    s = Snapshot.from_parquet(spark, str(tmp_path / "p"), ["id"])
    plan = s.query().where(c.id > 990).group_by("k").agg(n=count()).explain_plan()
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,990)" in plan and "ReadSchema: struct<id:bigint,k:bigint>" in plan
    s.write_parquet(str(tmp_path / "sorted"), ["k"])
    assert Snapshot.from_parquet(spark, str(tmp_path / "sorted")).query().count() == 1000


def test_statistics(spark):
    rows = [(i, i // 50, None if i % 3 else "x", i % 4) for i in range(200)]
    s = Snapshot.from_rows(spark, rows, [("Id", t.Int32), ("Sorted", t.Int32), ("Text", t.String), ("Few", t.Int64)])
    stats = s.statistics()
    assert stats.rows == 200
    assert (stats["Sorted"].runs, stats["Sorted"].distinct, stats["Sorted"].advice) == (4, 4, "run_length")
    assert (stats["Text"].runs, stats["Text"].distinct, stats["Text"].nulls) == (134, 2, 133)
    assert stats["Few"].advice == "dictionary" and stats["Id"].advice == "plain"
    assert stats.run_candidates() == ["Sorted"] and set(stats.dictionary_candidates()) == {"Sorted", "Text", "Few"}
    assert stats.estimated_savings() == (800 - 4 * 8) + (1600 - 2 * 8 - 200) + (1600 - 4 * 8 - 200)
    assert "run_length" in stats.summary()


def test_a_second_write_is_refused_replaces_or_adds(spark, tmp_path):
    snap, path = Snapshot.from_df(spark.range(10), ["id"]), str(tmp_path / "ipc")
    snap.write_ipc(path)
    with pytest.raises(FileExistsError):
        snap.write_ipc(path)
    assert Snapshot.from_ipc(spark, path).query().count() == 10
    snap.write_ipc(path, mode="overwrite")
    assert Snapshot.from_ipc(spark, path).query().count() == 10
    snap.write_ipc(path, mode="append")
    assert Snapshot.from_ipc(spark, path).query().count() == 20
    with pytest.raises(ValueError):
        snap.write_ipc(path, mode="replace")


def test_a_copy_outlives_its_source(spark, tmp_path):
    source = str(tmp_path / "s")
    spark.range(5).write.parquet(source)
    snap = Snapshot.from_parquet(spark, source, ["id"], copy_to=str(tmp_path / "copies"))
    spark.range(9).write.mode("overwrite").parquet(source)
    assert snap.query().count() == 5 and len(list((tmp_path / "copies").iterdir())) == 1
