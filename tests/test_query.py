import dataclasses
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from snapquery import Snapshot, any_of, average, c, count, long_count, max_, min_, not_, sum_
from snapquery import types as t
from snapquery.errors import (
    ClosedSnapshotError, ColumnNotFound, EmptySequenceError, MultipleElementsError, SchemaError, UnsupportedOperation,
)
from snapquery.functions.predicates import predicate
from snapquery.operators import rows
from snapquery.plans.cache import Tracker

PEOPLE = [("Id", t.Int32), ("Name", t.String), ("Age", t.Int32), ("Score", t.Double), ("Category", t.String)]
ROWS = [(1, "Alice", 25, 85.5, "A"), (2, "Bob", 30, 92.0, "B"), (3, "Charlie", 35, 78.3, "A"), (4, "David", 28, 88.7, "B"), (5, "Eve", 32, 95.2, "C")]


@pytest.fixture(scope="module")
def people(spark):
    return Snapshot.from_rows(spark, ROWS, PEOPLE)


@pytest.fixture(scope="module")
def numbers(spark):
    rows = [(i, 10 * i, i % 2 == 0, "ABC"[i % 3]) for i in range(100)]
    return Snapshot.from_rows(spark, rows, [("Id", t.Int32), ("Value", t.Int32), ("IsActive", t.Bool), ("Category", t.String)])


@pytest.fixture(scope="module")
def gaps(spark):
    rows = [(1, "Alice", 95.5, True), (2, "Bob", None, True), (3, None, 87.0, False), (4, None, None, None), (5, "Eve", float("nan"), None)]
    return Snapshot.from_rows(spark, rows, [("Id", t.Int32), ("Name", t.String | None), ("Score", t.Double | None), ("Active", t.Bool | None)])


def ids(q):
    return [r[0] for r in q.select("Id").to_list()]


def test_filters(people):
    q = people.query()
    assert ids(q.where(c.Age > 30)) == [3, 5]
    assert ids(q.where(30 < c.Age)) == [3, 5]
    assert ids(q.where(c.Age > 26, c.Category == "B")) == [2, 4]
    assert ids(q.where(Category="A")) == [1, 3]
    assert ids(q.where(c.Name.contains("li"))) == [1, 3]
    assert ids(q.where(c.Name.startswith("a", ignore_case=True))) == [1]
    assert ids(q.where(c.Name.like("%e"))) == [1, 3, 5]
    assert ids(q.where(c.Name.like("B_b"))) == [2]
    assert ids(q.where(any_of(c.Id == 1, c.Id == 3, c.Id == 5) & (c.Age < 33))) == [1, 5]
    assert ids(q.where(F.col("Age") % 2 == 0)) == [2, 4, 5]
    assert q.count(c.Age >= 30) == 3


def test_nulls_are_two_valued(gaps):
    q = gaps.query()
    assert ids(q.where(c.Name == "Alice")) == [1]
    assert ids(q.where(c.Name != "Alice")) == [2, 3, 4, 5]
    assert ids(q.where(not_(c.Score > 90))) == [2, 3, 4, 5]
    assert ids(q.where(c.Score <= 90)) == [3]
    assert ids(q.where(c.Score > 90)) == [1]
    assert ids(q.where(c.Score != 87.0)) == [1, 5]
    assert ids(q.where(~c.Active)) == [3]
    assert ids(q.where(c.Active)) == [1, 2]
    assert ids(q.where(c.Name == None)) == [3, 4]  # noqa: E711
    assert ids(q.where(c.Score.has_value())) == [1, 3, 5]
    assert not q.all(c.Active)


def test_projection_and_order(people):
    q = people.query()
    assert q.select("Name", years="Age").to_df().columns == ["Name", "years"]
    assert [r.Name for r in q.order_by_desc("Score").select("Name").take(2).to_list()] == ["Eve", "Bob"]
    assert [r.Id for r in q.order_by("Category").then_by_desc("Age").to_list()] == [3, 1, 2, 4, 5]
    assert q.order_by("Score").last().Name == "Eve"
    assert [r.Id for r in q.reverse()] == [5, 4, 3, 2, 1]
    for bad in (lambda: q.select("nope"), lambda: q.where(c.name == "x"), lambda: q.order_by("age"), lambda: q.group_by("x").agg(n=count()), lambda: q.sum("x")):
        with pytest.raises(ColumnNotFound):
            bad()


def test_pages(numbers):
    q = numbers.query()
    assert ids(q.take(3)) == [0, 1, 2]
    assert ids(q.skip(97)) == [97, 98, 99]
    assert ids(q.skip(10).take(2)) == [10, 11]
    assert ids(q.page(10, 2)) == [10, 11]
    assert ids(q.take(0)) == [] and ids(q.skip(1000)) == []
    assert ids(q.take(10).where(c.Value > 50)) == [6, 7, 8, 9]
    assert ids(q.where(c.Value > 50).take(3)) == [6, 7, 8]
    assert ids(q.take(10).where(c.IsActive).take(2)) == [0, 2]
    assert q.skip(95).count() == 5 and q.where(c.IsActive).take(7).count() == 7
    for bad in (lambda: q.take(-1), lambda: q.skip(-1)):
        with pytest.raises(ValueError):
            bad()


def test_skip_then_take_is_one_page(numbers):
    q = numbers.query().order_by_desc("Category").skip(30).take(5)
    assert ids(q) == [92, 95, 98, 1, 4]
    plan = q.to_df(False)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=35, offset=30" in plan and "Exchange" not in plan
    assert ids(numbers.query().skip(10).select("Id").take(2)) == ids(numbers.query().skip(6).skip(4).take(2)) == [10, 11]
    assert ids(numbers.query().skip(90).order_by_desc("Id").take(2)) == [99, 98] and ids(numbers.query().skip(98).take(2**31 - 1)) == [98, 99]


def test_skip_numbers_only_rows_near_its_edge(spark, numbers):
    q = numbers.query().order_by_desc("Category").skip(30)
    plan = q.to_df(False)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Limit" not in plan
    assert [r.Id for r in q.to_df(False).collect()] == ids(q) == sorted(range(100), key=lambda i: (-(i % 3), i))[30:]
    assert ids(numbers.query().skip(2).skip(95)) == [97, 98, 99]
    tied = Snapshot.from_df(spark.range(60, numPartitions=5).selectExpr("id", "id % 2 AS k"), ["k"]).query()  # a key that does not tell rows apart
    assert sorted(r.k for r in tied.skip(17).to_list()) == [0] * 13 + [1] * 30 and tied.skip(60).count() == 0 and tied.skip(30).take(30).count() == 30


def test_late_pages(spark, numbers, tmp_path, monkeypatch):
    monkeypatch.setattr(rows, "GATHERED", 5)
    monkeypatch.setattr(rows, "RANGES", 8)
    nan, items = float("nan"), []
    for i in range(300):
        items.append((i, [None, nan, 0.0, -0.0, 1.5, -3.0][i * 7 % 6], [None, "a", "b"][i * 5 % 3], i // 2))
    spark.createDataFrame(items, "i int, d double, t string, k int").repartition(4).write.parquet(f"{tmp_path}/p")
    keyed, tied, unkeyed = (Snapshot.from_parquet(spark, f"{tmp_path}/p", key).query() for key in (["i"], ["k"], None))
    grouped = keyed.group_by("k").agg(n=count())
    assert rows.repeatable(keyed._frame()) and rows.repeatable(grouped._frame())
    assert not rows.repeatable(unkeyed._frame()) and not rows.repeatable(keyed.group_by("k").agg(n=average("d"))._frame())
    for q in (keyed.order_by_desc("d").then_by("t"), unkeyed.order_by("t"), grouped):
        want = [str(r) for r in q.to_list()]
        assert [str(r) for r in q.skip(140).to_list()] == want[140:] and [str(r) for r in q.page(40, 70).to_list()] == want[40:110]
        assert [str(r) for r in q.first_n(120)] == want[:120] and str(q.element_at(99)) == want[99]
    assert [r.k for r in tied.page(31, 100).to_list()] == [r.k for r in tied.to_list()][31:131] and tied.skip(301).count() == 0
    assert ids(numbers.query().where(c.Id < 0).skip(50)) == [] and ids(numbers.query().page(98, 2**31 - 1)) == [98, 99]


def test_terminals(people, numbers):
    q = people.query()
    assert q.first().Id == 1 and q.first(c.Age > 30).Id == 3
    assert q.first_or_default(c.Age > 99) is None
    assert [r.Id for r in numbers.query().where(c.IsActive).first_n(2)] == [0, 2]
    assert q.single(c.Id == 4).Name == "David"
    assert q.single_or_default(c.Id == 9) is None
    assert q.any() and not q.any(c.Age > 99)
    assert q.all(c.Age > 20) and not q.all(c.Age > 25) and q.where(c.Age > 99).all(c.Age > 1000)
    assert q.element_at(2).Id == 3
    assert q.where(c.Age > 30).indices() == [2, 4]
    assert [r.Id for r in q] == [1, 2, 3, 4, 5]
    assert q.to_arrow().num_rows == 5
    for error, bad in ((EmptySequenceError, lambda: q.first(c.Age > 99)), (EmptySequenceError, lambda: q.single(c.Age > 99)), (MultipleElementsError, lambda: q.single(c.Age > 30)), (EmptySequenceError, lambda: q.element_at(5)), (EmptySequenceError, lambda: q.where(c.Age > 99).last())):
        with pytest.raises(error):
            bad()


def test_aggregates(people, gaps):
    q = people.query()
    assert (q.count(), q.long_count(), q.sum("Age"), q.average("Age"), q.min("Score"), q.max(c.Name)) == (5, 5, 150, 30.0, 78.3, "Eve")
    row = q.where(c.Age > 26).aggregate(n=count(), total=sum_("Age"), mean=average("Age"), least=min_("Age"), greatest=max_("Age"), of=long_count(), old=count(c.Age > 30))
    assert tuple(row) == (4, 125, 31.25, 28, 35, 4, 2)
    none = q.where(c.Age > 99)
    assert none.count() == 0 and none.sum("Age") == 0 and none.sum("Score") == 0.0
    for bad in (none.average, none.min, none.max):
        with pytest.raises(EmptySequenceError):
            bad("Age")
    assert gaps.query().where(c.Id == 2).sum("Score") == 0.0


def test_sums_are_wide(spark):
    s = Snapshot.from_rows(spark, [(2**31 - 1,), (2**31 - 1,)], [("V", t.Int32)])
    assert s.query().sum("V") == 2 * (2**31 - 1)


def test_groups(spark, people):
    q = people.query()
    assert [tuple(r) for r in q.group_by("Category").agg(n=count(), total=sum_("Age"), mean=average("Score")).to_list()] == [("A", 2, 60, 81.9), ("B", 2, 58, 90.35), ("C", 1, 32, 95.2)]
    assert [tuple(r) for r in q.where(c.Age > 26).group_by(Cat="Category").agg(n=count()).to_list()] == [("B", 2), ("A", 1), ("C", 1)]
    assert q.group_by("Category").to_dict(max_("Age")) == {"A": 35, "B": 30, "C": 32}
    amounts = [("A", a) for a in (50, 60, 40, 70, 30)] + [("B", 80), ("B", 40)] + [("C", 50)] * 8
    s = Snapshot.from_rows(spark, amounts, [("Category", t.String), ("Amount", t.Double)]).query().group_by("Category").agg(n=count(), total=sum_("Amount"), mean=average("Amount"))
    assert {r[0] for r in s.having(c.n > 3).to_list()} == {"A", "C"}
    assert {r[0] for r in s.having(c.total > 200).to_list()} == {"A", "C"}
    assert {r[0] for r in s.having(c["mean"] >= 50).to_list()} == {"A", "B", "C"}
    with pytest.raises(UnsupportedOperation):
        q.group_by("Category").agg(n="count")


def test_null_keys_are_no_group(gaps):
    assert [tuple(r) for r in gaps.query().group_by("Active").agg(n=count(), mean=average("Score"), least=min_("Score")).to_list()] == [(True, 2, 95.5, 95.5), (False, 1, 87.0, 87.0)]


def test_distinct_keeps_the_first_place(spark):
    s = Snapshot.from_rows(spark, [("A", 1), ("B", 2), ("A", 1), (None, 3), (None, 3), ("A", 2)], [("K", t.String), ("V", t.Int32)])
    assert [tuple(r) for r in s.query().distinct().to_list()] == [("A", 1), ("B", 2), (None, 3), ("A", 2)]
    assert [r.K for r in s.query().select("K").distinct().to_list()] == ["A", "B", None]


def test_joins(spark):
    customers = Snapshot.from_rows(spark, [(1, "Alice"), (2, "Bob"), (3, "Charlie"), (None, "Nobody")], [("Id", t.Int32 | None), ("Name", t.String)])
    orders = Snapshot.from_rows(spark, [(101, 1, 100.0), (102, 1, 200.0), (103, 2, 150.0), (104, None, 1.0)], [("Id", t.Int32), ("Customer", t.Int32 | None), ("Amount", t.Double)])
    q = customers.query()
    both = q.join(orders, {"Id": "Customer"})
    assert both.to_df().columns == ["Id", "Name", "Id_right", "Customer", "Amount"]
    assert [r.Id_right for r in both.to_list()] == [101, 102, 103]
    assert [r.Id_right for r in both.where(c.Amount > 120).to_list()] == [102, 103]
    assert [tuple(r)[1:] for r in q.group_join(orders, {"Id": "Customer"}, n=count(), total=sum_("Amount"), most=max_("Amount")).to_list()] == [("Alice", 2, 300.0, 200.0), ("Bob", 1, 150.0, 150.0), ("Charlie", 0, 0.0, None), ("Nobody", 0, 0.0, None)]
    assert [r.Name for r in q.join(orders, {"Id": "Customer"}, "left_semi").to_list()] == ["Alice", "Bob"]
    assert [r.Name for r in q.join(orders, {"Id": "Customer"}, "left_anti").to_list()] == ["Charlie", "Nobody"]
    assert q.join(orders, {"Id": "Customer"}, "left").count() == 5
    with pytest.raises(ValueError):
        q.join(orders, {"Id": "Customer"}, "cross")


def test_strict_and_fallback(people):
    q = people.query()
    with pytest.raises(UnsupportedOperation):
        q.where(lambda r: r.Age % 2 == 0)
    assert ids(q.allow_fallback().where(lambda r: r.Age % 2 == 0)) == [2, 4, 5]
    with pytest.raises(UnsupportedOperation):
        q.allow_fallback().strict_mode().where(lambda r: True)
    with pytest.raises(TypeError):
        bool(c.Age > 3)
    assert ids(q.as_sequential().where(c.Age > 30)) == ids(q.with_parallel(3).where(c.Age > 30))


def test_explanations(people):
    q = people.query().where(c.Age > 30, c.Category == "A").group_by("Category").agg(n=count(), total=sum_("Age")).take(3)
    text = q.explain_text()
    for part in ("Optimized: True", "Columns: Age, Category", "Predicates: 2 column-level", "GroupBy: Category", "Count(), Sum(Age)", "Take: 3", "Est. Selectivity: 6%"):
        assert part in text
    assert "Optimized: False" in people.query().allow_fallback().where(lambda r: True).explain_text()
    assert "Warning" in people.query().where((c.Age > 1) | (c.Age < 0)).explain_text()
    assert "HashAggregate" in q.explain_plan()


def test_plan_cache(spark):
    s = Snapshot.from_rows(spark, ROWS, PEOPLE)
    for age, found in ((25, 4), (30, 2), (25, 4)):
        assert s.query().where(c.Age > age).count() == found
    first = s.plan_cache_statistics()
    assert first.hits > 0 and first.misses > 0 and s.cached_plans == first.entries
    s.plans.most = 8
    for i in range(30):
        assert s.query().where(c.Id == i).count() == (1 <= i <= 5)
    assert s.cached_plans <= 9
    counts = [s.query().allow_fallback().where(f).count() for f in (lambda r: r.Age > 28, lambda r: r.Age > 30)]
    assert counts == [3, 2]
    for _ in range(6):
        s.query().count()
    assert s.tracker.mean(s.query().steps.key()) > 0 and isinstance(s.tracker.recommendations(), list)
    s.clear_plan_cache()
    assert s.cached_plans == 0


def test_frozen_and_closed(spark):
    rows = [list(r) for r in ROWS]
    with Snapshot.from_rows(spark, rows, PEOPLE, persist=True) as s:
        rows[0][1] = "changed"
        rows.clear()
        assert len(s) == 5 and s.query().first().Name == "Alice" and [r.Id for r in s] == [r.Id for r in s]
    s.close()
    with pytest.raises(ClosedSnapshotError):
        s.query()


def test_random_queries_agree_with_python(spark):
    rng = random.Random(11)
    rows = [(i, rng.randrange(-1000, 1000), rng.uniform(-100, 100), rng.random() < 0.5) for i in range(400)]
    q = Snapshot.from_rows(spark, rows, [("Id", t.Int32), ("Value", t.Int32), ("Score", t.Double), ("IsActive", t.Bool)], persist=True).query()
    for _ in range(12):
        a, b, flag = rng.randrange(-1000, 1000), rng.uniform(-100, 100), rng.random() < 0.5
        want = [r for r in rows if r[1] > a and (r[2] <= b or r[3] == flag)]
        p, o = c.Value > a, (c.Score <= b) | (c.IsActive == flag)
        assert ids(q.where(p, o)) == ids(q.where(o).where(p)) == [r[0] for r in want]
        assert q.any(p & o) == bool(want) and q.sum("Value") == sum(r[1] for r in rows)
        assert q.count(~(p & o)) == len(rows) - len(want)


def test_edges(spark):
    empty = Snapshot.from_rows(spark, [], PEOPLE)
    q = empty.query()
    assert q.count() == 0 and not q.any() and q.to_list() == [] and q.distinct().to_list() == [] and q.group_by("Name").agg(n=count()).to_list() == []
    assert empty.statistics()["Id"].total == 0
    rows = [(-(2**31), float("-inf")), (2**31 - 1, float("inf")), (0, 5e-324)]
    q = Snapshot.from_rows(spark, rows, [("Id", t.Int32), ("Score", t.Double)]).query()
    assert (q.min("Id"), q.max("Id"), q.min("Score"), q.max("Score")) == (-(2**31), 2**31 - 1, float("-inf"), float("inf"))
    assert ids(q.where(c.Score > 0)) == [2**31 - 1, 0]


def test_times(spark):
    @dataclasses.dataclass
    class Person:
        Id: t.Int32
        Born: t.Timestamp

    s = Snapshot.from_rows(spark, [Person(1, dt.datetime(1990, 5, 15, 1, 2, 3, 456789)), Person(2, dt.datetime(2005, 8, 22))], Person)
    assert s.query().first().Born == dt.datetime(1990, 5, 15, 1, 2, 3, 456000)
    assert ids(s.query().where(c.Born > dt.datetime(2000, 1, 1))) == [2]
    assert s.query().max("Born") == dt.datetime(2005, 8, 22)


def test_columns_whose_names_look_hidden(spark):
    df = spark.createDataFrame([(3, "a", 1, 2, 3, 4), (1, "b", 5, 6, 7, 8)], "_rid int, _ride string, _r_x int, _k_x int, _part int, x int")
    snap = Snapshot.from_df(df)
    assert snap.columns == df.columns
    assert [tuple(r) for r in snap.query().to_list()] == [(3, "a", 1, 2, 3, 4), (1, "b", 5, 6, 7, 8)]
    both = snap.query().join(snap, "x").to_list()
    assert len(both) == 2 and "_r_x_right" in both[0].asDict()
    assert {r["column"]: r.runs for r in snap.runs_df().collect()}["_part"] == 2
    with pytest.raises(SchemaError):
        Snapshot.from_df(df.withColumn("__snapquery_ordinal", F.lit(1)))


def test_columns_compared_with_nulls_and_nans(spark):
    nan = float("nan")
    rows = [(1, nan, nan, "a", None), (2, nan, 1.0, "a", "a"), (3, 1.0, nan, None, None), (4, 1.0, 1.0, None, "a"), (5, None, nan, "b", "a"), (6, 2.0, 1.0, "b", "b"), (7, nan, None, None, "b")]
    q = Snapshot.from_df(spark.createDataFrame(rows, "k int, a double, b double, s string, t string"), ["k"]).query()
    ids = lambda p: [r.k for r in q.where(p).to_list()]
    for b in (c.b, F.col("b")):
        assert ids(c.a == b) == [4] and ids(c.a > b) == [6] and ids(c.a >= b) == [4, 6] and ids(c.a < b) == [] and ids(c.a <= b) == [4]
        assert ids(c.a != b) == [1, 2, 3, 6] and ids(~(c.a == b)) == [1, 2, 3, 5, 6, 7]
    assert ids(c.k < F.col("a")) == [] and ids(c.k != c.a) == [1, 2, 3, 4, 6, 7]
    for t in (c.t, F.col("t")):
        assert ids(c.s == t) == [2, 6] and ids(c.s != t) == [1, 4, 5, 7]
    assert ids(c.a.isin(1.0, nan)) == [3, 4] and ids(c.a.isin(nan)) == []
    assert q.where(c.a == c.b).explain_text().count("Columns: a, b") == 1


def test_strict_mode_sees_python_functions_in_columns(spark, people):
    f = F.udf(lambda x: x > 30, "boolean")
    for p in (f("Age"), (c.Age > 1) & predicate(f("Age")), ~predicate(f("Age")), c.Id == F.udf(lambda x: x, "int")("Age")):
        with pytest.raises(UnsupportedOperation):
            people.query().where(p)
    with pytest.raises(UnsupportedOperation):
        people.query().select(old=f("Age"))
    assert people.query().allow_fallback().where(f("Age")).count() == people.query().where(c.Age > 30).count()


def test_types_that_are_carried(spark, tmp_path):
    import datetime as dt

    df = spark.createDataFrame([(1, dt.date(2020, 1, 2), [1.0], {"a": 1}), (2, None, None, None), (3, dt.date(2021, 5, 1), [], {})], "k int, d date, v array<double>, m map<string,int>")
    snap = Snapshot.from_df(df, ["k"])
    assert [r.k for r in snap.query().where(c.d > dt.date(2020, 6, 1)).to_list()] == [3]
    assert [r.k for r in snap.query().where(c.d <= dt.datetime(2020, 1, 2)).to_list()] == [1]
    assert snap.query().max("d") == dt.date(2021, 5, 1) and snap.query().to_list()[0].v == [1.0]
    assert {r["column"] for r in snap.profile_df().collect()} == {"k", "d", "v"}
    snap.write_ipc(str(tmp_path / "i"))
    assert sorted(r.k for r in Snapshot.from_ipc(spark, str(tmp_path / "i")).query().where(c.d.is_not_null()).to_list()) == [1, 3]


def test_order_of_the_scan_needs_no_sort(spark):
    snap = Snapshot.from_df(spark.range(0, 1000, 1, 4))
    plain = snap.query().where(c.id > 10)
    assert "Sort" not in plain.to_df()._jdf.queryExecution().toString() and [r.id for r in plain.to_list()] == list(range(11, 1000))
    assert "Sort" in Snapshot.from_df(spark.range(9), ["id"]).query().to_df()._jdf.queryExecution().toString()


def test_times_are_kept_of_so_many_queries():
    tracker = Tracker(most=3)
    for i in range(10):
        tracker.record(f"q{i % 5}", 1.0)
    assert list(tracker.times) == ["q2", "q3", "q4"]
