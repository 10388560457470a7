import datetime as dt
from dataclasses import dataclass

import pytest

from snapquery import Snapshot
from snapquery import types as t
from snapquery.errors import ColumnNotFound

ROWS = [(1, "Alice", 25, 85.5, "A"), (2, "Bob", 30, 92.0, "B"), (3, "Charlie", 35, 78.3, "A"), (4, "David", 28, 88.7, "B"), (5, "Eve", 32, 95.2, "C")]


@pytest.fixture(scope="module")
def people(spark):
    return Snapshot.from_rows(spark, ROWS, [("Id", t.Int32), ("Name", t.String), ("Age", t.Int32), ("Score", t.Double), ("Category", t.String)])


@pytest.fixture(scope="module")
def gaps(spark):
    rows = [(1, "Alice", "alice@test.com", 95.5, True), (2, "Bob", None, 87.0, True), (3, "Charlie", "charlie@test.com", None, False), (4, None, None, None, None), (5, "Eve", "eve@test.com", 92.0, None)]
    return Snapshot.from_rows(spark, rows, [("Id", t.Int32), ("Name", t.String | None), ("Email", t.String | None), ("Score", t.Double | None), ("IsActive", t.Bool | None)])


@pytest.mark.parametrize(
    ("text", "ids"),
    [
        ("SELECT * FROM t WHERE Age > 30", [3, 5]),
        ("select Id from anything where Age > 26 and Category = 'B'", [2, 4]),
        ("SELECT Id FROM t WHERE Name LIKE 'A%' OR Name LIKE '%e'", [1, 3, 5]),
        ("SELECT Id FROM t WHERE NOT (Age > 30) AND Category <> \"B\"", [1]),
        ("SELECT Id FROM t\nWHERE Age > 26\n  AND Score < 90", [3, 4]),
        ("SELECT Id FROM t WHERE Age BETWEEN 28 AND 30 OR Name IN ('Eve');", [2, 4, 5]),
        ("SELECT Id FROM t ORDER BY Score DESC LIMIT 2", [5, 2]),
        ("SELECT Id FROM t ORDER BY Id OFFSET 1 LIMIT 2", [2, 3]),
        ("SELECT Id FROM t ORDER BY Id LIMIT 2 OFFSET 1", [2, 3]),
        ("SELECT Id FROM t WHERE Name = 'from x; limit'", []),
    ],
)
def test_select(people, text, ids):
    assert [r[0] for r in people.sql(text).collect()] == ids


def test_aggregates_and_names(people):
    assert people.sql_scalar("SELECT SUM(Age) FROM t") == 150
    assert people.sql_scalar("SELECT COUNT(*) FROM t WHERE Age > 99") == 0
    df = people.sql("SELECT Category, COUNT(*), AVG(Score) AS mean FROM t GROUP BY Category HAVING COUNT(*) > 1 ORDER BY Category")
    assert df.columns == ["Category", "COUNT_*", "mean"] and [tuple(r)[:2] for r in df.collect()] == [("A", 2), ("B", 2)]
    assert len(people.sql("SELECT DISTINCT Category FROM t").collect()) == 3
    assert tuple(people.sql("SELECT MIN(Age), MAX(Age) FROM t").first()) == (25, 35)


def test_nulls(gaps):
    found = lambda text: [r[0] for r in gaps.sql(text).collect()]
    assert found("SELECT Id FROM t WHERE Email IS NULL") == [2, 4]
    assert found("SELECT Id FROM t WHERE Email IS NOT NULL AND (Score > 90 OR Name LIKE 'E%')") == [1, 5]
    assert found("SELECT Id FROM t WHERE Name <> 'Alice'") == [2, 3, 5]
    assert found("SELECT Id FROM t WHERE IsActive = true") == [1, 2]
    assert len(gaps.sql("SELECT IsActive, COUNT(*) AS n FROM t GROUP BY IsActive").collect()) == 3
    assert len(gaps.sql("SELECT IsActive, COUNT(*) AS n FROM t GROUP BY IsActive", parity=True).collect()) == 2
    assert gaps.sql_scalar("SELECT SUM(Score) FROM t WHERE Id > 9") is None
    assert gaps.sql("SELECT SUM(Score) FROM t WHERE Id > 9", parity=True).first()[0] == 0


def test_errors(people):
    for text in ("", "   ", "DELETE FROM t", "SELECT 1", "SELECT Id FROM t; SELECT Id FROM t", "SELECT FROM WHERE", "SELECT Id FROM t WHERE Nope = 1", "SELECT Nope FROM t"):
        with pytest.raises(ValueError):
            people.sql(text)
    for text in ("SELECT name FROM t", "SELECT Id FROM t WHERE age > 3", "SELECT Missing FROM t"):
        with pytest.raises(ColumnNotFound):
            people.sql(text)


def test_typed_rows_and_dates(spark, people):
    @dataclass
    class Pair:
        Id: int
        Name: str

    assert people.sql_rows("SELECT Id, Name FROM t WHERE Id = 1", Pair) == [Pair(1, "Alice")]
    s = Snapshot.from_rows(spark, [(1, dt.datetime(1990, 5, 15)), (2, dt.datetime(2005, 8, 22))], [("Id", t.Int32), ("Born", t.Timestamp)])
    assert [r[0] for r in s.sql("SELECT Id FROM t WHERE Born >= '2000-01-01'").collect()] == [2]
    assert [r[0] for r in s.sql("SELECT Id FROM t WHERE Born = '1990-05-15 00:00:00'").collect()] == [1]


def test_from_inside_a_function_and_typed_literals(spark):
    import datetime as dt

    df = spark.createDataFrame([(1, dt.date(2020, 5, 1)), (2, dt.date(2021, 6, 1))], "id int, date date")
    snap = Snapshot.from_df(df, ["id"])
    assert snap.sql_scalar("SELECT EXTRACT(YEAR FROM date) AS y FROM anything WHERE date > DATE '2020-12-31'") == 2021
    assert [r.id for r in snap.sql("SELECT id FROM t WHERE EXTRACT(MONTH FROM date) = 5").collect()] == [1]
    assert snap.sql_scalar("SELECT COUNT(*) FROM t WHERE date < TIMESTAMP '2021-01-01 00:00:00'") == 1
    with pytest.raises(ColumnNotFound):
        snap.sql("SELECT DATE FROM t")
