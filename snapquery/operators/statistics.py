"""Column statistics: values, nulls, distinct values, runs, and what they advise."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapquery.operators.rows import HIDDEN, RID, known, quoted

#: Thresholds of the encoding advice, and the least number of rows for any.
DICTIONARY_BELOW, RUNS_BELOW, LEAST_ROWS = 0.5, 0.1, 100
PART = HIDDEN + "part"


@dataclass(frozen=True)
class ColumnStatistics:
    name: str
    size: int  # bytes of a value
    total: int
    nulls: int
    distinct: int  # null counts as a value
    runs: int

    def _share(self, n: int) -> float:
        return n / self.total if self.total else 0.0

    @property
    def cardinality_ratio(self) -> float:
        return self._share(self.distinct)

    @property
    def run_ratio(self) -> float:
        return self._share(self.runs)

    @property
    def null_ratio(self) -> float:
        return self._share(self.nulls)

    def suits_dictionary(self, below: float = DICTIONARY_BELOW) -> bool:
        return self.cardinality_ratio < below and self.total >= LEAST_ROWS

    def suits_runs(self, below: float = RUNS_BELOW) -> bool:
        return self.run_ratio < below and self.total >= LEAST_ROWS

    @property
    def advice(self) -> str:
        return "run_length" if self.suits_runs() else "dictionary" if self.suits_dictionary() else "plain"

    def savings(self) -> int:
        """Bytes that the advised encoding saves, which may be negative."""
        plain = self.total * self.size
        if self.advice == "run_length":
            return plain - self.runs * (self.size + 4)
        if self.advice == "dictionary":
            index = 1 if self.distinct <= 255 else 2 if self.distinct <= 65535 else 4
            return plain - self.distinct * self.size - self.total * index
        return 0


@dataclass(frozen=True)
class BuildStatistics:
    columns: tuple[ColumnStatistics, ...]

    @property
    def rows(self) -> int:
        return max((c.total for c in self.columns), default=0)

    def __getitem__(self, name: str) -> ColumnStatistics:
        return next(c for c in self.columns if c.name == name)

    def dictionary_candidates(self) -> list[str]:
        return [c.name for c in self.columns if c.suits_dictionary()]

    def run_candidates(self) -> list[str]:
        return [c.name for c in self.columns if c.suits_runs()]

    def estimated_savings(self) -> int:
        return max(0, sum(c.savings() for c in self.columns))

    def summary(self) -> str:
        lines = [f"{self.rows} rows, {len(self.columns)} columns"]
        for c in sorted(self.columns, key=lambda c: c.name):
            lines.append(f"  {c.name}: {c.distinct} distinct ({c.cardinality_ratio:.1%}), {c.runs} runs ({c.run_ratio:.1%}), {c.nulls} nulls ({c.null_ratio:.1%}), {c.advice}")
        return "\n".join(lines)


def comparable(df: DataFrame) -> list[str]:
    """Columns whose values can be told apart: all but maps, which Spark does not compare."""
    return [n for n, kind in known(df).items() if "map<" not in kind.simpleString() and "variant" not in kind.simpleString()]


def profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """(column, total, nulls, distinct) of each column, from one aggregation; ``approximate`` counts distinct values by sketch."""
    names = comparable(df)
    counter = F.approx_count_distinct if approximate else F.count_distinct
    cells = [f(quoted(n)).alias(f"{p}{i}") for i, n in enumerate(names) for p, f in (("n", lambda c: F.count_if(c.isNull())), ("d", counter))]
    one = df.agg(F.count(F.lit(1)).alias("total"), *cells)
    rows = [
        F.struct(F.lit(n).alias("column"), F.col("total"), F.col(f"n{i}").alias("nulls"), (F.col(f"d{i}") + (F.col(f"n{i}") > 0).cast("long")).alias("distinct"))
        for i, n in enumerate(names)
    ]
    return one.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def runs(df: DataFrame) -> DataFrame:
    """(column, runs) of each column in the order of the ordinal; consecutive nulls are one run.

    Ranges of the ordinal are counted apart; only their first and last rows (one row for each range)
    meet in one place.
    """
    names = comparable(df)
    ranged = df.repartitionByRange(RID).withColumn(PART, F.spark_partition_id())
    within = Window.partitionBy(PART).orderBy(RID)
    fresh = [(~quoted(n).eqNullSafe(F.lag(quoted(n)).over(within)) & F.lag(F.lit(1)).over(within).isNotNull()).cast("long").alias(f"{HIDDEN}fresh_{i}") for i, n in enumerate(names)]
    row = F.struct(*[quoted(n).alias(f"c{i}") for i, n in enumerate(names)])
    parts = ranged.select("*", *fresh).groupBy(PART).agg(
        *[F.sum(f"{HIDDEN}fresh_{i}").alias(f"f{i}") for i in range(len(names))], F.min_by(row, RID).alias("first"), F.max_by(row, RID).alias("last"), F.min(RID).alias("at")
    )
    across = Window.orderBy("at")  # one row for each range
    seams = [
        (F.col(f"f{i}") + (F.lag("at").over(across).isNull() | ~F.col(f"first.c{i}").eqNullSafe(F.lag(F.col(f"last.c{i}")).over(across))).cast("long")).alias(f"r{i}")
        for i in range(len(names))
    ]
    sums = parts.select(*seams).agg(*[F.coalesce(F.sum(f"r{i}"), F.lit(0)).alias(f"r{i}") for i in range(len(names))])
    cells = [F.struct(F.lit(n).alias("column"), F.col(f"r{i}").alias("runs")) for i, n in enumerate(names)]
    return sums.select(F.explode(F.array(*cells)).alias("s")).select("s.*")


def zones(df: DataFrame, column: str, rows: int = 16_384) -> DataFrame:
    """(chunk, least, greatest, values) of each ``rows`` ordinals, for an integer ordinal; shows how well a sort order lets scans skip."""
    chunk = F.floor(F.col(RID) / rows).alias("chunk")
    c = quoted(column)
    return df.groupBy(chunk).agg(F.min(c).alias("least"), F.max(c).alias("greatest"), F.count(c).alias("values"))
