"""Approximate nearest neighbours by multi-index hashing.

Codes are learned: principal axes of a sample, turned by the rotation that loses the least when only
signs are kept (iterative quantization).  A code is split into substrings, the more rows the longer
(8 to 16 bits), and every substring is indexed.  By the pigeonhole principle a code within Hamming
radius r of the query's, with m substrings and r = m * a + b, is within a in one of the first b + 1
substrings or within a - 1 in one of the others, so probing those values retrieves every code within
r.  The retrieved rows are reranked by the inner product of the original vectors, in double precision.

The index is a table: each vector stands once for each substring, in the cell that the first bits of
the substring name.  Cells have about ``cell_rows`` rows; one with more is dealt by a salt.  A query
goes to the cells that its radius reaches, and there to every salt.  A task reads the rows of a cell
and then streams its queries past them, so that neither side has to fit into memory as a whole, and no
query passes the driver.  A pair that several substrings find counts in the first of them.

Each query has a radius of its own.  From the sample (``sample`` distinct vectors at most, chosen by a
hash of the id) the operator learns within which distance a share ``held`` of the pairs of at least a
given inner product stand, and estimates what the k-th best product of a query is.  The nearer a
query's neighbours, the smaller its radius and the fewer cells are read.  In tables of many rows the
first probe takes half that radius, and only queries whose k-th best product asks for more are probed
again.  Queries that find fewer rows than ``k``, or than there are, are probed again with a growing
radius, at last with all bits, which is a scan.

Copies never become pairs: equal vectors are indexed once, with their first ``k`` + 1 ids, and equal
queries are probed once.  Where neighbours are hardly nearer than other rows, as among random
directions, the radius must be wide and most cells are read; the work is then that of a scan for each
query.

Nulls and edges: rows with a null id, and vectors that are null, zero, of another length than the
most common one, or that hold a null or non-finite component take no part; ties go to the smaller id;
a row is no neighbour of a query with its own id; fewer candidates than ``k`` give fewer rows; an empty
table returns no rows.  Of rows that repeat a query's id the least vector is the query; a candidate
that repeats an id takes one rank, with its best score.  Very long vectors cost memory in proportion
to ``cell_rows`` times their length.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from snapquery.llm._shared import forget_kept, stored

TASKS = 10_000  # of one probe, at most; each then takes several cells
RESULT = "query_id long, rank int, vec_id long, score double"


class Codes:
    """Learned binary codes: signs after centering and an orthogonal turn, from the highest bit of 64 down."""

    def __init__(self, sample: np.ndarray, bits: int = 64, rounds: int = 30, seed: int = 7) -> None:
        bits = min(bits, 64, sample.shape[1])
        self.mean = sample.mean(axis=0)
        centred = sample - self.mean
        _, axes = np.linalg.eigh(centred.T @ centred)
        axes = axes[:, ::-1][:, :bits]
        low = centred @ axes
        turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(low @ turn > 0, 1.0, -1.0).T @ low)
            turn = (u @ w).T
        self.turn, self.bits = axes @ turn, bits

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        packed = np.zeros((len(vectors), 8), np.uint8)
        found = np.packbits((vectors - self.mean) @ self.turn > 0, axis=1)
        packed[:, : found.shape[1]] = found
        return packed.view(">u8").ravel().astype(np.uint64)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


@dataclass(frozen=True)
class Layout:
    """Substrings of a code of ``bits`` bits and the cells that the first bits of a substring name."""

    bits: int
    width: int
    named: int  # bits that name a cell

    @staticmethod
    def of(bits: int, rows: int, cell_rows: int) -> Layout:
        width = min(bits, max(8, min(16, round(log2(max(2, rows))))))
        return Layout(bits, width, max(0, min(width, ceil(log2(max(1, rows / cell_rows))))))

    @property
    def starts(self) -> list[int]:
        return list(range(0, self.bits, self.width))

    def _named(self, start: int) -> int:
        return min(self.named, self.bits - start)

    def mask(self, j: int) -> np.uint64:
        """The bits of substring ``j``."""
        start = self.starts[j]
        n = min(self.width, self.bits - start)
        return np.uint64(((1 << n) - 1) << (64 - start - n))

    def allowed(self, j: int, radius: np.ndarray) -> np.ndarray:
        """Differing bits in substring ``j`` up to which it is probed; -1: not at all."""
        a, b = np.divmod(np.asarray(radius), len(self.starts))
        return np.where(j <= b, a, a - 1)

    def cells(self, code: Column) -> Column:
        """The cell of each substring."""
        out = []
        for j, start in enumerate(self.starts):
            n = self._named(start)
            top = F.shiftrightunsigned(code, 64 - start - n).bitwiseAND(F.lit((1 << n) - 1)) if n else F.lit(0)
            out.append((F.lit(j << 16) + top).cast("int"))
        return F.array(*out)

    def reached(self, codes: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell): the cells that hold values within what is allowed in their substring."""
        queries, cells = [], []
        for j, start in enumerate(self.starts):
            n = self._named(start)
            apart = np.arange(1 << n)
            apart = apart[np.argsort(np.bitwise_count(apart), kind="stable")]
            upto = np.concatenate([[0], np.cumsum(np.bincount(np.bitwise_count(apart), minlength=n + 1))])
            sizes = upto[np.clip(self.allowed(j, radii), -1, n) + 1]
            of = np.repeat(np.arange(len(codes)), sizes)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            top = (codes >> np.uint64(64 - start - n)).astype(np.int64) & ((1 << n) - 1) if n else np.zeros(len(codes), np.int64)
            queries.append(of)
            cells.append((j << 16) + (top[of] ^ apart[nth]))
        return np.concatenate(queries), np.concatenate(cells)

    def found(self, j: int, apart: np.ndarray, radii: np.ndarray) -> np.ndarray:
        """Whether pairs that differ in the bits ``apart`` are within the radius (one for each row) and found by substring ``j`` first."""
        out = np.bitwise_count(apart) <= radii[:, None]
        out &= np.bitwise_count(apart & self.mask(j)) <= self.allowed(j, radii)[:, None]
        for before in range(j):
            out &= np.bitwise_count(apart & self.mask(before)) > self.allowed(before, radii)[:, None]
        return out


class Radii:
    """The radius that holds a share ``held`` of the pairs of at least a given inner product (over the query's length)."""

    def __init__(self, sample: np.ndarray, codes: Codes, held: float, queries: int = 256) -> None:
        self.bits = codes.bits
        own = codes(sample)
        step = max(1, len(sample) // queries)
        of = np.arange(0, len(sample), step)
        product = (sample[of] @ sample.T) / np.linalg.norm(sample[of], axis=1)[:, None]
        apart = distance(own[of][:, None], own[None, :])
        other = np.arange(len(sample))[None, :] != of[:, None]
        product, apart = product[other], apart[other]
        order = np.argsort(-product, kind="stable")
        product, apart = product[order], apart[order]
        self.least, self.radius, n = [], [], 200
        while n < 2 * len(product):  # the n pairs of the greatest products, for growing n
            n = min(n, len(product))
            self.least.append(-product[n - 1])
            self.radius.append(ceil(np.quantile(apart[:n], held)))
            if n == len(product):
                break
            n = int(n * 1.2)
        self.radius = np.maximum.accumulate(np.array([*self.radius, self.bits], np.int64))

    def __call__(self, product: np.ndarray) -> np.ndarray:
        return self.radius[np.searchsorted(np.array(self.least), -product)]


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the rows that take part; components as they are, or in double precision."""
    v, kind = F.col("vector"), rows.schema[vector_col].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("vector"))
    some = some.where(F.col("id").isNotNull() & v.isNotNull()).where(F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0))
    sizes = some.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return some.where(F.size("vector") == (sizes[0].n if sizes else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _distinct(valid: DataFrame, k: int) -> DataFrame:
    """(vector, ids): each vector once, with its ``k`` + 1 smallest ids."""
    first = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    few = valid.groupBy("id", "vector").agg(F.lit(1)).select("vector", "id").withColumn("nth", first).where(F.col("nth") <= k + 1)
    return few.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))


class Cell:
    """The rows of a cell, past which queries are streamed."""

    def __init__(self, layout: Layout, cell: int, codes: np.ndarray, vectors: np.ndarray, ids: pa.Array, k: int) -> None:
        self.layout, self.position, self.k = layout, cell >> 16, k
        self.codes, self.vectors = codes, vectors
        self.ids, self.first = np.asarray(ids.flatten()), np.concatenate([[0], np.cumsum(np.asarray(pa.compute.list_value_length(ids)))])

    def best(self, codes: np.ndarray, vectors: np.ndarray, radii: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the ``k`` + 1 ids of the greatest products, and these."""
        found = self.layout.found(self.position, codes[:, None] ^ self.codes[None, :], radii)
        many = found.mean() > 1 / 16
        rough = vectors @ self.vectors.T if many else None  # chooses; what is returned is computed anew
        for i in range(len(codes)):
            rows = np.flatnonzero(found[i])
            yield self._best(rows, rough[i, rows] if many else self.vectors[rows] @ vectors[i], vectors[i])

    def _best(self, rows: np.ndarray, rough: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        most = self.k + 1
        while True:
            if len(rows) > most:
                least = np.partition(rough, len(rows) - most)[len(rows) - most]
                some = rows[rough >= least - 1e-9 * (1 + abs(least))]
            else:
                some = rows
            score = (self.vectors[some] * query).sum(axis=1)
            sizes = self.first[some + 1] - self.first[some]
            at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.first[some], sizes)
            ids, score = self.ids[at], np.repeat(score, sizes)
            order = np.lexsort((ids, -score))
            ids, score = ids[order], score[order]
            _, once = np.unique(ids, return_index=True)  # the first is the greatest
            if len(once) > self.k or len(some) == len(rows):
                keep = np.sort(once)[: self.k + 1]
                return ids[keep], score[keep]
            most *= 4


def _probe(index: DataFrame, salts: DataFrame, queries: DataFrame, layout: Layout, groups: int, k: int) -> DataFrame:
    """(query, id, score): of each cell and query of ``queries`` (query, vector, code, radius) the best ids."""
    kind = queries.schema["vector"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                of, cells = layout.reached(np.asarray(part.column("code")).view(np.uint64), np.asarray(part.column("radius")))
                for lo in range(0, len(of), 8192):
                    own = pa.array(of[lo : lo + 8192])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cells[lo : lo + 8192].astype(np.int32)), *[part.column(c).take(own) for c in ("query", "code", "radius", "vector")]],
                        names=["cell", "query", "code", "radius", "vector"],
                    )

    dealt = queries.select("query", "code", "radius", "vector").mapInArrow(deal, f"cell int, query long, code long, radius int, vector {kind}")
    asked = dealt.join(salts, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "query", "code", "radius", "vector")
    held = index.join(salts, "cell").select(
        "cell", F.pmod(F.xxhash64("code", F.get("ids", 0)), F.col("salts")).cast("int").alias("salt"), F.lit(None).cast("long").alias("query"), "code",
        F.lit(-1).alias("radius"), "vector", "ids",
    )
    both = held.union(asked.withColumn("ids", F.lit(None).cast("array<long>")))
    both = both.repartition(min(TASKS, 2 * groups), "cell", "salt").sortWithinPartitions("cell", "salt", "radius")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        name, parts, cell = None, [], None
        for b in batches:
            names, radii = np.stack([np.asarray(b.column("cell")), np.asarray(b.column("salt"))]), np.asarray(b.column("radius"))
            changes = np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0) | ((radii[1:] < 0) != (radii[:-1] < 0))) + 1
            for lo, hi in zip([0, *changes.tolist()], [*changes.tolist(), b.num_rows], strict=True):
                part, own = b.slice(lo, hi - lo), (int(names[0, lo]), int(names[1, lo]))
                if own != name:
                    name, parts, cell = own, [], None
                if radii[lo] < 0:
                    parts.append(part)
                    continue
                if not parts:
                    continue
                if cell is None:
                    table = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                    cell = Cell(layout, own[0], np.asarray(table.column("code")).view(np.uint64), _matrix(table.column("vector")), table.column("ids"), k)
                    parts = parts[:1]
                for at in range(0, part.num_rows, 32):
                    few = part.slice(at, 32)
                    best = list(cell.best(np.asarray(few.column("code")).view(np.uint64), _matrix(few.column("vector")), np.asarray(few.column("radius"))))
                    query = np.repeat(np.asarray(few.column("query")), [len(i) for i, _ in best])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(query), pa.array(np.concatenate([i for i, _ in best])), pa.array(np.concatenate([s for _, s in best]))], names=["query", "id", "score"]
                    )

    found = both.mapInArrow(run, "query long, id long, score double").groupBy("query", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k + 1).drop("rank")


def _coded(df: DataFrame, codes: Codes) -> DataFrame:
    """``df`` (vector and other columns) with ``code``."""
    shared = df.sparkSession.sparkContext.broadcast(codes)  # a matrix of a vector's length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        for b in batches:
            code = pa.array(shared.value(_matrix(b.column("vector"))).view(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns, code], names=[*b.schema.names, "code"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("code", T.LongType())]))


def _first_radii(queries: DataFrame, sample: np.ndarray, radii: Radii, rows: int, k: int) -> DataFrame:
    """``queries`` with ``safe``, the radius that the estimate of their k-th best product asks for, and ``radius``, that of the first probe."""
    shared = queries.sparkSession.sparkContext.broadcast((sample, radii))  # at most `sample` vectors
    rank = 1 + round(k * len(sample) / rows)  # one more than expected, as a lower product asks for a wider radius
    part_of = rows > 2 * k * len(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, radius = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                vectors = _matrix(part.column("vector"))
                product = vectors @ known.T
                for i, v in enumerate(vectors):
                    product[i, (known == v).all(axis=1)] = -np.inf
                best = -np.partition(-product, min(rank, len(known)) - 1, axis=1)[:, min(rank, len(known)) - 1] / np.linalg.norm(vectors, axis=1)
                safe = radius(best).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(safe), pa.array(safe // 2 if part_of else safe)], names=[*part.schema.names, "safe", "radius"])

    return queries.mapInArrow(run, T.StructType([*queries.schema.fields, T.StructField("safe", T.IntegerType()), T.StructField("radius", T.IntegerType())]))


def _again(queries: DataFrame, best: DataFrame, radii: Radii, wanted: int) -> DataFrame:
    """Those of ``queries`` that must be probed again, with their next radius."""
    shared = queries.sparkSession.sparkContext.broadcast(radii)
    state = best.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    columns = queries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        radius = shared.value
        for b in batches:
            now, safe, n = (np.asarray(b.column(c)) for c in ("radius", "safe", "n"))
            length = np.linalg.norm(_matrix(b.column("vector")), axis=1)
            short = n < wanted
            asks = radius(np.asarray(b.column("least")) / length) > now
            again = (now < radius.bits) & (short | (now < safe) & asks)
            to = np.minimum(np.where(now < safe, safe, 2 * now + 4), radius.bits).astype(np.int32)
            out = [pa.array(to) if c == "radius" else b.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(out, names=columns).filter(pa.array(again))

    joined = queries.join(state, "query", "left").select(*columns, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("least", F.lit(0.0)).alias("least"))
    return joined.mapInArrow(run, queries.schema)


def neighbours(rows: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = 4096, held: float = 0.98, bits: int = 64, cell_rows: int = 16_384) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by ``every``."""
    spark = rows.sparkSession
    valid = usable(rows, id_col, vector_col)
    vectors = stored(_distinct(valid, k), "ann-vectors")
    some = vectors.orderBy(F.xxhash64(F.get("ids", 0)), "vector").limit(sample).select("vector").toArrow()  # the sample
    if not some.num_rows:
        return spark.createDataFrame([], RESULT)
    learned = _matrix(some.column("vector").combine_chunks())
    codes = Codes(learned, bits)
    radii = Radii(learned, codes, held)
    index = stored(_coded(vectors, codes), "ann-codes")
    n = index.count()
    wanted = vectors.select(F.explode("ids").alias("id")).distinct().limit(k + 1).count()
    layout = Layout.of(codes.bits, n, cell_rows)
    index = index.withColumn("cell", F.explode(layout.cells(F.col("code"))))
    salts = stored(index.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (2 * cell_rows)).cast("int").alias("salts")), "ann-cells")
    groups = salts.agg(F.sum("salts")).first()[0]

    asked = stored(valid.where(F.col("id") % every == 0).groupBy("id").agg(F.min("vector").alias("vector")), "ann-asked")
    once = stored(asked.groupBy("vector").agg(F.min("id").alias("query")), "ann-once")  # a query's id has one vector
    asked = asked.join(once, "vector").select("id", "query")
    queries = stored(_first_radii(_coded(once.select("query", "vector"), codes), learned, radii, n, k), "ann-queries")
    parts = []
    while not queries.isEmpty():
        parts.append(stored(_probe(index, salts, queries, layout, groups, k), "ann-best"))
        queries = stored(_again(queries, parts[-1], radii, wanted), "ann-again")
    if not parts:
        return spark.createDataFrame([], RESULT)
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    found = found.groupBy("query", "id").agg(F.max("score").alias("score"))
    best = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("back"), "id", "score"))).alias("best"))  # k + 1 of each probe
    own = F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k)
    ranked = asked.withColumnRenamed("id", "query_id").join(best, "query").select("query_id", F.posexplode(own).alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
