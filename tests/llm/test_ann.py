import numpy as np
import pytest

from snapquery.llm.ann import Cell, Codes, Layout, distance, neighbours
from tests.compare import DATA


def brute(rows, k, every):
    valid = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in valid:
        if q % every == 0:
            scored = sorted((-float((w * v).sum()), i) for i, w in valid if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 16))
    out = [(i, (centres[i % 8] + rng.normal(scale=0.3, size=16)).tolist()) for i in range(400)]
    out += [(500 + i, out[0][1]) for i in range(60)]  # copies, and so ties
    out += [(600, None), (620, [0.0] * 16), (640, [float("nan")] * 16), (660, [None] + [1.0] * 15), (680, [float("inf")] + [1.0] * 15), (700, [1.0] * 3), (None, [1.0] * 16)]
    return out


def test_recall_scores_and_ties(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumnRenamed("x", "y")
    found, want, hit = {}, brute(rows, 20, 20), 0
    for r in neighbours(df.repartition(3), 20, 20).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == set(want)
    for q, best in want.items():
        mine = sorted(found[q])
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1))
        assert [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
        scores = dict(brute(rows, 1000, 20)[q])
        assert all(abs(scores[m[1]] - m[2]) < 1e-12 for m in mine)
        hit += len({m[1] for m in mine} & {b[0] for b in best})
    assert hit >= 0.9 * sum(map(len, want.values()))
    copies = [m[1] for m in sorted(found[0]) if 500 <= m[1] < 560]
    assert len(copies) > 2 and copies == list(range(500, 500 + len(copies)))  # of equal vectors, the smaller ids


def test_blocks_of_queries_and_few_candidates(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, neighbours(df, 5, 20, cell_rows=16).collect())) == sorted(map(tuple, neighbours(df, 5, 20).collect()))
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, neighbours(few, 20, 20).select("query_id", "rank", "vec_id").collect())) == [(0, 1, 3), (0, 2, 20), (20, 1, 3), (20, 2, 0)]


def test_nothing(spark):
    schema = "vec_id long, embedding array<float>"
    assert neighbours(spark.createDataFrame([], schema)).collect() == []
    assert neighbours(spark.createDataFrame([(1, [1.0])], schema)).collect() == []
    assert neighbours(spark.createDataFrame([(20, None)], schema)).collect() == []
    assert neighbours(spark.createDataFrame([(20, [1.0, 2.0])], schema)).collect() == []


def test_probing_finds_every_code_within_the_radius_once():
    rng = np.random.default_rng(4)
    for bits, rows, cell_rows in ((5, 500, 100), (16, 500, 16), (40, 5000, 300), (64, 500, 500), (64, 70_000, 5000)):
        layout = Layout.of(bits, rows, cell_rows)
        packed = np.zeros((300, 8), np.uint8)
        packed[:, : (bits + 7) // 8] = np.packbits(rng.random((300, bits)) > 0.5, axis=1)
        codes = packed.view(">u8").ravel().astype(np.uint64)
        cells = [[int(j << 16) + (int(c) >> (64 - s - n) & ((1 << n) - 1)) for j, s in enumerate(layout.starts) for n in [min(layout.named, bits - s)]] for c in codes]
        for radius in (0, 1, 7, 8, 13, 22, 30, bits):
            queries, reached = layout.reached(codes[:10], np.full(10, radius))
            found = [[] for _ in range(10)]
            for q, cell in zip(queries.tolist(), reached.tolist(), strict=True):
                own = [i for i, c in enumerate(cells) if c[cell >> 16] == cell]
                if own:
                    hit = layout.found(cell >> 16, codes[q] ^ codes[own][None, :], np.array([radius]))[0]
                    found[q] += np.array(own)[hit].tolist()
            for q in range(10):
                assert sorted(found[q]) == np.flatnonzero(distance(codes, codes[q]) <= radius).tolist()


def test_a_cell_returns_the_best_ids_once():
    import pyarrow as pa

    vectors = np.array([[3.0, 0], [2, 0], [2.5, 0], [1, 0]])
    cell = Cell(Layout(2, 2, 0), 0, np.zeros(4, np.uint64), vectors, pa.array([[7], [1, 4, 9], [7, 8], [2]]), 3)
    ids, score = next(cell.best(np.zeros(1, np.uint64), np.array([[1.0, 1]]), np.array([2])))
    assert ids.tolist() == [7, 8, 1, 4] and score.tolist() == [3, 2.5, 2, 2]


def test_codes_keep_neighbours_close():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16))
    codes = Codes(x, 16)
    near = distance(codes(x), codes(x + rng.normal(scale=0.05, size=x.shape))).mean()
    assert near < 2 < distance(codes(x), codes(x[::-1])).mean()


def test_recall_on_the_table(spark):
    from snapquery.llm import queries

    table = spark.read.parquet(f"{DATA}/embeddings.parquet").toArrow()
    x, ids = np.array(table["embedding"].to_pylist(), np.float64), table["vec_id"].to_numpy()
    rows = queries.op4_ann(spark, DATA).collect()
    q = np.flatnonzero(ids % 20 == 0)
    score = x[q] @ x.T
    score[np.arange(len(q)), q] = -np.inf
    best = {(int(ids[i]), int(ids[j])) for i, s in zip(q, score, strict=True) for j in np.argsort(-s)[:20]}
    assert len(rows) == 20 * len(q) and len(best & {(r.query_id, r.vec_id) for r in rows}) >= 0.9 * len(best)


def test_scattered_queries_and_few_rows_get_all_they_can(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(5, 16))
    rows = [(i, (rng.normal(size=16) * 3 if i % 100 == 0 else centres[i % 5] + rng.normal(scale=1e-3, size=16)).tolist()) for i in range(1500)]
    found = {}
    for r in neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20, 20).collect():
        found.setdefault(r.query_id, []).append(r["rank"])
    assert set(found) == set(range(0, 1500, 20)) and all(sorted(x) == list(range(1, 21)) for x in found.values())
    for n in (15, 21):
        few = [(20 * i, rng.normal(size=16).tolist()) for i in range(n)]
        best = neighbours(spark.createDataFrame(few, "vec_id long, embedding array<double>"), 20, 20).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id) for r in best) == sorted((q, k + 1, i) for q, of in brute(few, 20, 20).items() for k, (i, _) in enumerate(of))


def test_repeated_rows_take_one_rank(spark, rows):
    valid = rows[:120]
    more = valid + valid[:41] * 2 + [(7, valid[0][1])] * 70 + [(20, [9.0] * 16)]
    df = spark.createDataFrame(more, "vec_id long, embedding array<double>").repartition(3)
    found, want = {}, {}
    for r in neighbours(df, 20, 20, held=1.0, bits=4).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    vectors = {}
    for i, v in more:
        vectors.setdefault(i, []).append(v)
    for q in range(0, 120, 20):
        scores = {i: max(float(np.dot(min(vectors[q]), v)) for v in vs) for i, vs in vectors.items() if i != q}
        want[q] = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:20]
    assert set(found) == set(want)
    for q, best in found.items():
        best.sort()
        assert [b[0] for b in best] == list(range(1, 21)) and len({b[1] for b in best}) == 20
        assert len({b[1] for b in best} & {i for i, _ in want[q]}) >= 18
