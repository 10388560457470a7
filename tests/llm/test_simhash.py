import random

import numpy as np
import pytest
import xxhash

from snapquery.llm._shared import components
from snapquery.llm.simhash import anchors_of, fingerprint, keep_one, links, near_duplicates
from tests.llm.helpers import documents, empty, odd, words


def brute_fingerprint(text):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(docs):
    fps = [brute_fingerprint(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(docs)), key=str), [find(i) for i in range(len(docs))]


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(4)
    base = [words(rng, 400, 5000).split() for _ in range(12)]
    out = odd()
    for i in range(150):
        w = base[i % 12].copy()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"Edit{rng.randrange(9)}"
        out.append((500 - i, " ".join(w)))
    return out


def test_against_brute_force(spark, docs):
    want, _ = brute_classes(docs)
    assert len({r[2] for r in want}) < len(docs) - 60
    rows = near_duplicates(documents(spark, docs)).collect()
    assert sorted(((r.id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in rows), key=str) == want


def test_one_of_each_class_stays(spark, docs):
    _, roots = brute_classes(docs)
    df = keep_one(documents(spark, docs))
    assert df.columns == documents(spark, []).columns
    kept = df.collect()
    want, least = [], {}
    for (d, t), r in zip(docs, roots, strict=True):
        least.setdefault(r, []).append(d)
    want = [min((d for d in ds if d is not None), default=None) for ds in least.values()]
    assert sorted((r.doc_id for r in kept), key=str) == sorted(want, key=str)


def test_every_close_pair_shares_an_anchor():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * 2 + rng.integers(0, 2, 3000, dtype=np.uint64)
    b = a.copy()
    for i in range(3000):
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    rows, anchors = anchors_of(a, True)
    homes = {(r, x) for r, x in zip(rows.tolist(), anchors.tolist(), strict=True)}
    rows, anchors = anchors_of(b, False)
    met = {r for r, x in zip(rows.tolist(), anchors.tolist(), strict=True) if (r, x) in homes}
    assert met == set(range(3000))


def classes(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def close(x, y):
    return ((x ^ y) & (1 << 64) - 1).bit_count() <= 3


@pytest.mark.parametrize("salted", [2000, 1])
def test_links_join_the_classes_of_all_pairs(spark, monkeypatch, salted):
    from snapquery.llm import simhash

    monkeypatch.setattr(simhash, "SALTED", salted)
    rng = np.random.default_rng(2)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    for f in list(fps):
        for _ in range(4):
            g = f
            for bit in rng.choice(63, rng.integers(1, 5), replace=False):
                g ^= 1 << int(bit)
            fps.append(g)
    fps = sorted(set(fps) | {0, -1, 1})
    found = [(r.a, r.b) for r in links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()]
    assert classes(fps, found) == classes(fps, [(x, y) for x in fps for y in fps if x < y and close(x, y)])
    with pytest.raises(ValueError):
        links(spark.createDataFrame([(1,)], "fp long"), 4)


def test_a_dense_group_has_few_links(spark):
    rng = np.random.default_rng(8)
    bits = rng.integers(0, 63, (40_000, 3))
    fps = sorted({int(x) for x in np.bitwise_or.reduce(np.left_shift(np.int64(1), bits), axis=1)} | {(1 << 40) - 1, (1 << 40) - 3})[:20_000]
    found = [(r.a, r.b) for r in links(spark.createDataFrame([(f,) for f in fps], "fp long").repartition(8)).collect()]
    assert len(found) < 20 * len(fps) and len(set(classes(fps, found).values())) <= 3


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 20)]
    random.Random(0).shuffle(edges)
    labels = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert labels == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(20)}


def test_fingerprint():
    for t in ("", "One", "one TWO", "One two three", "a b c d e", "É é Ü ü x"):
        assert fingerprint(t.encode()) == brute_fingerprint(t)


def test_empty(spark):
    assert near_duplicates(empty(spark)).collect() == [] and keep_one(empty(spark)).collect() == []
