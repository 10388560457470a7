import random

import numpy as np
import pytest

from snapquery.llm import similar, stages
from snapquery.llm.simhash import keep_one as keep_by_bits
from snapquery.llm.similar import fingerprint
from tests.llm.helpers import documents, empty, odd, words


def brute_set(text):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute_labels(docs):
    sets, parent = [brute_set(t) for _, t in docs], list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(docs))]


def brute_kept(docs):
    least = {}
    for (d, _), r in zip(docs, brute_labels(docs), strict=True):
        least.setdefault(r, []).append(d)
    return sorted((min((d for d in ds if d is not None), default=None) for ds in least.values()), key=str)


def edited(rng, text, lowest, highest):
    """A copy with words replaced until the similarity is within the bounds."""
    w, whole = text.split(), brute_set(text)
    while True:
        w[rng.randrange(len(w))] = f"Edit{rng.randrange(10**6)}"
        new = brute_set(" ".join(w))
        if (alike := len(new & whole) / len(new | whole)) < highest:
            return " ".join(w) if alike >= lowest else edited(rng, text, lowest, highest)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(11)
    out = odd()
    for i in range(40):
        base = words(rng, rng.randrange(100, 500), 5000)
        low = (0.80, 0.85, 0.89, 0.70)[i % 4]
        out += [(100 + 2 * i, base), (101 + 2 * i, edited(rng, base, low, low + 0.06))]
    line = words(rng, 30, 5000)
    out += [(300 + i, words(rng, rng.randrange(15, 130), 5000) + " " + line) for i in range(60)]  # a common passage
    chain = words(rng, 200, 5000)
    for i in range(20):  # near copies that one hub doesn't reach
        out.append((500 + i, chain))
        chain = edited(rng, chain, 0.80, 0.93)
    return out


@pytest.mark.parametrize("common", [2, 32])
def test_all_links_against_brute_force(spark, docs, monkeypatch, common):
    monkeypatch.setattr(similar, "COMMON", common)
    rows = similar.similar_classes(documents(spark, docs)).collect()
    found, want = {}, {}
    for r in rows:
        found.setdefault(r.label, []).append(str(r.id))
    for (d, _), root in zip(docs, brute_labels(docs), strict=True):
        want.setdefault(root, []).append(str(d))
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


def test_the_stage_drops_copies_at_0_8_to_0_95(spark, docs):
    df = documents(spark, docs)
    kept = stages.drop_near_duplicates(spark, df, "")
    assert kept.columns == df.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == brute_kept(docs)
    assert not {101 + 2 * i for i in range(40) if i % 4 < 3} & set(ids) and {101 + 2 * i for i in range(3, 40, 4)} <= set(ids)
    assert keep_by_bits(df).count() > len(ids) + 20  # three bits of 64 let most of them stay


def test_a_pair_is_met_about_once(spark, docs, monkeypatch):
    rng, tried, alike = random.Random(17), [], similar._alike
    base = words(rng, 400, 5000)
    family = [(1000 + i, edited(rng, base, 0.80, 0.84)) for i in range(24)]  # pairs of the family are at about 0.65

    def counted(pairs, *rest):
        tried.append((pairs.count(), pairs.distinct().count()))
        return alike(pairs, *rest)

    monkeypatch.setattr(similar, "_alike", counted)
    rows = similar.similar_classes(documents(spark, docs + family)).collect()
    assert len({r.label for r in rows}) == len(set(brute_labels(docs + family)))
    assert tried[-1][1] > 150 and sum(made for made, _ in tried[1:]) <= 1.5 * sum(distinct for _, distinct in tried[1:])


def test_prefix_of_any_order_is_met():
    assert [similar.prefix_size(n, 0.8) for n in (1, 4, 5, 10, 100)] == [1, 1, 2, 3, 21]


def test_bounds(spark):
    assert similar.keep_one(empty(spark)).collect() == []
    with pytest.raises(ValueError):
        similar.similar_classes(empty(spark), similarity=0)


def test_fingerprints_of_sets():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 9000):
        h = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64)
        want = sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > n)
        assert fingerprint(h) & (1 << 64) - 1 == want
