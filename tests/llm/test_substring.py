import random

import pytest

from snapquery.llm._words import VISIBLE, find_words
from snapquery.llm.substring import Automaton, Shard, long_spans, remove_repeats
from tests.llm.helpers import documents, empty, odd, words


def brute(docs, window):
    first = {}
    cut = [(i, (t or "").encode().split()) for i, t in docs]
    for i, w in cut:
        if i is not None:
            for p in range(len(w) - window + 1):
                key = tuple(w[p : p + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in cut:
        gone = set()
        if i is not None:
            for p in range(len(w) - window + 1):
                if first[tuple(w[p : p + window])] < i:
                    gone |= set(range(p, p + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(2)
    passages = [words(rng, n, 40) for n in (49, 50, 51, 80, 200)]
    out = odd()
    for i in range(80):
        parts = [words(rng, rng.randrange(40), 30), rng.choice(passages), words(rng, rng.randrange(60), 30)]
        if i % 3 == 0:
            parts.append(rng.choice(passages))
        out.append((1000 - i, "  ".join(parts)))
    out += [(2000 + i, "same words again " * (20 + i)) for i in range(6)]
    near = words(rng, 300).split()
    for i in range(12):
        copy = near.copy()
        copy[rng.randrange(300)] = f"edit{i}"
        out.append((3000 + i, " ".join(copy)))
    return out


def test_against_brute_force(spark, docs):
    want = brute(docs, 50)
    assert sum(r[2] > 0 for r in want) > 30
    assert got(remove_repeats(documents(spark, docs), 50)) == want


def test_small_shards_and_hot_anchors_change_nothing(spark, docs):
    want = brute(docs, 50)
    assert got(remove_repeats(documents(spark, docs), 50, shard_words=500, task_words=5000)) == want
    assert got(remove_repeats(documents(spark, docs), 50, hot_words=100)) == want
    assert got(remove_repeats(documents(spark, docs), 10)) == brute(docs, 10)


def test_words_whose_hashes_collide_are_told_apart(spark):
    one, other = "a", "b"
    for _ in range(11):  # Thue-Morse words of 2048 letters, equal under any polynomial modulo a power of two
        one, other = one + other, other + one
    assert find_words([one.encode()], VISIBLE).hash[0] == find_words([other.encode()], VISIBLE).hash[0]
    same = [f"w{i}" for i in range(49)]
    docs = [(1, " ".join([*same, one])), (2, " ".join([*same, other])), (3, " ".join([*same, other, "end"])), (4, " ".join([one, *same])), (5, " ".join([other, *same, one]))]
    for sizes in ({}, {"hot_words": 1}):
        assert got(remove_repeats(documents(spark, docs), 50, **sizes)) == brute(docs, 50)


def test_a_shard_is_whole_anchors_up_to_a_number_of_words():
    sizes = []

    class Counted(Shard):
        def spans(self, window):
            sizes.append((self.size, set(self.anchors)))
            return super().spans(window)

    shard = Counted()
    for i, text in enumerate((b"a b c d", b"b c d e", b"a b c d e")):
        shard.put(7, bytes([i]), i == 1, i, text.split())
    found = shard.spans(3).to_pydict()
    assert list(zip(found["segment"], found["copy"], found["from"], found["to"], strict=True)) == [(b"\1", False, 0, 3), (b"\1", True, 0, 4), (b"\2", False, 0, 5)]
    assert sizes == [(13, {7})]


def test_empty(spark):
    assert remove_repeats(empty(spark)).collect() == []


def test_matching_statistics():
    rng = random.Random(3)
    for _ in range(60):
        texts = [[rng.randrange(3) for _ in range(rng.randrange(1, 25))] for _ in range(4)]
        a = Automaton()
        for t in texts[:3]:
            a.add(t)
        seen = {tuple(t[i:j]) for t in texts[:3] for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        want = [max([n for n in range(1, e + 1) if tuple(texts[3][e - n : e]) in seen], default=0) for e in range(1, len(texts[3]) + 1)]
        assert a.matches(texts[3]) == want
    assert long_spans([1, 2, 3, 3, 1, 2, 3, 0, 3], 3) == [(0, 7), (6, 9)] or long_spans([1, 2, 3, 3, 1, 2, 3, 0, 3], 3) == [(0, 9)]


def test_query_matches_sql(spark):
    from snapquery.llm import queries
    from tests.compare import DATA, assert_same, duck

    assert_same(queries.op5_substring(spark, DATA), duck().sql(queries.ORACLES["op5_substring"]))
