import hashlib
import random
import re

import pytest

from snapquery.llm.decontam import contamination, keep_clean
from tests.llm.helpers import documents, empty, odd, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, window=8):
    windows = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            if item is not None:
                windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes = {len(k) for k in windows}
    out = []
    for i, text in docs:
        w, hit, found = WORD.findall((text or "").translate(LOWER)), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit |= set(range(p, p + n))
                    found |= windows[tuple(w[p : p + n])]
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.id, r.n_words, sum(s["last"] - s["first"] for s in r.spans), r["items"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(1)
    items = [(i, words(rng, rng.choice([3, 5, 6, 7, 8, 9, 20, 40]), 60)) for i in range(25)]
    items += [(25, ""), (26, None), (27, "Only!"), (None, words(rng, 12)), (3, words(rng, 9)), (28, items[0][1].upper()), (29, "rep " * 12), (30, "É é x1 y2 z3 q4 r5 s6 t7")]
    docs = odd() + [(100 + i, words(rng, 60, 60) + " ! " + (items[i % 25][1] if i % 2 else words(rng, 6, 60)) + ", " + words(rng, 20, 60)) for i in range(60)]
    docs += [(200, "rep " * 30), (201, "É é X1 y2 z3 q4 r5 s6 t7"), (202, items[5][1] + "\n" + items[6][1])]
    return docs, items


def test_against_brute_force(spark, case):
    docs, items = case
    frame = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert any(len(r[3]) >= 2 for r in want) and sum(bool(r[3]) for r in want) > 20
    assert got(contamination(documents(spark, docs), frame)) == want
    assert got(contamination(documents(spark, docs), frame, block_words=150)) == want  # by a shuffle


def test_a_filter_that_lets_everything_through_changes_nothing(spark, case, monkeypatch):
    from snapquery.llm import decontam

    docs, items = case
    monkeypatch.setattr(decontam, "FILTER", 1 << 10)
    frame = spark.createDataFrame(items, "item_id long, text string")
    assert got(contamination(documents(spark, docs), frame, block_words=0)) == brute(docs, items)


def test_a_window_of_many_items(spark):
    items = [(i, f"one and the same question for all {'x' * (i % 3)}") for i in range(3000)]
    docs = [(1, "one and the same question for all"), (2, "say: one and the same question for all x"), (3, "one and the same")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    for block_words in (500_000, 0):
        assert got(contamination(documents(spark, docs), frame, block_words=block_words)) == brute(docs, items)


def test_empty_sides(spark, case):
    docs, items = case
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(not r["items"] and not r.spans for r in contamination(documents(spark, docs), none).collect())
    assert contamination(empty(spark), spark.createDataFrame(items, "item_id long, text string")).collect() == []
    assert contamination(empty(spark), spark.createDataFrame(items, "item_id long, text string"), block_words=0).collect() == []
    assert all(not r["items"] and not r.spans for r in contamination(documents(spark, docs), none, block_words=-1).collect())


def test_keep_clean(spark, case):
    docs, items = case
    frame = spark.createDataFrame(items, "item_id long, text string")
    kept = keep_clean(documents(spark, docs), frame)
    assert kept.columns == documents(spark, []).columns
    clean = [(i, n) for i, n, h, found in brute(docs, items) if not found]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, _ in clean), key=str)


def test_query_matches_sql(spark):
    from snapquery.llm import queries
    from tests.compare import DATA, assert_same, duck

    assert_same(queries.op1_decontamination(spark, DATA), duck().sql(queries.ORACLES["op1_decontamination"]))
    row = queries.op1_decontamination(spark, DATA).where("n_items = 0").first()
    assert row.items_sha256 == hashlib.sha256(b"").hexdigest()
