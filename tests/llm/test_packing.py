import random
import zlib

import numpy as np
import pytest

from snapquery.llm.packing import WordEncoder, pack, plan
from tests.llm.helpers import documents, empty, odd, words

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_encoder_is_the_tokenizer():
    e, rng = WordEncoder(PATH), random.Random(1)
    texts = ["", "Héllo İSTANBUL ½ ² 12ab's 'S\x1c\x85x\x00y <|endoftext|>", "ΣΑΣ σίσυφος", "don't WE'LL I'VE ''s 'dad", "中文 text 🙂", "é x", "a" * 3000]
    texts += ["".join(chr(rng.choice([rng.randrange(0x250), rng.randrange(128), 32, 39, 115])) for _ in range(40)) for _ in range(2000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in e(texts)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing(spark):
    rng = random.Random(2)
    docs = odd() + [(100 + i, words(rng, rng.randrange(900))) for i in range(120)]
    rows = pack(documents(spark, docs), PATH, with_ids=True).collect()
    tokenizer, whole = WordEncoder(PATH).tokenizer, {}
    for i, t in docs:
        ids = ids_of(tokenizer, t)
        for k in range(0, len(ids), 2048):
            whole.setdefault((i, k // 2048), []).append(ids[k : k + 2048])
    assert len(rows) == sum(map(len, whole.values()))
    places = {}
    for r in rows:
        assert r.ids in whole[r.id, r.piece] and r.length == len(r.ids) and r.start == 2048 * r.piece
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(places) <= -(-total // 2048) + 2
    assert pack(empty(spark), PATH).collect() == []


def brute_best_fit(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        fitting = [s for s in free if s >= n]
        if fitting:
            free.remove(min(fitting))
            free.append(min(fitting) - n)
        else:
            free.append(capacity - n)
    return len(free)


def test_plan_is_best_fit_by_counts():
    rng = random.Random(3)
    for _ in range(80):
        capacity = rng.choice([10, 50, 200])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randrange(1, 400))]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        slots, used, ranks = plan(histogram, capacity), {}, {}
        for length, first, last, sequence, offset in slots:
            for k in range(last - first + 1):
                used.setdefault(sequence + k, []).append((offset, length))
            ranks.setdefault(length, []).extend(range(first, last + 1))
        assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in histogram.items()}
        for p in used.values():
            ends = 0
            for offset, length in sorted(p):
                assert offset == ends
                ends += length
            assert ends <= capacity
        assert len(used) == brute_best_fit(lengths, capacity)
    assert len(plan({n: 10**9 for n in range(1, 2049)})) < 20_000
