import random

import pytest

from snapquery.llm.tokencount import SPACE, TrieCounter, token_counts, zipf_scores
from tests.llm.helpers import documents, empty, odd

P = pytest.importorskip("public_tokenizers")


def brute(word, scores, byte):
    best, longest = [(0.0, 0)], max(map(len, scores))
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        options = [(best[end - 1][0] + n * byte, -(best[end - 1][1] + n))]
        options += [(best[s][0] + scores[word[s:end]], -(best[s][1] + 1)) for s in range(max(0, end - longest), end) if word[s:end] in scores]
        score, count = max(options)
        best.append((score, -count))
    return best[-1][1]


def test_against_word_by_word_search():
    rng = random.Random(1)
    pieces = {SPACE: -3.0, **{"".join(rng.choice("abcé") for _ in range(rng.randint(1, 4))): -rng.uniform(1, 9) for _ in range(60)}}
    counter = TrieCounter(pieces)
    texts = [" ".join("".join(rng.choice("abcé😀") for _ in range(rng.randint(1, 12))) for _ in range(40)) for _ in range(30)]
    for t, (n, tokens) in zip(texts, counter(texts), strict=True):
        assert n == 40 and tokens == sum(brute(SPACE + w, pieces, counter.byte) for w in t.split())


def test_counts(spark):
    scores = zipf_scores(P.path("piece_bpe_32k.model"))
    counter = TrieCounter(scores)
    docs = odd()
    want = sorted(((i, len((t or "").split()), sum(brute(SPACE + w, scores, counter.byte) for w in (t or "").split())) for i, t in docs), key=str)
    rows = token_counts(documents(spark, docs), scores).collect()
    assert sorted((tuple(r) for r in rows), key=str) == want
    assert token_counts(empty(spark), scores).collect() == []
