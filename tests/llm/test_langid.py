import math
import re
import zlib
from collections import Counter

import pytest

from snapquery.llm.langid import fit, keep_identified, predict
from tests.compare import DATA
from tests.llm.helpers import documents, empty, odd


def test_held_out_accuracy(spark):
    from snapquery.llm import queries

    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.op7_langid(spark, DATA).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held) > 30


def test_bounded_sample_learns_as_well(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    told = predict(docs, fit(docs, rows=12, vocabulary=800)).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert sum(r.lang_pred == truth[r.id] for r in told) >= 0.95 * len(told)


def test_edges(spark):
    lang = {4: "aa", 5: "bb", 6: "bb", 8: "cc", 12: None}
    docs = documents(spark, odd(), lang)
    model = fit(docs)
    assert set(model.languages) == {"aa", "bb", "cc"}
    rows = predict(documents(spark, odd() + [(20, "!!! 123 ½ ²"), (21, "Zzz")]), model).collect()
    for r in rows:
        if r.id in (1, 2, 3, 11, 20):
            assert (r.lang_pred, r.lang_score) == ("und", 0.0)
        elif r.id is not None:
            assert r.lang_pred in model.languages and 0 < r.lang_score <= 1
    kept = keep_identified(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(i for i, _ in odd() if i not in (None, 1, 2, 3, 11))
    nothing = fit(empty(spark))
    assert predict(empty(spark), model).collect() == []
    assert {(r.lang_pred, r.lang_score) for r in predict(docs, nothing).collect()} == {("und", 0.0)}
    assert keep_identified(docs, nothing).collect() == []


def test_words_come_before_grams_and_longer_grams_before_shorter(spark):
    docs = documents(spark, [(1, "abcd abcd"), (2, "wxyz wxyz")], {1: "a", 2: "b"})
    model = fit(docs).open()
    assert model.predict("abcd")[0] == "a" and model.predict("WXYZ")[0] == "b"
    assert model.predict("zabc")[0] == "a" and model.predict("dxyz")[0] == "b"


def brute_model(rows, longest=4):
    """(languages, score of a word in each), from (text, lang) in plain Python."""
    languages = sorted({lang for _, lang in rows})
    words, parts = {lang: Counter() for lang in languages}, {lang: Counter() for lang in languages}
    for text, lang in rows:
        words[lang].update(re.findall(r"[^\W\d_]+", text.lower()))
    for lang in languages:
        for w, n in words[lang].items():
            for k in range(1, longest + 1):
                for i in range(len(w) + 3 - k):
                    parts[lang][f" {w} "[i : i + k]] += n
    logs = []
    for table in (words, parts):
        entries = set().union(*table.values())
        totals = {lang: sum(table[lang].values()) + 0.5 * len(entries) for lang in languages}
        logs.append({e: [math.log((table[lang][e] + 0.5) / totals[lang]) for lang in languages] for e in entries})

    def score(w):
        if w in logs[0]:
            return logs[0][w]
        for k in range(min(longest, len(w) + 2), 0, -1):
            known = [logs[1][g] for i in range(len(w) + 3 - k) if (g := f" {w} "[i : i + k]) in logs[1]]
            if known:
                return [sum(x) / len(known) for x in zip(*known, strict=True)]
        return [0.0] * len(languages)

    return languages, score


def test_query_against_plain_python(spark):
    from snapquery.llm import queries

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").collect()
    learns = [(r.text, r.lang) for r in docs if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.text is not None and r.lang is not None]
    languages, score = brute_model(learns)
    every = predict(spark.read.parquet(f"{DATA}/documents.parquet"), fit(spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(learns)], "doc_id long, text string, lang string"), rows=10**9, vocabulary=None))
    exact = {r.id: (r.lang_pred, r.lang_score) for r in every.collect()}
    query = {r.doc_id: r.lang_pred for r in queries.op7_langid(spark, DATA).collect()}
    same = 0
    for r in docs:
        words = re.findall(r"[^\W\d_]+", r.text.lower())
        if not any(c.isalpha() for w in words for c in w):
            assert exact[r.doc_id] == ("und", 0.0) and query[r.doc_id] == "und"
            continue
        mean = [sum(x) / len(words) for x in zip(*map(score, words), strict=True)]
        share = [math.exp((m - max(mean)) * min(len(words), 8)) for m in mean]
        best = max(range(len(mean)), key=mean.__getitem__)
        if sorted(mean)[-1] - sorted(mean)[-2] > 1e-4:
            assert exact[r.doc_id][0] == languages[best]
        assert exact[r.doc_id][1] == pytest.approx(share[best] / sum(share), abs=1e-3)
        same += query[r.doc_id] == exact[r.doc_id][0]
    assert same >= 0.99 * len(docs) - 20
