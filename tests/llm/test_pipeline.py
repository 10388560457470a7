"""The pipeline against plain Python."""

import random

import pytest

import corpus_pipeline
from snapquery.llm import langid
from tests.llm.helpers import words
from tests.llm.test_decontam import brute as brute_hits
from tests.llm.test_packing import brute_best_fit
from tests.llm.test_pii import brute as brute_pii
from tests.llm.test_simhash import brute_classes


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(9)
    vocabulary = {"aa": "kilo mela tora sunu", "bb": "xyr zqut vrox jyth"}
    text = lambda lang, n: " ".join(rng.choice(vocabulary[lang].split()) + rng.choice("abcd") + str(rng.randrange(30)) for _ in range(n))
    items = [(i, words(rng, 20, 90, "bench")) for i in range(5)]
    rows = []
    for i in range(90):
        lang = "ab"[i % 2] * 2
        t = text(lang, 150)
        if i % 9 == 0:
            t += " " + items[i % 5][1]
        if i % 7 == 0:
            t += f" mail me{i}@site.example.org or 10.0.0.{i}"
        rows.append((i, t, lang))
    rows += [(100 + i, rows[i][1], rows[i][2]) for i in range(1, 30, 3)]
    rows += [(200, None, "aa"), (201, "", "aa"), (202, "123 456", "bb"), (203, rows[4][1] + " end", "aa"), (203, rows[4][1] + " end", "aa"), (None, text("aa", 90), None), (204, text("bb", 5000), "bb")]
    path = tmp_path_factory.mktemp("sf")
    docs = [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), rows, items


def test_stages_and_result(spark, sf_dir):
    path, rows, items = sf_dir
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, path)
        if k < 4:
            assert docs.columns == columns
        seen.append(docs.collect())
    told = [(i, t) for i, t, _ in rows if t and any(ch.isalpha() for ch in t)]
    assert sorted((r.doc_id for r in seen[0]), key=str) == sorted((i for i, _ in told), key=str)
    classes, roots = brute_classes(told)
    kept = {}
    for (i, t), root in zip(told, roots, strict=True):
        if root not in kept or (i is not None and (kept[root][0] is None or i < kept[root][0])):
            kept[root] = (i, t)
    assert sorted(((r.doc_id, r.text) for r in seen[1]), key=str) == sorted(kept.values(), key=str)
    clean = {i for i, _, _, found in brute_hits(list(kept.values()), items) if not found}
    assert {r.doc_id for r in seen[2]} == clean and len(clean) < len(kept)
    for r in seen[3]:
        original = next(t for i, t in kept.values() if i == r.doc_id)
        assert (r.text != original) == bool(brute_pii(original)) and not brute_pii(r.text) and r.n_chars == len(r.text)
    final = corpus_pipeline.run(spark, path).collect()
    assert sorted((r.doc_id, r.piece, r.length) for r in final if r.doc_id is not None) == sorted((r.doc_id, r.piece, r.length) for r in seen[4] if r.doc_id is not None)
    assert len({r.sequence_id for r in final}) == brute_best_fit([r.length for r in final], 2048)


def test_an_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_registered():
    from snapquery.llm import queries

    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)] + ["pipeline"]
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and langid.UNKNOWN == "und"
