"""Language identification: words first, then ever shorter character n-grams.

A model holds, for each of its words and n-grams, the log frequency in each language.  A word of a
document that the model knows is scored by these; an unseen word is scored by the mean of its known
n-grams of the greatest length that has any, from ``longest`` down to one.  The language with the
greatest sum over all words of the text wins; the score is its share when the mean log frequency
counts as often as there are words, up to ``WEIGHT``.

Fitting reads a sample bounded in rows for each language (``rows``, chosen by a hash of the id) and
keeps the most frequent entries of each language (``vocabulary``; None keeps all of the sample's, at
the price of a model that is as large as its words); the counts are taken in parallel.

Nulls and edges: a text that is null or has no letter is ``und`` with score 0, as is any text if
there was nothing to learn from; rows with a null language, text or id teach nothing; ties go to the
language first in order of code points; repeated rows each return a row; an empty table returns no
rows.  Other columns are passed through by ``keep_identified`` only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from snapquery.llm._shared import kept_by_worker, stored, tidied

LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
WEIGHT = 8
#: Unseen words whose scores a worker remembers at most; beyond that it starts afresh.
REMEMBERED = 60_000
#: Counts that a task gathers before it hands them on.
FLUSHED = 40_000

Table = tuple[dict[str, int], np.ndarray]


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Model:
    """Log frequencies by language of words and of n-grams (which hold spaces at a word's ends), as rows of one matrix each."""

    def __init__(self, languages: list[str], words: Table, parts: Table, longest: int) -> None:
        self.languages, self.longest = languages, longest
        self.words, self.parts = words, parts

    def open(self) -> Model:
        """With room for the rows of unseen words, on the worker that predicts."""
        self.at = dict(self.words[0])
        self.rows = np.concatenate([self.words[1], np.zeros((REMEMBERED, len(self.languages)), np.float32)])
        return self

    def _unseen(self, word: str) -> int:
        """The row of a word that the model doesn't know."""
        at, rows = self.parts
        for n in range(min(self.longest, len(word) + 2), 0, -1):
            found = [i for g in grams(word, n) if (i := at.get(g)) is not None]
            if found:
                self.rows[len(self.at)] = rows[found].mean(axis=0)
                break
        else:
            self.rows[len(self.at)] = 0
        self.at[word] = len(self.at)
        return self.at[word]

    def predict(self, text: str | None) -> tuple[str, float]:
        words = LETTERS.findall(text.lower()) if text else []
        if not self.languages or not any(c.isalpha() for w in words for c in w):
            return UNKNOWN, 0.0
        counts = Counter(words)
        total = np.zeros(len(self.languages))
        entries = list(counts.items())
        for k in range(0, len(entries), REMEMBERED):  # a text of more words than are remembered goes in parts
            part = entries[k : k + REMEMBERED]
            if len(self.at) + len(part) > len(self.rows):
                self.at = dict(self.words[0])
            get = self.at.get
            rows = [i if (i := get(w)) is not None else self._unseen(w) for w, _ in part]
            total += np.array([n for _, n in part], np.float64) @ self.rows[rows]
        mean = total / len(words)
        share = np.exp((mean - mean.max()) * min(len(words), WEIGHT))
        best = int(mean.argmax())
        return self.languages[best], float(share[best] / share.sum())


def _counted(rows: DataFrame) -> DataFrame:
    """(lang, word, n) of (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, str]] = Counter()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    counts.update((lang, w) for w in LETTERS.findall(text.lower()))
                if len(counts) > FLUSHED:
                    yield _table(counts)
                    counts.clear()
        yield _table(counts)

    return rows.mapInArrow(tidied(run), "lang string, entry string, n long").groupBy("lang", "entry").agg(F.sum("n").alias("n"))


def _table(counts: Counter[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(counts.values(), pa.int64())],
        names=["lang", "entry", "n"],
    )


def _gram_counts(words: DataFrame, longest: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                counts: Counter[tuple[str, str]] = Counter()
                for lang, word, n in zip(*(c.to_pylist() for c in b.slice(at, 1000).columns), strict=True):
                    for k in range(1, longest + 1):
                        for g in grams(word, k):
                            counts[lang, g] += n
                yield _table(counts)

    return words.mapInArrow(tidied(run), "lang string, entry string, n long").groupBy("lang", "entry").agg(F.sum("n").alias("n"))


def _vectors(counts: DataFrame, languages: list[str], vocabulary: int | None) -> Table:
    """Smoothed log frequencies of the entries that are among the most frequent of any language, or of all."""
    kept = counts
    if vocabulary is not None:
        ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "entry")))
        kept = counts.join(ranked.where(F.col("r") <= vocabulary).select("entry").distinct(), "entry")
    column = {lang: i for i, lang in enumerate(languages)}
    found = kept.toArrow()  # at most `vocabulary` entries of each language; without it, those of a bounded number of rows
    entries = found.column("entry").combine_chunks().dictionary_encode()
    table = np.zeros((len(entries.dictionary), len(languages)))
    table[np.asarray(entries.indices), [column[x] for x in found.column("lang").to_pylist()]] = np.asarray(found.column("n"))
    logs = np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * len(table)))
    return {k: i for i, k in enumerate(entries.dictionary.to_pylist())}, logs.astype(np.float32)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = 3000, vocabulary: int | None = 20_000, longest: int = 4) -> Model:
    """Learn from about ``rows`` rows of each language at most."""
    usable = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna()
    sizes = {r.lang: r["count"] for r in usable.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], ({}, np.zeros((0, 0), np.float32)), ({}, np.zeros((0, 0), np.float32)), longest)
    share = F.lit(1.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, rows / n))).otherwise(share)
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)
    words = stored(_counted(usable.where(draw < share).select("lang", "text")), "word-counts")
    return Model(languages, _vectors(words, languages, vocabulary), _vectors(_gram_counts(words, longest), languages, vocabulary), longest)


def _predicting(docs: DataFrame, model: Model, text: int, out: Callable[[pa.RecordBatch, list[tuple[str, float]]], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """Map ``out`` over slices of ``docs`` and the predictions of their texts (column number ``text``)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by `vocabulary` and the number of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = shared.value
        predict = kept_by_worker(("langid", id(loaded)), loaded.open).predict
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield out(part, [predict(t) for t in part.column(text).to_pylist()])

    return docs.mapInArrow(tidied(run), schema)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, lang_score) of each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def out(part: pa.RecordBatch, told: list[tuple[str, float]]) -> pa.RecordBatch:
        columns = [part.column(0), pa.array([t[0] for t in told], pa.string()), pa.array([t[1] for t in told], pa.float64())]
        return pa.RecordBatch.from_arrays(columns, names=["id", "lang_pred", "lang_score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return _predicting(rows, model, 1, out, f"id {kind}, lang_pred string, lang_score double")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows whose language can be told: not ``und``, and with a score of ``least`` or more."""

    def out(part: pa.RecordBatch, told: list[tuple[str, float]]) -> pa.RecordBatch:
        return part.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in told], pa.bool_()))

    return _predicting(docs, model, docs.columns.index(text_col), out, docs.schema)


def teaches(id_col: str = "doc_id") -> Column:
    """Whether a row is for learning: two thirds of the ids."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1
