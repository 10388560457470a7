"""Token counts under a unigram model, by dynamic programming over a trie of distinct pre-tokens.

Each worker gathers the distinct pre-tokens (words by white space, with the mark that stands for the
space before them) of the texts at hand and walks their trie depth first.  The walk keeps the forward
scores of the current path on a stack: the state of a shared prefix is computed once for all words
below it, and the number of pieces on the best path is stored where a word ends.  A text's count is
the sum over its words.

The pieces come from a public vocabulary file.  That file's own model merges by rank, so a piece's log
probability is set by Zipf's law from its rank (``zipf_scores``); any other scores can be given.  A
character that no piece has is written as the pieces of its UTF-8 bytes.  Of equally good paths the
one with fewer pieces counts.

Nulls and edges: a null, empty or blank text has no tokens; a very long text is counted whole, and a
very long word costs its length times that of the longest piece; rows with a null id are carried along;
repeated rows each return a row; an empty table returns no rows.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapquery.llm._shared import kept_by_worker, text_slices, tidied

SPACE = "▁"
#: Words whose counts a worker remembers at most; beyond that it starts afresh.
REMEMBERED = 500_000


def zipf_scores(path: str) -> dict[str, float]:
    """Pieces of a ``sentencepiece`` file, of which the more frequent stand first, with log probabilities by rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1 / (r + 2.7) for r in range(len(ids))))
    return {model.id_to_piece(i): -math.log(r + 2.7) - total for r, i in enumerate(ids)}


class TrieCounter:
    """Number of pieces on the best path of each word."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.byte = min(scores.values(), default=0.0) - 10.0
        self.known: dict[str, int] = {}

    def learn(self, words: list[str]) -> None:
        """Walk the trie of ``words``, which in sorted order are its leaves and inner ends depth first."""
        get, longest, known, before = self.scores.get, self.longest, self.known, ""
        best, pieces = [0.0], [0]  # of the current path, by length of the prefix
        for word in sorted(words):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del best[shared + 1 :], pieces[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                n = len(word[end - 1].encode())
                score, count = best[end - 1] + n * self.byte, pieces[end - 1] + n
                for start in range(max(0, end - longest), end):
                    own = get(word[start:end])
                    if own is not None:
                        s = best[start] + own
                        if s > score or s == score and pieces[start] + 1 < count:
                            score, count = s, pieces[start] + 1
                best.append(score)
                pieces.append(count)
            known[word] = pieces[len(word)]
            before = word

    def __call__(self, texts: list[str]) -> list[tuple[int, int]]:
        """(words, tokens) of each text."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        cut = [[SPACE + w for w in t.split()] for t in texts]
        self.learn(list(set().union(*cut).difference(self.known)))
        get = self.known.__getitem__
        return [(len(w), sum(map(get, w))) for w in cut]


def token_counts(docs: DataFrame, scores: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_tokens) of each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(scores)  # a vocabulary, whatever the corpus
    name = hash(frozenset(scores.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept_by_worker(("tokencount", name), lambda: TrieCounter(shared.value))
        for b in batches:
            for lo, hi in text_slices(b, "text", 4 << 20):
                part = b.slice(lo, hi - lo)
                counts = np.array(counter([t or "" for t in part.column(1).to_pylist()]), np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts[:, 0]), pa.array(counts[:, 1])], names=["id", "n_words", "n_tokens"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidied(run), f"id {kind}, n_words long, n_tokens long")
