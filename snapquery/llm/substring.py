"""Removal of passages that repeat across documents, with suffix automata of reference shards.

A word goes if a window of ``window`` consecutive words that covers it also starts in a document with
a smaller id.  All documents are reference for each other, so automata of the whole text cannot go to
every task.  Reference text is cut down first: each window has an anchor, the smallest hash among its
``GRAM``-word grams, and equal windows have equal anchors.  A segment is a maximal run of windows with
one anchor; only segments whose anchor occurs under two ids can hold a window that repeats.  Anchors
are a prefilter and prove nothing.

Segments of the same words are told by a 128-bit cryptographic digest of these words and are streamed
once, under their smallest id.  A shard is a run of whole anchors, bounded in words, with one suffix
automaton.  The segments of a shard are streamed through it in the order of their ids, each before it
is added, so that its matching statistics tell what it shares with smaller ids; the maximal matches of
at least ``window`` words are the spans to remove.  A segment that larger ids hold too is streamed once
more after it was added, which gives the spans of those copies.

Reference text of one anchor that is over ``hot_words`` words (a passage in very many documents, each
with its own surroundings, or one very long text that repeats itself) fits no bounded automaton; its
windows are compared by the digests of their words instead, in many tasks.  The result is the same.

Nulls and edges: a null text has no words; a row with a null id loses nothing and is no reference;
rows that share an id are no reference for each other; repeated rows each return a row; texts of fewer
words than a window stay whole; a very long text is cut into segments like any other, and what repeats
within one anchor beyond ``hot_words`` goes the other way; an empty table returns no rows.  Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapquery.llm._shared import forget_kept, stored, text_bytes, text_slices, tidied
from snapquery.llm._words import VISIBLE, find_words, rolling

GRAM = 12


def digest(words: bytes) -> bytes:
    """128 bits that stand for a sequence of words."""
    return blake2b(words, digest_size=16).digest()


class Automaton:
    """Suffix automaton of the sequences added so far."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _clone(self, p: int, c: int, q: int) -> int:
        """A state for the suffixes of q that end at p's transition."""
        new = len(self.next)
        self.next.append(self.next[q].copy())
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def add(self, sequence: list[int]) -> None:
        nexts, link, length, last = self.next, self.link, self.length, 0
        for c in sequence:
            q = nexts[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._clone(last, c, q)
                continue
            new, p = len(nexts), last
            nexts.append({})
            link.append(0)
            length.append(length[last] + 1)
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = new
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
            last = new

    def matches(self, sequence: list[int]) -> list[int]:
        """Matching statistics: the length of the longest match that ends at each place."""
        nexts, link, length, out, state, n = self.next, self.link, self.length, [], 0, 0
        for c in sequence:
            while state and c not in nexts[state]:
                state = link[state]
                n = length[state]
            if c in nexts[state]:
                state = nexts[state][c]
                n += 1
            out.append(n)
        return out


def long_spans(matches: list[int], least: int) -> list[tuple[int, int]]:
    """Union of the matches of at least ``least`` words, as (first, last exclusive)."""
    spans: list[list[int]] = []
    for at, n in enumerate(matches):
        if n >= least:
            first = at + 1 - n
            while spans and first <= spans[-1][1]:
                first = min(first, spans.pop()[0])
            spans.append([first, at + 1])
    return [(a, b) for a, b in spans]


def anchored_segments(docs: DataFrame, kind: str, window: int, gram: int) -> DataFrame:
    """(anchor, segment, id, text_hash, first, n) of each segment of ``docs`` (id, text_hash, text); ``segment`` is the digest of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        for b in batches:
            for lo, hi in text_slices(b, "text", 1 << 20):
                part = b.slice(lo, hi - lo)
                words = find_words([b" ".join(t.split()) for t in text_bytes(part.column("text"))], VISIBLE)
                n = len(words.hash) - window + 1
                if n <= 0:
                    continue
                grams = rolling(words.hash, gram)
                least, width = grams, 1  # of `width` grams from each place, doubled up to those of a window
                while width * 2 <= window - gram + 1:
                    least = np.minimum(least[: len(least) - width], least[width:])
                    width *= 2
                rest = window - gram + 1 - width
                least = np.minimum(least[:n], least[rest : rest + n])
                inside = words.text[:n] == words.text[window - 1 :]
                fresh = np.concatenate([[True], (least[1:] != least[:-1]) | (words.text[1:n] != words.text[: n - 1]) | ~inside[:-1]]) & inside
                first = np.flatnonzero(fresh)
                ends = np.flatnonzero(np.concatenate([fresh[1:] | ~inside[1:], [True]]) & inside)
                size, data = ends - first + window, words.data
                content = [digest(data[s:e]) for s, e in zip(words.start[first].tolist(), words.end[ends + window - 1].tolist(), strict=True)]
                text = words.text[first]
                at = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(least[first].view(np.int64)),
                        pa.array(content, pa.binary()),
                        part.column("id").take(at),
                        part.column("text_hash").take(at),
                        pa.array((first - words.first[text]).astype(np.int32)),
                        pa.array(size.astype(np.int32)),
                    ],
                    names=["anchor", "segment", "id", "text_hash", "first", "n"],
                )

    return docs.where(F.col("id").isNotNull() & F.col("text").isNotNull()).mapInArrow(
        tidied(run), f"anchor long, segment binary, id {kind}, text_hash long, first int, n int"
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each wanted segment of a text, a bounded number of bytes at a time."""
    for b in batches:
        for text, wanted, owner in zip(text_bytes(b.column("text")), b.column("wanted").to_pylist(), b.column("id"), strict=True):
            own, rows, held = text.split(), [], 0
            for w in wanted:
                rows.append((w, b" ".join(own[w["first"] : w["first"] + w["n"]])))
                held += len(rows[-1][1])
                if held > 1 << 20:
                    yield _cut_rows(rows, owner)
                    rows, held = [], 0
            if rows:
                yield _cut_rows(rows, owner)


def _cut_rows(rows: list[tuple[dict, bytes]], owner: pa.Scalar) -> pa.RecordBatch:
    columns = [pa.array([w[c] for w, _ in rows], t) for c, t in (("anchor", pa.int64()), ("segment", pa.binary()), ("copied", pa.bool_()), ("large", pa.bool_()))]
    words = pa.array([t for _, t in rows], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([*columns, pa.array([owner] * len(rows), owner.type), words], names=["anchor", "segment", "copied", "large", "id", "words"])


class Shard:
    """Rows of whole anchors, by anchor and then by id, up to a number of words."""

    def __init__(self) -> None:
        self.anchors: list[int] = []
        self.segments: list[bytes] = []
        self.copied: list[bool] = []
        self.ids: list[object] = []
        self.words: list[list[bytes]] = []
        self.size = 0

    def put(self, anchor: int, segment: bytes, copied: bool, owner: object, words: list[bytes]) -> None:
        self.anchors.append(anchor)
        self.segments.append(segment)
        self.copied.append(copied)
        self.ids.append(owner)
        self.words.append(words)
        self.size += len(words)

    def spans(self, window: int) -> pa.RecordBatch:
        """(anchor, segment, copy, from, to): the spans of a segment under its smallest id, and (``copy``) under the others."""
        numbers: dict[bytes, int] = {}
        coded = [[numbers.setdefault(w, len(numbers)) for w in p] for p in self.words]
        order = sorted(range(len(coded)), key=self.ids.__getitem__)
        automaton, rows, at = Automaton(), [], 0
        while at < len(order):
            to = at + 1
            while to < len(order) and self.ids[order[to]] == self.ids[order[at]]:
                to += 1
            same = order[at:to]
            for i in same:
                rows += [(i, False, first, last) for first, last in long_spans(automaton.matches(coded[i]), window)]
            for i in same:
                automaton.add(coded[i])
            for i in same:
                if self.copied[i]:
                    rows += [(i, True, first, last) for first, last in long_spans(automaton.matches(coded[i]), window)]
            at = to
        return pa.RecordBatch.from_arrays(
            [
                pa.array([self.anchors[r[0]] for r in rows], pa.int64()), pa.array([self.segments[r[0]] for r in rows], pa.binary()),
                pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int32()),
            ],
            names=["anchor", "segment", "copy", "from", "to"],
        )


MATCHED = "anchor long, segment binary, copy boolean, from int, to int"


def _streamed(texts: DataFrame, window: int, shard_words: int, tasks: int) -> DataFrame:
    """Spans of the segments in ``texts``; a task holds one shard at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        shard, before = Shard(), None
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("anchor", "segment", "copied", "id")]
            for anchor, segment, copied, owner, words in zip(*columns, text_bytes(b.column("words")), strict=True):
                if before == (anchor, segment):  # from a repeated row
                    continue
                before = anchor, segment
                if shard.size >= shard_words and anchor != shard.anchors[-1]:
                    yield shard.spans(window)
                    shard = Shard()
                shard.put(anchor, segment, copied, owner, words.split(b" "))
        if shard.size:
            yield shard.spans(window)

    return texts.repartition(tasks, "anchor").sortWithinPartitions("anchor", "segment").mapInArrow(tidied(run), MATCHED)


def _windows(texts: DataFrame, kind: str, window: int) -> DataFrame:
    """(anchor, segment, id, digest, from) of each window of the segments in ``texts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        for b in batches:
            for i, raw in enumerate(text_bytes(b.column("words"))):
                words = find_words([raw], VISIBLE)
                for lo in range(0, len(words.start) - window + 1, 4096):
                    starts = words.start[lo : min(lo + 4096, len(words.start) - window + 1)].tolist()
                    ends = words.end[lo + window - 1 : lo + window - 1 + len(starts)].tolist()
                    of = pa.array(np.full(len(starts), i))
                    yield pa.RecordBatch.from_arrays(
                        [
                            *[b.column(c).take(of) for c in ("anchor", "segment", "id")],
                            pa.array([digest(raw[s:e]) for s, e in zip(starts, ends, strict=True)], pa.binary()),
                            pa.array(np.arange(lo, lo + len(starts), dtype=np.int32)),
                        ],
                        names=["anchor", "segment", "id", "digest", "from"],
                    )

    return texts.mapInArrow(tidied(run), f"anchor long, segment binary, id {kind}, digest binary, from int")


def removable(docs: DataFrame, window: int = 50, gram: int = GRAM, shard_words: int = 60_000, hot_words: int = 200_000, task_words: int = 600_000) -> DataFrame:
    """(id, text_hash, spans): what goes from the rows of ``docs`` (id, text_hash, text) that lose any word."""
    kind = docs.schema["id"].dataType.simpleString()
    gram = min(gram, window)
    every = stored(anchored_segments(docs, kind, window, gram), "segments")
    shared = every.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b")
    segments = stored(every.join(shared.select("anchor"), "anchor"), "shared-segments")
    holders = segments.groupBy("anchor", "segment").agg(
        F.min(F.struct("id", "text_hash", "first", "n")).alias("holder"), F.max("id").alias("last")
    )
    holders = stored(holders.select("anchor", "segment", "holder", (F.col("last") > F.col("holder.id")).alias("copied")), "holders")
    sizes = stored(holders.groupBy("anchor").agg(F.sum("holder.n").alias("words")), "anchor-words")
    total = sizes.where(F.col("words") <= hot_words).agg(F.coalesce(F.sum("words"), F.lit(0)).cast("long")).first()[0]
    large = sizes.where(F.col("words") > hot_words).select("anchor", F.lit(True).alias("large"))
    sized = holders.join(large, "anchor", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    item = F.struct("anchor", "segment", F.col("holder.first").alias("first"), F.col("holder.n").alias("n"), "copied", "large")
    wanted = sized.groupBy(F.col("holder.id").alias("id"), F.col("holder.text_hash").alias("text_hash")).agg(F.collect_list(item).alias("wanted"))
    texts = docs.join(wanted, ["id", "text_hash"]).select("id", "text", "wanted")
    texts = stored(texts.mapInArrow(tidied(_cut), f"anchor long, segment binary, copied boolean, large boolean, id {kind}, words string"), "reference")
    matched = _streamed(texts.where("not large"), window, shard_words, max(1, -(-total // task_words)))
    exploded = stored(_windows(texts.where("large"), kind, window), "hot-windows")
    earliest = exploded.groupBy("anchor", "digest").agg(F.min("id").alias("least"), F.max("id").alias("last")).where("least < last")
    earliest = stored(earliest.drop("last"), "earliest-windows")  # so that the join below is of two shuffles and splits where a window is hot
    compared = exploded.join(earliest, ["anchor", "digest"]).where("least < id").select(
        "anchor", "segment", F.lit(False).alias("copy"), "from", (F.col("from") + window).cast("int").alias("to")
    )
    whole = sized.where("large and copied").select("anchor", "segment", F.lit(True).alias("copy"), F.lit(0).alias("from"), F.col("holder.n").alias("to"))
    inner = matched.union(compared).union(whole).groupBy("anchor", "segment", "copy").agg(F.collect_set(F.struct("from", "to")).alias("parts"))
    least = holders.select("anchor", "segment", F.col("holder.id").alias("least"))
    both = stored(inner.join(least, ["anchor", "segment"]).groupBy("anchor", "segment", "least").agg(
        F.first(F.when(~F.col("copy"), F.col("parts")), True).alias("own"), F.first(F.when(F.col("copy"), F.col("parts")), True).alias("copies")
    ), "repeats")
    moved = F.transform("parts", lambda p: F.struct((p["from"] + F.col("first")).alias("from"), (p["to"] + F.col("first")).alias("to")))
    return (
        segments.join(both, ["anchor", "segment"])
        .withColumn("parts", F.when(F.col("id") > F.col("least"), F.col("copies")).otherwise(F.col("own")))
        .where(F.col("parts").isNotNull())
        .select("id", "text_hash", moved.alias("spans"))
        .groupBy("id", "text_hash")
        .agg(F.flatten(F.collect_set("spans")).alias("spans"))
    )


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi in text_slices(b, "text", 4 << 20):
            part = b.slice(lo, hi - lo)
            total, gone, kept = [], [], []
            for text, spans in zip(text_bytes(part.column("text")), part.column("spans").to_pylist(), strict=True):
                words = text.split()
                total.append(len(words))
                if spans:
                    keep = np.ones(len(words), bool)
                    for s in spans:
                        keep[s["from"] : s["to"]] = False
                    words = [words[i] for i in np.flatnonzero(keep).tolist()]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["id", "n_words", "n_removed", "kept"],
            )


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """(id, n_words, n_removed, kept) of each row; ``kept`` is what stays, words joined by one space."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    gone = removable(rows, window, **sizes)
    return rows.join(gone, ["id", "text_hash"], "left").select("id", "text", "spans").mapInArrow(tidied(_keep), f"id {kind}, n_words long, n_removed long, kept string")
