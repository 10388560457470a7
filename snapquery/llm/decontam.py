"""Benchmark decontamination by winnowing.

A window is ``window`` consecutive words of an item (8; all words of a shorter item that has any).
Winnowing keeps, of each window of a text, the smallest hash among its k-word grams, the rightmost of
equal ones; equal windows keep equal grams, so each shared span of a window's length is found by the
join of the kept hashes.  A joined hit is extended to its window, which is compared word for word, and
overlapping windows grow into spans.  Items shorter than a window are windows of their own length and
keep their only gram.

A benchmark of at most ``block_words`` words (its size is checked) is joined inside the scan of the
documents, so texts are never shuffled.  Of a larger one only a filter of the kept hashes goes into
the scan, in ``FILTER`` bits whatever the benchmark; windows that pass it leave the scan as a
cryptographic digest of their words and meet those of the items in a shuffle.  Either way documents
are read once, no text is copied, and neither side is cut or sampled.

Nulls and edges: a null or blank text has no words, hits and items; an item without words has no
window; items with a null id cannot be named and are left out; items that share an id count once;
repeated document rows each return a row; a very long document or item is taken whole (a long item
makes the benchmark a large one); with no items or no documents the result has no items or no rows.
Other columns of the inputs are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapquery.llm._shared import forget_kept, stored, text_bytes, text_slices, tidied, whole_rows
from snapquery.llm._words import ALNUM, LOWER, Words, find_words, rolling

GRAM = 5
FILTER = 1 << 27  # bits; 16 MB in each task at most
SPANS = "array<struct<first:int,last:int>>"


def winnowed(words: Words, window: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(position of a window, hash of the gram that it keeps) for each window inside one text."""
    k = gram if window >= gram + 1 else window
    n = len(words.hash) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = rolling(words.hash, k)
    kept = grams[:n].copy()
    for j in range(1, window - k + 1):
        np.minimum(kept, grams[j : j + n], out=kept)
    at = np.flatnonzero(words.text[:n] == words.text[window - 1 :])
    return at, kept[at]


class Fingerprints:
    """The windows of a block of items: kept hashes by window length, and the items of each window."""

    def __init__(self, ids: list[str], texts: list[bytes], window: int) -> None:
        words = find_words(texts, ALNUM, LOWER)
        count = np.diff(words.first)
        self.windows: dict[bytes, set[str]] = {}
        self.kept: dict[int, np.ndarray] = {}
        for n in sorted({min(window, c) for c in count.tolist()} - {0}):
            at, kept = winnowed(words, n)
            own = np.minimum(count[words.text[at]], window) == n
            self.kept[n] = np.unique(kept[own])
            for i in at[own].tolist():
                self.windows.setdefault(words.joined(i, n), set()).add(ids[words.text[i]])

    def hits(self, words: Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Whether each word is hit, and the items of each text that has any."""
        edge, found = np.zeros(len(words.hash) + 1, np.int64), {}
        for n, fingerprints in self.kept.items():
            at, kept = winnowed(words, n)
            where = np.minimum(np.searchsorted(fingerprints, kept), len(fingerprints) - 1)
            for i in at[fingerprints[where] == kept].tolist():
                items = self.windows.get(words.joined(i, n))
                if items:
                    edge[i] += 1
                    edge[i + n] -= 1
                    found.setdefault(int(words.text[i]), set()).update(items)
        return np.cumsum(edge[:-1]) > 0, found


KIND = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def _scan(rows: DataFrame, key_type: str, block: tuple[list[str], list[bytes]], window: int) -> DataFrame:
    """(id, n_words, spans, items) of each row, with a benchmark that every task holds."""
    shared = rows.sparkSession.sparkContext.broadcast(Fingerprints(*block, window))  # of at most block_words words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        index = shared.value
        for b in batches:
            for lo, hi in text_slices(b, "text", 1 << 20):
                part = b.slice(lo, hi - lo)
                words = find_words(text_bytes(part.column("text")), ALNUM, LOWER)
                hit, found = index.hits(words)
                spans: list[list[dict[str, int]]] = [[] for _ in range(hi - lo)]
                for t in found:
                    first, last = words.first[t], words.first[t + 1]
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit[first:last], [False]])))
                    spans[t] = [{"first": s, "last": e} for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array(np.diff(words.first).astype(np.int64)),
                        pa.array(spans, KIND),
                        pa.array([sorted(found.get(t, ())) for t in range(hi - lo)], pa.list_(pa.string())),
                    ],
                    names=["id", "n_words", "spans", "items"],
                )

    return rows.mapInArrow(tidied(run), f"id {key_type}, n_words long, spans {SPANS}, items array<string>")


def digest(words: bytes) -> bytes:
    """128 bits that stand for the words of a window."""
    return blake2b(words, digest_size=16).digest()


def _item_windows(items: DataFrame, window: int) -> DataFrame:
    """(n, kept, digest, item) of each window of each item (item, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        for b in batches:
            for lo, hi in text_slices(b, "text", 1 << 18):
                part = b.slice(lo, hi - lo)
                words = find_words(text_bytes(part.column("text")), ALNUM, LOWER)
                count = np.diff(words.first)
                for n in sorted({min(window, c) for c in count.tolist()} - {0}):
                    at, kept = winnowed(words, n)
                    own = np.minimum(count[words.text[at]], window) == n
                    at, kept = at[own], kept[own]
                    digests = pa.array([digest(words.joined(i, n)) for i in at.tolist()], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), n, np.int32)), pa.array(kept.view(np.int64)), digests, part.column("item").take(pa.array(words.text[at]))],
                        names=["n", "kept", "digest", "item"],
                    )

    return items.mapInArrow(tidied(run), "n int, kept long, digest binary, item string")


def _candidates(rows: DataFrame, key_type: str, filters: dict[int, np.ndarray]) -> DataFrame:
    """(id, row, n_words, windows): of each row the windows (n, at, digest) that a filter of kept hashes lets through."""
    shared = rows.sparkSession.sparkContext.broadcast(filters)  # FILTER bits at most
    kind = pa.list_(pa.struct([("n", pa.int32()), ("at", pa.int32()), ("digest", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        for b in batches:
            for lo, hi in text_slices(b, "text", 1 << 20):
                part = b.slice(lo, hi - lo)
                words = find_words(text_bytes(part.column("text")), ALNUM, LOWER)
                windows: list[list[dict]] = [[] for _ in range(hi - lo)]
                for n, bits in shared.value.items():
                    at, kept = winnowed(words, n)
                    place = kept & np.uint64(len(bits) * 64 - 1)
                    passed = bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1) > 0
                    for i in at[passed].tolist():
                        t = int(words.text[i])
                        windows[t].append({"n": n, "at": i - int(words.first[t]), "digest": digest(words.joined(i, n))})
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(words.first).astype(np.int64)), pa.array(windows, kind)], names=["id", "n_words", "windows"])

    found = rows.mapInArrow(tidied(run), f"id {key_type}, n_words long, windows array<struct<n:int,at:int,digest:binary>>")
    return found.withColumn("row", F.monotonically_increasing_id())


def _filters(windows: DataFrame) -> dict[int, np.ndarray]:
    """Of each length of window, which values the low bits of kept hashes have."""
    counts = {r.n: r.kept for r in windows.groupBy("n").agg(F.approx_count_distinct("kept").alias("kept")).collect()}  # one row for each length
    out = {}
    for n, kept in counts.items():
        size = min(FILTER // (1 << len(counts).bit_length()), 1 << max(12, (16 * kept).bit_length()))
        place = F.col("kept").bitwiseAND(F.lit(size - 1))
        bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
        rows = windows.where(F.col("n") == n).select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
        out[n] = np.zeros(size // 64, np.uint64)  # that many rows at most
        out[n][np.asarray(rows.column("at").combine_chunks())] = np.asarray(rows.column("bits").combine_chunks()).view(np.uint64)
    return out


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        merged = []
        for spans in b.column("spans").to_pylist():
            out: list[dict[str, int]] = []
            for s in sorted(spans or [], key=lambda s: s["first"]):
                if out and s["first"] <= out[-1]["last"]:
                    out[-1]["last"] = max(out[-1]["last"], s["last"])
                else:
                    out.append(s)
            merged.append(out)
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(merged, KIND)], names=["row", "spans"])


def _joined(rows: DataFrame, key_type: str, items: DataFrame, window: int) -> DataFrame:
    """(id, n_words, spans, items) of each row, by a shuffle of the windows that can match."""
    windows = stored(_item_windows(items, window), "item-windows")
    found = stored(_candidates(rows, key_type, _filters(windows)), "document-windows")
    of = windows.select("n", "digest", "item").distinct()
    each = found.select("row", F.explode("windows").alias("w")).select("row", F.col("w.n").alias("n"), F.col("w.digest").alias("digest"), F.col("w.at").alias("at"))
    known = stored(windows.select("n", "digest").distinct(), "known-windows")  # a join of two shuffles splits where a window is hot
    hit = stored(each.join(known, ["n", "digest"]), "hit-windows")
    spans = hit.groupBy("row").agg(F.collect_list(F.struct(F.col("at").alias("first"), (F.col("at") + F.col("n")).alias("last"))).alias("spans")).mapInArrow(_merge, f"row long, spans {SPANS}")
    named = hit.select("row", "n", "digest").distinct().join(of, ["n", "digest"]).groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = found.select("row", "id", "n_words").join(spans, "row", "left").join(named, "row", "left")
    none = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
    return out.select("id", "n_words", none("spans", SPANS), none("items", "array<string>"))


def contamination(docs: DataFrame, items: DataFrame, window: int = 8, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_words: int = 500_000) -> DataFrame:
    """(id, n_words, spans, items) of each row: hit spans in words (first inclusive, last exclusive) and sorted item ids as strings."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    wanted = items.where(F.col(item_id_col).isNotNull()).select(F.col(item_id_col).cast("string").alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    most = wanted.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0  # words at most
    if most > block_words:
        return _joined(rows, kind, wanted, window)
    block = wanted.toArrow()
    return _scan(rows, kind, (block.column("item").to_pylist(), text_bytes(block.column("text").combine_chunks())), window)


def keep_clean(docs: DataFrame, items: DataFrame, window: int = 8, id_col: str = "doc_id", text_col: str = "text", least: int = 1, **names: str | int) -> DataFrame:
    """``docs`` without the rows that share a window with ``least`` or more items."""
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"))
    found = contamination(docs.select(key.alias("key"), F.col(text_col).alias("text")), items, window, "key", "text", **names)
    hit = stored(found.where(F.size("items") >= least).select("id.*").distinct().toDF("hit_id", "hit_hash"), "contaminated")
    rows = whole_rows(docs, id=F.col(id_col), text_hash=F.xxhash64(text_col))
    same = F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash"))
    return rows.join(hit, same, "left_anti").select("row.*")
