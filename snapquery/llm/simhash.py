"""SimHash near-duplicate detection with anchor-point covering.

A document's 64-bit fingerprint is cut into four 16-bit blocks.  Two fingerprints that differ in at
most three bits have a pair of blocks that holds at most one of those bits, so the search runs once
for each of the six pairs, with threshold one.  In each block the anchors are the words of a covering
code: the Hamming(15,11) code on 15 bits and the remaining bit as it is, covering radius 1.  A pair
of blocks has 2^24 anchors.  Each fingerprint has one home anchor (within the radius) and is
replicated to each anchor within radius plus threshold that can be a home of something at distance
one: about 16 for a pair of blocks, 97 in all.  Homes and replicas meet by an equi-join on the anchor
and are compared there in full.  Both numbers are constant for each fingerprint, so work grows with
the number of distinct fingerprints until these are many times the anchors.  Links are not all close
pairs, but as many as join the same classes: one for each pair of classes that an earlier, linear
search has left apart.

A very long text is hashed in parts, whose bits are counted together.

Nulls and edges: a null or blank text has no words and fingerprint zero; rows with a null id take
part in links but are never the smallest id (a component of null ids only has a null component_id);
repeated rows share a fingerprint and each returns a row; an empty table returns no rows.  Other
columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapquery.llm._shared import components, forget_kept, stored, text_bytes, tidied, whole_rows

SALTED = 2000  # homes of an anchor that one task takes
SENT = 500_000  # hot anchors that are broadcast, at most
PAIRS = [(a, b) for a in range(4) for b in range(a + 1, 4)]


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of a UTF-8 text."""
    words = text.lower().split()  # for bytes: A-Z, and white space is \x20 and \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    half, ones, total = 8192, np.zeros(64, np.int64), len(words) - shingle + 1
    firsts, lasts = starts[:total].tolist(), ends[shingle - 1 :].tolist()
    for k in range(0, total, half):
        h = np.array([digest(joined[s:e], seed) for s, e in zip(firsts[k : k + half], lasts[k : k + half])], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = (ones * 2 > total).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, text_hash, fp): the fingerprint of each row as a signed 64-bit integer, with a hash of the whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        for b in batches:
            fps = np.array([fingerprint(x, shingle, seed) for x in text_bytes(b.column(2))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=["id", "text_hash", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidied(run), f"id {kind}, text_hash long, fp long")


@cache
def block_anchors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each 16-bit value: its home anchor, and (as offsets and values) the homes of its neighbours at distance one."""
    v = np.arange(1 << 16)
    low = v & 0x7FFF
    syndrome = np.zeros(1 << 16, np.int64)
    for i in range(15):
        syndrome ^= np.where(low >> i & 1, i + 1, 0)
    word = np.where(syndrome > 0, low ^ (1 << np.maximum(syndrome - 1, 0)), low)  # the code word within distance one
    words = np.unique(word)
    home = np.searchsorted(words, word) << 1 | v >> 15
    near = np.stack([home[v ^ 1 << i] for i in range(16)], axis=1)
    near.sort(axis=1)
    fresh = (near != home[:, None]) & np.concatenate([np.ones((1 << 16, 1), bool), near[:, 1:] != near[:, :-1]], axis=1)
    return home, np.concatenate([[0], np.cumsum(fresh.sum(axis=1))]), near[fresh]


def anchors_of(fp: np.ndarray, home_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor): the home anchors of each fingerprint, or all to which it is replicated."""
    home, offset, near = block_anchors()
    blocks = [(fp >> np.uint64(16 * i) & np.uint64(0xFFFF)).astype(np.int64) for i in range(4)]
    rows, anchors, every = [], [], np.arange(len(fp))
    for k, (a, b) in enumerate(PAIRS):
        ha, hb, base = home[blocks[a]], home[blocks[b]], k << 24
        rows.append(every)
        anchors.append(base | ha << 12 | hb)
        if home_only:
            continue
        for block, other, mine, rest in ((a, hb, 12, 0), (b, ha, 0, 12)):
            first, n = offset[blocks[block]], offset[blocks[block] + 1] - offset[blocks[block]]
            row = np.repeat(every, n)
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            rows.append(row)
            anchors.append(base | near[at] << mine | other[row] << rest)
    return np.concatenate(rows), np.concatenate(anchors)


def _anchored(fps: DataFrame, home_only: bool) -> DataFrame:
    """(anchor, fp, label) of ``fps`` (fp, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                fp, label = (np.asarray(b.column(c).slice(k, 4096)) for c in (0, 1))
                row, anchor = anchors_of(fp.view(np.uint64), home_only)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int32)), pa.array(fp[row]), pa.array(label[row])], names=["anchor", "fp", "label"])

    return fps.select("fp", "label").mapInArrow(tidied(run), "anchor int, fp long, label long")


def _met(homes: DataFrame, copies: DataFrame, max_bits: int) -> DataFrame:
    """(a, b): labels of the fingerprints that an anchor brings together, where these differ in at most ``max_bits`` bits."""
    salts = stored(homes.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / SALTED).cast("int").alias("salts")).where("salts > 1"), "hot-anchors")
    hot = salts.count()
    if hot:  # homes of a hot anchor are dealt to several tasks, and replicas go to each of them
        salts = F.broadcast(salts) if hot <= SENT else salts  # a checked number of anchors
        homes = homes.join(salts, "anchor", "left").withColumn("salt", F.pmod(F.xxhash64("fp"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        every = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
        copies = copies.join(salts, "anchor", "left").withColumn("salt", F.explode(every)).drop("salts")
    on = ["anchor", "salt"] if hot else ["anchor"]
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
    both = copies.join(homes.withColumnsRenamed({"fp": "other", "label": "home"}), on)
    return both.where((F.col("label") != F.col("home")) & (apart <= max_bits)).select(F.least("label", "home").alias("a"), F.greatest("label", "home").alias("b")).distinct()


def links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """Links (a < b) that join the distinct fingerprints ``fps`` (fp) into the classes of all pairs of at most ``max_bits`` (0 to 3) bits.

    First each home anchor links its fingerprints to the least of them where they are close, which
    gives classes.  Then homes and replicas meet, and of the pairs that two classes share one link is
    kept, between the classes' least fingerprints; pairs within a class are none.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("four blocks serve up to three differing bits")
    homes = stored(_anchored(fps.select("fp", F.col("fp").alias("label")), True), "homes")
    hubs = homes.groupBy("anchor").agg(F.min("fp").alias("a"), F.max("fp").alias("last")).where("a < last").drop("last")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= max_bits
    near = stored(homes.join(hubs, "anchor").where((F.col("a") < F.col("fp")) & close).select("a", F.col("fp").alias("b")).distinct(), "hub-links")
    labels = components(near).withColumnRenamed("node", "fp")
    classed = stored(fps.select("fp").join(labels, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label")), "hub-classes")
    return near.union(_met(_anchored(classed, True), _anchored(classed, False), max_bits))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3, seed: int = 42) -> DataFrame:
    """(id, text_hash, fp, component_id, label) of each row: the smallest id that links of at most ``max_bits`` bits reach."""
    rows = stored(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    labels = components(links(distinct, max_bits))
    classed = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("label", "fp").alias("label")
    )
    least = classed.groupBy("label").agg(F.min("least").alias("component_id"))
    by_fp = classed.join(least, "label").select("fp", "component_id", "label")
    return rows.join(by_fp, "fp").select("id", "text_hash", "fp", "component_id", "label")


def keep_first(docs: DataFrame, classed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with the row of the smallest id of each ``label`` in ``classed`` (id, text_hash, label)."""
    first = classed.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("without"), "id", "text_hash")).alias("k"))
    kept = stored(first.select(F.col("k.id").alias("kept_id"), F.col("k.text_hash").alias("kept_hash")), "kept")
    rows = whole_rows(docs, id=F.col(id_col), text_hash=F.xxhash64(text_col))
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("text_hash") == F.col("kept_hash"))
    return rows.join(kept, same).dropDuplicates(["kept_id", "kept_hash"]).select("row.*")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """``docs`` with one row of each component: that of its smallest id (a null id only if there is no other)."""
    return keep_first(docs, near_duplicates(docs, id_col, text_col, shingle, max_bits), id_col, text_col)
