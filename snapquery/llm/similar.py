"""SimHash near-duplicates of a given Jaccard similarity of word shingles, made complete by prefix filtering.

A document is the set of the 64-bit hashes of its shingles.  The fingerprints of these sets are linked
by anchor-point covering (``simhash.links``), and each set is compared in full with the least set of
its class.  Three of 64 bits hold only part of the pairs of a similarity like 0.8, where about ten bits
differ, and no covering of so many bits is small.  So the rest is found without fingerprints.

All sets are put into one order; two sets
of n and m shingles with a similarity of s or more then share a shingle among the first
n - ceil(s n) + 1 of the one and the first m - ceil(s m) + 1 of the other, whatever the order.  So no
pair is missed, unlike with a threshold on the bits of a fingerprint.  Shingles that stand in many
prefixes come last in the order, which keeps common passages out of the prefixes.

Pairs that share a shingle are first held against bounds that lose none: a pair's first common
shingle has at most as many shingles before it as the sets may differ in, and so many bits at most
differ between the parities of the two sets in buckets, of which there are 256 and then twice as many
as shingles.  The sets of what is left are made again from the texts and compared in full; no set is
stored but those.

This is done in steps, so that a large group of copies does not take all its pairs: first each set
with the least set of each of its shingles, which gives classes; then, in ``TURNS`` turns, the sets
outside a shingle's largest class with ``HUBS`` sets of that class, others in each turn; at last, of
each shingle, the sets that are still outside its largest class with all those of other classes.  Pairs
left out have both ends in one class already, so the classes are those of all pairs.

Two sets that are much alike, but not enough, share many shingles of their prefixes, and each of these
would make the pair again.  So each set brings along, with a shingle, the ``SEEN`` ones before it at which it
takes part; a pair that has met at one of those has been made there, within the same bounds or closer ones,
and isn't made again.  Of two sets outside a shingle's largest class only the lesser brings the other.

Nulls and edges: words are parted by white space, A-Z fold to a-z; a text of fewer words than a shingle
is one shingle, and null and blank texts are equal to each other; an empty table returns no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapquery.llm._shared import components, forget_kept, scratch, stored, text_bytes, text_slices, tidied
from snapquery.llm._words import LOWER, VISIBLE, find_words, mix, rolling
from snapquery.llm.simhash import keep_first, links

COMMON = 32  # prefixes that hold a shingle which comes last
BUCKETS = 256
TURNS, HUBS = 1, 32
SEEN = 8  # earlier shingles that a shingle of a prefix is held against
LAST = 200_000  # shingles that come last, at most
SENT = 500_000  # keys of sets that are broadcast, at most
SLACK = 1e-6  # for rounding; similarities are ratios of small integers


def shingle_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = find_words(texts, VISIBLE, LOWER)
    out = []
    for i in range(len(texts)):
        h = w.hash[w.first[i] : w.first[i + 1]]
        out.append(np.unique(rolling(h, min(shingle, len(h)))) if len(h) else np.zeros(1, np.uint64))
    return out


def fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of a set, as a signed integer: a bit is set if it is in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = np.ascontiguousarray(hashes[at : at + 8192].astype(">u8"))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


def set_key(hashes: np.ndarray) -> int:
    """A hash of a whole set."""
    return int(mix(mix(hashes).sum(keepdims=True) + np.uint64(len(hashes))).view(np.int64)[0])


def sketch(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Of each of so many buckets (a power of two) whether it has an odd number of the hashes."""
    return np.packbits(np.bincount((hashes & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 1).view(np.int64)


def prefix_size(n: int, similarity: float) -> int:
    return n - int(np.ceil(similarity * n - SLACK)) + 1


def _common(docs: DataFrame, text_col: str, shingle: int, similarity: float) -> np.ndarray:
    """Shingles of many prefixes in the order of hashes, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        for b in batches:
            for at, to in text_slices(b, "text", 1 << 20):
                sets = shingle_sets(text_bytes(b.column(0).slice(at, to - at)), shingle)
                firsts = np.concatenate([s[: prefix_size(len(s), similarity)] for s in sets])
                values, n = np.unique(firsts, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], names=["shingle", "n"])

    seen = docs.select(F.col(text_col).alias("text")).mapInArrow(tidied(run), "shingle long, n long")
    often = seen.groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    some = often.orderBy(F.desc("n"), "shingle").limit(LAST).select("shingle").toArrow()
    return np.sort(np.asarray(some.column(0).combine_chunks(), dtype=np.int64).view(np.uint64))


def _sets(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """(id, text_hash, key, n, parity, sketch, fp, firsts) of each row; a task gives the prefix of equal sets once."""
    kind = docs.schema[id_col].dataType.simpleString()
    last = docs.sparkSession.sparkContext.broadcast(_common(docs, text_col, shingle, similarity))  # LAST at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        common, told = last.value, set()
        for b in batches:
            for at, to in text_slices(b, "text", 1 << 20):
                part = b.slice(at, to - at)
                keys, sizes, parities, sketches, fps, firsts = [], [], [], [], [], []
                for s in shingle_sets(text_bytes(part.column(2)), shingle):
                    key = set_key(s)
                    keys.append(key)
                    sizes.append(len(s))
                    parities.append(sketch(s, BUCKETS))
                    if key in told:
                        for column in (sketches, fps, firsts):
                            column.append(None)
                        continue
                    told.add(key)
                    sketches.append(sketch(s, max(BUCKETS, 1 << (2 * len(s) - 1).bit_length())))
                    fps.append(fingerprint(s))
                    place = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    late = common[place] == s if len(common) else np.zeros(len(s), bool)
                    firsts.append(np.concatenate([s[~late], s[late]])[: prefix_size(len(s), similarity)].view(np.int64))
                longs = pa.list_(pa.int64())
                columns = [part.column(0), part.column(1), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(parities, longs), pa.array(sketches, longs), pa.array(fps, pa.int64()), pa.array(firsts, longs)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "text_hash", "key", "n", "parity", "sketch", "fp", "firsts"])

    return _texts(docs, id_col, text_col).mapInArrow(tidied(run), f"id {kind}, text_hash long, key long, n int, parity array<long>, sketch array<long>, fp long, firsts array<long>")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))


def _full(texts: DataFrame, shingle: int) -> DataFrame:
    """(key, n, shingles) of ``texts``; a task gives equal sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        told = set()
        for b in batches:
            for at, to in text_slices(b, "text", 1 << 20):
                sets = {set_key(s): s for s in shingle_sets(text_bytes(b.column(0).slice(at, to - at)), shingle)}
                fresh = {k: s for k, s in sets.items() if k not in told}
                told.update(fresh)
                shingles = pa.array([s.view(np.int64) for s in fresh.values()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(list(fresh), pa.int64()), pa.array([len(s) for s in fresh.values()], pa.int32()), shingles], names=["key", "n", "shingles"])

    return texts.select("text").mapInArrow(tidied(run), "key long, n int, shingles array<long>")


def _apart(p: Column, q: Column) -> Column:
    """Differing bits of two sketches, the larger folded to the size of the other (twice as large at most)."""
    half = lambda x: (F.size(x) / 2).cast("int")
    folded = lambda x: F.zip_with(F.slice(x, F.lit(1), half(x)), F.slice(x, half(x) + 1, half(x)), lambda a, b: a.bitwiseXOR(b))
    level = lambda x, y: F.when(F.size(x) > F.size(y), folded(x)).otherwise(x)
    return F.aggregate(F.zip_with(level(p, q), level(q, p), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, x: n + x)


def _alike(pairs: DataFrame, sets: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Of the pairs (a, b) of keys, those whose sets have the similarity."""
    with scratch(texts.sparkSession) as folders:
        of = lambda c: sets.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
        near = pairs.distinct().join(of("b"), "b").join(of("a"), "a").where(_apart(F.col("sketch_a"), F.col("sketch_b")) <= _most(F.col("n_a"), F.col("n_b"), similarity))
        pairs = stored(near.select("a", "b"), "similar-pairs")
        keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        holders = stored(sets.join(keys, "key", "left_semi").select(F.col("holder.id").alias("held_id"), F.col("holder.text_hash").alias("held_hash")), "similar-holders")
        if holders.count() <= SENT:
            holders = F.broadcast(holders)  # a checked number of documents; more of them are joined by a shuffle
        same = F.col("id").eqNullSafe(F.col("held_id")) & (F.col("text_hash") == F.col("held_hash"))
        held = stored(_full(texts.join(holders, same, "left_semi"), shingle), "similar-sets")
        end = lambda c: held.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"), F.col("shingles").alias(f"of_{c}"))
        shared = F.size(F.array_intersect("of_a", "of_b"))
        enough = shared * (1 + similarity) >= (F.col("n_a") + F.col("n_b")) * similarity - SLACK
        found = stored(pairs.join(end("b"), "b").join(end("a"), "a").where(enough).select("a", "b").distinct(), "similar-links")
        folders.pop()  # the result
    return found


def _met_before(rows: DataFrame) -> DataFrame:
    """``rows`` (token, key, at, ...) with the ``SEEN`` tokens before each of them among those of its key."""
    return rows.withColumn("before", F.collect_list("token").over(Window.partitionBy("key").orderBy("at").rowsBetween(-SEEN, -1)))


def _most(n: Column, m: Column, similarity: float) -> Column:
    """Shingles that stand in only one of two similar sets, at most."""
    return (n + m) * ((1 - similarity) / (1 + similarity)) + SLACK


def _by_fingerprint(sets: DataFrame, sized: Callable[[Column, Column], Column]) -> DataFrame:
    """(a, b): of the distinct ``sets`` (key, n, fp) those of one fingerprint with the least of them, and the least of linked fingerprints."""
    with scratch(sets.sparkSession) as folders:
        hubs = stored(sets.groupBy("fp").agg(F.min(F.struct("key", "n")).alias("hub")), "fingerprint-hubs")
        same = sets.join(hubs, "fp").where(F.col("key") != F.col("hub.key")).select("hub", F.struct("key", "n").alias("other"))
        linked = links(hubs.select("fp")).join(hubs.toDF("a", "hub"), "a").join(hubs.toDF("b", "other"), "b").select("hub", "other")
        met = same.union(linked).where(sized(F.col("hub.n"), F.col("other.n")))
        found = stored(met.select(F.least("hub.key", "other.key").alias("a"), F.greatest("hub.key", "other.key").alias("b")), "fingerprint-pairs")
        folders.pop()  # the result
    return found


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, text_hash, label) of each row: rows have one label where links of at least ``similarity`` join them."""
    if not 0 < similarity <= 1:
        raise ValueError("similarity is above 0 and at most 1")
    with scratch(docs.sparkSession) as folders:
        found = stored(_classes(docs, id_col, text_col, shingle, similarity), "similar-classes")
        folders.pop()  # the result
    return found


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    spark = docs.sparkSession
    sized = lambda n, m: (n >= m * similarity - SLACK) & (m >= n * similarity - SLACK)
    most = lambda n, m: _most(n, m, similarity)
    apart = lambda p, q: sum((F.bit_count(F.get(p, i).bitwiseXOR(F.get(q, i))) for i in range(BUCKETS // 64)), F.lit(0))
    texts = _texts(docs, id_col, text_col)
    with scratch(spark) as folders:
        rows = stored(_sets(docs, id_col, text_col, shingle, similarity), "shingle-sets")
        first = [F.first(c, ignorenulls=True).alias(c) for c in ("n", "parity", "sketch", "fp", "firsts")]
        of_key = stored(rows.groupBy("key").agg(*first, F.min(F.struct("id", "text_hash")).alias("holder")), "sets-once")
        keyed = stored(rows.select("id", "text_hash", "key"), "keyed-rows")
        del folders[1:]  # both stay
    parities = of_key.select("key", "parity")
    firsts = of_key.select("key", "n", F.posexplode("firsts").alias("at", "token"))
    of_token = Window.partitionBy("token")
    met = firsts.withColumn("hub", F.min(F.struct("key", "n")).over(of_token)).withColumn("last", F.max("key").over(of_token))
    posted = stored(met.where("hub.key < last").select("token", "key", "n", "at", "hub"), "posted")
    to_hub = posted.where((F.col("key") != F.col("hub.key")) & sized(F.col("n"), F.col("hub.n"))).select(F.col("hub.key").alias("a"), F.col("key").alias("b"), most(F.col("n"), F.col("hub.n")).alias("most")).distinct()
    held = to_hub.join(parities.toDF("b", "p"), "b").join(parities.toDF("a", "q"), "a").where(apart(F.col("p"), F.col("q")) <= F.col("most"))
    near = _alike(held.select("a", "b").union(_by_fingerprint(of_key, sized)), of_key, texts, shingle, similarity)

    could = sized(F.col("n"), F.col("n_x")) & (F.col("at") + F.col("at_x") <= most(F.col("n"), F.col("n_x"))) & (apart(F.col("parity"), F.col("parity_x")) <= most(F.col("n"), F.col("n_x")))
    for turn in range(TURNS + 1):
        with scratch(spark) as folders:
            labels = components(near).withColumnRenamed("node", "key")
            classed = posted.drop("hub").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
            sizes = classed.groupBy("token", "label").agg(F.count(F.lit(1)).alias("size"))
            main = sizes.groupBy("token").agg(F.max(F.struct("size", "label"))["label"].alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
            split = stored(classed.join(main.select("token", "main"), "token"), "split-tokens")
            others = split
            if turn < TURNS:  # some of the largest class only, others in each turn
                nth = F.row_number().over(Window.partitionBy("token").orderBy(F.xxhash64("key", F.lit(turn)), "key"))
                others = split.where("label = main").withColumn("nth", nth).where(F.col("nth") <= HUBS)
            few = _met_before(split.where("label != main")).join(parities, "key").select("token", *[F.col(c).alias(f"{c}_x") for c in ("key", "n", "at", "label", "parity", "before")])
            others = _met_before(others).join(parities, "key")
            once = ((F.col("label") == F.col("main")) | (F.col("key") < F.col("key_x"))) & ~F.arrays_overlap("before", "before_x")
            across = others.join(few, "token").where((F.col("label") != F.col("label_x")) & could & once)
            pairs = across.select(F.least("key", "key_x").alias("a"), F.greatest("key", "key_x").alias("b"))
            near = stored(near.union(_alike(pairs, of_key, texts, shingle, similarity)), "near")
            folders.pop()  # what the next turn needs
    labels = components(near).withColumnRenamed("node", "key")
    return keyed.join(labels, "key", "left").select("id", "text_hash", F.coalesce("label", "key").alias("label"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each class: that of its smallest id (a null id only if there is no other)."""
    return keep_first(docs, similar_classes(docs, id_col, text_col, shingle, similarity), id_col, text_col)
