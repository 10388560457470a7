"""Best-fit packing of tokenized documents by a plan over the histogram of lengths.

Documents are tokenized once, ended by a closing id and cut into pieces of at most ``capacity`` ids.
Only the counts of the lengths (at most ``capacity`` rows, whatever the corpus) reach the driver.
There best fit runs over counts in falling order of length: sequences with the same content are one
pattern with a multiplicity, and a step places as many pieces as the best-fitting pattern has
sequences.  The pieces then take the planned slots by a join on their rank within their length.

Nulls and edges: a null text is empty, and an empty text is one piece that holds the closing id alone;
a document of k * capacity ids gives k full pieces, and a very long one as many as it needs; a null id is carried along; repeated rows are
packed one by one; an empty table returns no rows.  Other columns of the input are not read.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapquery.llm._shared import kept_by_worker, numbered, stored, text_slices, tidied

#: Words in a generation of a worker's memory, beside those of one batch; it holds two generations.
REMEMBERED = 150_000


def gathered(values: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs numbered ``at`` of ``values``, which falls into runs of ``sizes``, one after the other, and where each begins and the last ends."""
    begins, size = np.cumsum(sizes) - sizes, sizes[at]
    bounds = np.concatenate(([0], np.cumsum(size)))
    return values[np.arange(bounds[-1]) + np.repeat(begins[at] - bounds[:-1], size)], bounds


class WordEncoder:
    """Ids of texts by a ``tokenizers`` file whose model works word by word.

    No word reaches over white space.  So Arrow puts the strings between white space into a dictionary,
    then the words of the distinct strings into another; the model sees each distinct word that is not
    remembered once, and the ids of strings and texts are gathered from those of words.  How a text falls
    into words is only reproduced for characters below U+0180, where letters and digits are listed from
    the Unicode data; a text with any other character, or with what may be a special token, is
    encoded by the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        plain = [chr(i) for i in range(0x180) if i != 0x130]
        kinds = {c: unicodedata.category(c)[0] for c in plain}
        some = lambda kind: "".join(re.escape(c) for c in plain if kinds[c] == kind)
        space = "\\t\\n\\x0b\\x0c\\r\\x20\\x85\\xa0"
        self.words = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d|[{some('L')}]+|[{some('N')}]|\\n|[^{space}{some('L')}{some('N')}]+"
        ).findall
        self.other = r"[^\x00-\x{12f}\x{131}-\x{17f}]|<\|"
        hidden = [i for i in range(256) if not chr(i).isprintable() or chr(i) == " "]
        self.letters = {i: 256 + n for n, i in enumerate(hidden)}  # of bytes that do not stand for themselves
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _own(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if not word.isascii() or not word.isprintable():
            word = word.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _of_words(self, words: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        for w in words:
            if w not in known:
                known[w] = older.get(w) or self._word(w)
        return [known[w] for w in words]

    def _of_strings(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of strings without ASCII white space, one after the other, and the number of each."""
        joined = "\n".join([*strings.to_numpy(zero_copy_only=False), ""]).lower()
        words = pa.array(self.words(joined), pa.large_string()).dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist
        ids = [b"" if w == "\n" else i for w, i in zip(distinct, self._of_words(distinct), strict=True)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        at = np.asarray(words.indices)
        values, bounds = gathered(np.frombuffer(b"".join(ids), "<u4"), sizes, at)
        ends = bounds[:-1][at == (distinct.index("\n") if distinct else -1)]
        return values, np.diff(ends, prepend=0)

    def __call__(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text (null: empty) as little-endian unsigned 32-bit integers."""
        texts = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        foreign = pc.match_substring_regex(texts, self.other)
        split = pc.ascii_split_whitespace(pc.if_else(foreign, "", texts))
        strings = split.flatten().dictionary_encode()
        ids, bounds = gathered(*self._of_strings(strings.dictionary), np.asarray(strings.indices))
        cut = (bounds[np.asarray(split.offsets) - split.offsets[0].as_py()] * 4).tolist()
        whole = ids.astype("<u4", copy=False).tobytes()
        return [self._own(texts[i].as_py()) if f else whole[cut[i] : cut[i + 1]] for i, f in enumerate(foreign.to_pylist())]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, closing: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): the pieces of each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length int, ids_crc32 long" + ", ids array<int>" * with_ids
    end = np.array([closing], dtype="<u4").tobytes()
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = kept_by_worker(("packing", tokenizer), lambda: WordEncoder(tokenizer))
        for b in batches:
            for first, last in text_slices(b, "text", 4 << 20):
                part = b.slice(first, last - first)
                row, piece, length, crc, kept = [], [], [], [], []
                for i, ids in enumerate(encode(part.column(1))):
                    ids += end
                    for k, start in enumerate(range(0, len(ids), step)):
                        cut = ids[start : start + step]
                        row.append(i)
                        piece.append(k)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                        if with_ids:
                            kept.append(np.frombuffer(cut, "<i4"))
                piece = np.array(piece, np.int32)
                out = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece), pa.array(piece.astype(np.int64) * capacity), pa.array(length, pa.int32()), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.array(kept, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names=["id", "piece", "start", "length", "ids_crc32", "ids"][: len(out)])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidied(run), schema)


def plan(histogram: dict[int, int], capacity: int = 2048) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, over counts: (length, first_rank, last_rank, first_sequence, offset) of each run of slots.

    Ranks ``first_rank`` to ``last_rank`` of a length go, one each, to the sequences from ``first_sequence`` on.
    """
    free: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # space left: (first sequence, number, used)
    spaces: list[int] = []  # those that have patterns, rising
    slots, sequences = [], 0

    def put(space: int, pattern: tuple[int, int, int]) -> None:
        from bisect import insort

        if space:
            if not free[space]:
                insort(spaces, space)
            free[space].append(pattern)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            fitting = next((s for s in spaces if s >= length), None)
            if fitting is None:
                each = capacity // length
                number, used = max(1, left // each), min(each, left)
                first, sequences = sequences, sequences + number
                for k in range(used):
                    slots.append((length, rank, rank + number - 1, first, k * length))
                    rank += number
                left -= number * used
                put(capacity - used * length, (first, number, used * length))
                continue
            first, number, used = free[fitting].pop()
            if not free[fitting]:
                spaces.remove(fitting)
            taken = min(left, number)
            slots.append((length, rank, rank + taken - 1, first, used))
            rank, left = rank + taken, left - taken
            put(fitting - length, (first, taken, used + length))
            if taken < number:
                put(fitting, (first + taken, number - taken, used))
    return slots


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, closing: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids], sequence_id, offset): the place of each piece."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer, capacity, closing, id_col, text_col, with_ids), "pieces")  # so that no task needs two Python workers
    ranked = stored(numbered(cut, "length"), "ranked-pieces")
    counts = {r.length: r["count"] for r in ranked.groupBy("length").count().collect()}  # at most `capacity` rows
    slots = plan(counts, capacity)
    schema = "length int, first_rank long, last_rank long, first_sequence long, offset long"
    table = spark.createDataFrame(slots, schema)
    if len(slots) <= 64 * capacity:  # a few runs for each length; a plan that isn't so small is joined by a shuffle
        table = F.broadcast(table)
    placed = ranked.join(table, (ranked.length == table.length) & ranked["rank"].between(F.col("first_rank"), F.col("last_rank")))
    return placed.select(
        "id", "piece", "start", ranked.length.cast("long").alias("length"), "ids_crc32", *["ids"] * with_ids,
        (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset",
    )
