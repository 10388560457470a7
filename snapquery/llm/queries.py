"""Registered queries of the training-data operators: the operators with production parameters, and their digests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and items that every document shares with the benchmark."""
    from snapquery.llm.decontam import contamination

    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 8)
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.expr("aggregate(spans, 0L, (n, s) -> n + s.last - s.first)").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document; the counts are of base spans."""
    from snapquery.llm.pii import KINDS, personal_data

    names = F.array(*map(F.lit, KINDS))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    of = lambda i: F.filter("base", lambda s: s["kind"] == i)
    counts = [F.size(of(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return personal_data(_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans")
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards by jump consistent hashing."""
    from snapquery.llm.sharding import shard

    return shard(_table(spark, sf_dir, "documents"), 40).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20."""
    from snapquery.llm.ann import neighbours

    return neighbours(_table(spark, sf_dir, "embeddings"), 20, 20)


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 50 words that begin in a document before it."""
    from snapquery.llm.substring import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"), 50).select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 2048 tokens."""
    from snapquery.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER), 2048, 0).withColumnRenamed("id", "doc_id")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of them."""
    from snapquery.llm.langid import fit, predict, teaches

    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(~teaches("id"), F.lit(False))
    return predict(docs, fit(docs.where(teaches()))).select(
        F.col("id").alias("doc_id"), held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    from snapquery.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), max_bits=3).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op9_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses found in every document."""
    from snapquery.llm.license import scan

    place = lambda f: F.concat_ws(":", f["template"], f["first"], f["last"])
    return scan(_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("found").cast("long").alias("n_found"),
        F.array_join(F.array_sort(F.array_distinct("found.template")), ",").alias("licenses"),
        F.coalesce(F.array_max("found.coverage"), F.lit(0.0)).alias("coverage"),
        F.array_join(F.transform("found", place), ",").alias("spans"),
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the unigram model."""
    from snapquery.llm.tokencount import token_counts, zipf_scores

    scores = zipf_scores(tokenizer_path(PIECES))
    return token_counts(_table(spark, sf_dir, "documents"), scores).withColumnRenamed("id", "doc_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of ``corpus_pipeline`` over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_pii, op3_sharding, op4_ann, op5_substring,
        op6_packing, op7_langid, op8_simhash, op9_license, op10_token_counts, pipeline,
    )
}

ORACLES: dict[str, str] = {
    "op1_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g
       FROM (SELECT item_id, w, least(len(w), 8) AS n, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT k, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
       FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT k, p, n, item_id FROM dw JOIN iw USING (n, g)),
h AS (SELECT k, count(DISTINCT q) AS n_hit FROM (SELECT k, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT k, p, n FROM m)) GROUP BY k),
c AS (SELECT k, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN h USING (k) LEFT JOIN c USING (k)
""",
    "op5_substring": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT k, doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS g
      FROM (SELECT k, doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
f AS (SELECT g, min(doc_id) AS least FROM p GROUP BY g),
r AS (SELECT DISTINCT k, q FROM (SELECT k, unnest(range(p, p + 50)) AS q FROM p JOIN f USING (g) WHERE least < doc_id)),
s AS (SELECT k, count(*) AS n_removed, list(q) AS gone FROM r GROUP BY k),
e AS (SELECT k, q, w[q] AS x FROM (SELECT k, w, unnest(range(1, len(w) + 1)) AS q FROM d)),
t AS (SELECT k, string_agg(x, ' ' ORDER BY q) AS kept FROM e ANTI JOIN r USING (k, q) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (k) LEFT JOIN t USING (k)
""",
}
