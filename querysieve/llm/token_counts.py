"""Token counts through a cache keyed by content and tokenizer version.

A text's key is the SHA-256 of its UTF-8 bytes (null as empty) beside the SHA-256 of the vocabulary file.
Keys without a stored count are misses; of the rows with one content, only those with its smallest
``doc_id`` are encoded, and their counts are appended to the cache as Parquet.

Defined results: null texts count as empty; equal texts have equal counts; rows with equal ids stay rows of
their own; an empty table gives an empty table. A cache written twice with one key keeps equal counts, so a
repeated append after a lost run does no harm.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from querysieve.llm import bpe
from querysieve.session import broadcast_if_small, materialise, ship

CACHE = "content binary, tokenizer string, n_tokens bigint"
LIMIT = 4096


@lru_cache(maxsize=4)
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def counts_of(texts: list[str], path: str) -> list[int]:
    if path.endswith(".json"):
        return [len(ids) // 4 for ids in bpe.encode(texts, path)]
    return [len(ids) for ids in _pieces(path).encode(texts, num_threads=1)]


def version(path: str) -> str:
    """The digest that tells vocabularies apart."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def read_cache(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    try:
        stored = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], CACHE)
    of_version = stored.where(F.col("tokenizer") == tokenizer)
    return of_version.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, cache: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every (doc_id, text)."""
    spark, tokenizer = docs.sparkSession, version(path)
    ship(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("content"))
    narrow = materialise(keyed.select("doc_id", "content", F.octet_length("text").cast("bigint").alias("n_bytes")), "keys")

    firsts = narrow.groupBy("content").agg(F.min("doc_id").alias("_first"))
    stored = read_cache(spark, cache, tokenizer)
    known = stored.select("content", F.lit(None).cast("bigint").alias("_first"))
    # Rows not to encode: contents with a stored count, and later copies of a content.
    copies = narrow.join(firsts, "content").where(
        F.col("_first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("_first")))
    ).select("content", "doc_id")
    hits = narrow.join(known.select("content"), "content", "left_semi").select("content", "doc_id")
    skip = broadcast_if_small(copies.union(hits).distinct(), max_rows=500_000)
    misses = keyed.join(
        skip.select(F.col("content").alias("_content"), F.col("doc_id").alias("_id")),
        (F.col("content") == F.col("_content")) & F.col("doc_id").eqNullSafe(F.col("_id")),
        "left_anti",
    ).select("content", "text")

    def encode(batches):
        for batch in batches:
            for at, part in bpe.in_parts(batch.column(1).to_pylist()):
                counted = pa.array(counts_of(part, path), pa.int64())
                named = pa.array([tokenizer] * len(part), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), named, counted], names=["content", "tokenizer", "n_tokens"]
                )

    counted = misses.mapInArrow(encode, CACHE).groupBy("content", "tokenizer").agg(F.max("n_tokens").alias("n_tokens"))
    counted.write.mode("append").parquet(cache)
    found = read_cache(spark, cache, tokenizer)
    return narrow.join(found, "content", "left").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
