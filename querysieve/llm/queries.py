"""The registered queries of this subpackage: name -> function of (session, table folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from querysieve.llm import alignment, chat, huffman, license_scan, mixing, near_vectors, ngram_join, packing, quality, spelling, suffix_dedup, token_counts, warc
from querysieve.session import materialise, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_warc_salvage(spark, sf):
    archives = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf, "pages").select("page_id", "url", "html"), archives)
    found = warc.read_archives(spark, archives, payloads=False)
    return found.where(F.col("kind") == "record").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query
def op2_vector_cells(spark, sf):
    return near_vectors.near_duplicates(table(spark, sf, "embeddings").select("vec_id", "embedding"))


@query
def op3_quality_cascade(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return quality.cascade(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query
def op4_suffix_dedup(spark, sf):
    return suffix_dedup.dedup_digests(table(spark, sf, "documents").select("doc_id", "text"))


@query
def op5_chat_events(spark, sf):
    hard = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame(
        [(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id bigint, turn bigint, role string, text string"
    )
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    written = materialise(chat.render(chat.fold(chat.as_events(rows))), "chat")
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return chat.read_back(written).select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars",
    )


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op6_huffman_ids(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return huffman.round_trip(docs, vocabulary("byte_bpe_50k.json"), scratch_path(spark, "huffman"))


@query
def op7_token_counts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, vocabulary("piece_bpe_32k.model"), scratch_path(spark, "token-cache"))


@query
def op8_best_two_fit(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return packing.pack(packing.pieces(docs, vocabulary("byte_bpe_50k.json")))


@query
def op9_source_mix(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    return mixing.copies(mixing.sizes(docs)).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


@query
def op10_prefix_tree_join(spark, sf):
    return ngram_join.jaccard_groups(table(spark, sf, "documents").select("doc_id", "text"))


@query
def op11_license_scan(spark, sf):
    return license_scan.scan(table(spark, sf, "documents").select("doc_id", "text"))


@query
def op12_merge_path_alignment(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return alignment.align(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


@query
def op13_permuterm_variants(spark, sf):
    return spelling.variants(table(spark, sf, "documents").select("doc_id", "text"))


def _pipeline(spark, sf):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


QUERIES["pipeline"] = _pipeline
