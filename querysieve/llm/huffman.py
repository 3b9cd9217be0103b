"""Token ids as canonical length-limited Huffman code, in blocks that decode on their own.

A file is a run of blocks; a block holds whole documents in ascending order and nothing that another block
needs. Ids of a document form one bit stream that starts on a byte; the bit offset of every 256th id
(a checkpoint) is stored, so a decoder runs all stretches of a block side by side through one table.

Block, little-endian: ``TKB1``, u32 documents, u32 checkpoints, u64 payload bytes, then per document u8
(1: has an id), i64 id, u64 ids; u64 checkpoint offsets in bits; payload; a line feed. The line feed is
the record end of Spark's text writer, which writes the files with its own commit protocol. The code
lengths lie beside them in ``codebook``.

Defined results: null texts hold the end id only; null document ids come first and stay null; rows with equal ids
stay rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from querysieve.llm import bpe
from querysieve.operators.ordering import running_sums
from querysieve.session import materialise, ship

MAX_BITS = 16
STRIDE = 256
BLOCK_IDS = 500_000
BLOCKS_PER_FILE = 16
MAGIC = b"TKB1"
HEAD = struct.Struct("<4sIIQ")


# ---- the code ----------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for absent ids."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    level, leaf_flags = leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        pairs = len(level) // 2
        packages = level[0:2 * pairs:2] + level[1:2 * pairs:2]
        both = np.concatenate([leaves, packages])
        by_weight = np.argsort(both, kind="stable")
        level = both[by_weight]
        leaf_flags.append(by_weight < len(leaves))
    take = 2 * len(leaves) - 2
    for flags in reversed(leaf_flags):
        n = int(flags[:take].sum())
        lengths[order[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.flatnonzero(lengths)
    order = order[np.argsort(lengths[order], kind="stable")]
    width = lengths[order].astype(np.int64)
    top = int(width.max()) if len(width) else 0
    spans = np.left_shift(np.int64(1), top - width)
    codes[order] = ((np.cumsum(spans) - spans) >> (top - width)).astype(np.uint32)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id and length for each ``MAX_BITS`` bits that may follow."""
    ids, widths = np.zeros(1 << MAX_BITS, np.uint32), np.ones(1 << MAX_BITS, np.int64)
    order = np.flatnonzero(lengths)
    order = order[np.argsort(lengths[order], kind="stable")]
    spans = np.left_shift(np.int64(1), MAX_BITS - lengths[order].astype(np.int64))
    n = int(spans.sum())
    ids[:n] = np.repeat(order, spans)
    widths[:n] = np.repeat(lengths[order].astype(np.int64), spans)
    return ids, widths


def encode_streams(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray, lengths: np.ndarray):
    """Payload of several documents, each from a whole byte on; their byte bounds and each id's bit offset."""
    width = lengths[ids].astype(np.int64)
    ends = np.cumsum(sizes)
    upto = np.concatenate([[0], np.cumsum(width)])
    bits = upto[ends] - upto[ends - sizes]
    n_bytes = (bits + 7) >> 3
    starts = np.cumsum(n_bytes) - n_bytes
    at = upto[:-1] + np.repeat(8 * starts - upto[ends - sizes], sizes)
    total = int(n_bytes.sum())
    # Each code in 64 bits that begin with the 32-bit word of its first bit; codes never share a bit, so their sum is their union.
    value = codes[ids].astype(np.uint64) << (64 - width - (at & 31)).astype(np.uint64)
    word = at >> 5
    first = np.flatnonzero(np.diff(word, prepend=-1))
    held = np.add.reduceat(value, first) if len(first) else value
    words = np.zeros((total >> 2) + 3, np.uint32)
    words[word[first]] = held >> np.uint64(32)
    words[word[first] + 1] += held.astype(np.uint32)
    payload = words.astype(">u4").view(np.uint8)
    return payload[:total], starts, n_bytes, at


def decode_streams(payload: bytes, marks: np.ndarray, sizes: np.ndarray, table) -> np.ndarray:
    """All ids of a block. ``marks``: bit offsets of the checkpoints; ``sizes``: ids after each."""
    ids, widths = table
    raw = np.frombuffer(payload + b"\0\0\0", np.uint8).astype(np.int64)
    seen = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    order = np.argsort(-sizes, kind="stable")
    at, n, target = marks[order].copy(), sizes[order], (np.cumsum(sizes) - sizes)[order]
    out = np.zeros(int(sizes.sum()), np.uint32)
    for step in range(int(n[0]) if len(n) else 0):
        live = int(np.searchsorted(-n, -step, side="left"))
        here = at[:live]
        key = (seen[here >> 3] >> (8 - (here & 7))) & 0xFFFF
        out[target[:live] + step] = ids[key]
        at[:live] += widths[key]
    return out


# ---- blocks ------------------------------------------------------------------------------


def pack_block(docs: list[tuple[int | None, int, bytes, bytes]]) -> bytes:
    """``(doc_id, ids, payload, u64 checkpoint offsets)`` of documents in order -> a block."""
    marks, base = [], 0
    for _, _, payload, own in docs:
        marks.append(np.frombuffer(own, "<u8") + np.uint64(8 * base))
        base += len(payload)
    marks = np.concatenate(marks)
    listed = b"".join(struct.pack("<BqQ", d is not None, d or 0, n) for d, n, _, _ in docs)
    head = HEAD.pack(MAGIC, len(docs), len(marks), base)
    return b"".join([head, listed, marks.astype("<u8").tobytes(), *(p for _, _, p, _ in docs), b"\n"])


def blocks(data: bytes) -> Iterator[tuple[list[tuple[int | None, int]], np.ndarray, bytes]]:
    at = 0
    while at < len(data):
        magic, n, n_marks, size = HEAD.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError(f"no block at byte {at}")
        at += HEAD.size
        docs = [(d if has else None, k) for has, d, k in struct.iter_unpack("<BqQ", data[at:at + 17 * n])]
        at += 17 * n
        marks = np.frombuffer(data, "<u8", n_marks, at).astype(np.int64)
        at += 8 * n_marks
        yield docs, marks, data[at:at + size]
        at += size + 1


def stretch_sizes(n_ids: Iterable[int]) -> np.ndarray:
    """Ids after each checkpoint of documents of ``n_ids`` ids."""
    n = np.fromiter(n_ids, np.int64)
    per = (n + STRIDE - 1) // STRIDE
    sizes = np.full(int(per.sum()), STRIDE, np.int64)
    last = np.cumsum(per) - 1
    sizes[last[per > 0]] = (n - (per - 1) * STRIDE)[per > 0]
    return sizes


# ---- Spark -------------------------------------------------------------------------------


def id_type(vocabulary: int) -> str:
    """u16 where all ids below ``vocabulary`` fit, else u32; little-endian."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def token_table(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """``doc_id, ids`` (of the ``id_type`` of the tokenizer's vocabulary and the end id), the end id appended."""
    end, kind = np.array([end_id], "<u4").tobytes(), id_type(bpe.vocabulary_size(path, end_id))

    def encode(batches):
        for batch in batches:
            for at, part in bpe.in_parts(batch.column(1).to_pylist()):
                held = [np.frombuffer(ids + end, "<u4").astype(kind).tobytes() for ids in bpe.encode(part, path)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.array(held, pa.binary())], names=["doc_id", "ids"]
                )

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(encode, "doc_id bigint, ids binary")


def id_counts(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """Occurrences of every id over the whole table; the driver gets one number per vocabulary entry."""
    kind = id_type(vocabulary)

    def count(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            raw = [np.frombuffer(ids.as_buffer(), kind) for ids in batch.column(0)]
            if raw:
                total += np.bincount(np.concatenate(raw), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    summed = tokens.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    out = np.zeros(vocabulary, np.int64)
    for row in summed.collect():
        out[row["id"]] = row["n"]
    return out


def write_files(tokens: DataFrame, path: str, vocabulary: int = 1 << 16) -> None:
    """Code all documents and write them in ascending ``doc_id`` below ``path``; ids are of ``id_type(vocabulary)``.

    A code of ``MAX_BITS`` bits has room for 65,536 ids in use; more raise.
    """
    spark, kind = tokens.sparkSession, id_type(vocabulary)
    lengths = code_lengths(id_counts(tokens, vocabulary))
    codes = canonical(lengths)
    used = np.flatnonzero(lengths)
    book = [(int(i), int(lengths[i])) for i in used]
    spark.createDataFrame(book, "id bigint, bits int").coalesce(1).write.parquet(f"{path}/codebook")

    def code(batches):
        # A range's documents come in order; a block closes at ``BLOCK_IDS`` ids and where a batch ends.
        for batch in batches:
            raw = batch.column(1)
            at = 0
            while at < len(raw):
                arrays, size, start = [], 0, at
                while at < len(raw) and size < BLOCK_IDS:
                    arrays.append(np.frombuffer(raw[at].as_buffer(), kind))
                    size += len(arrays[-1])
                    at += 1
                sizes = np.array([len(a) for a in arrays], np.int64)
                payload, starts, n_bytes, bit = encode_streams(np.concatenate(arrays), sizes, codes, lengths)
                first = np.cumsum(sizes) - sizes
                data, held = payload.tobytes(), []
                for k, doc in enumerate(batch.column(0).slice(start, len(arrays)).to_pylist()):
                    own = bit[first[k]:first[k] + sizes[k]:STRIDE] - 8 * starts[k]
                    held.append((doc, int(sizes[k]), data[starts[k]:starts[k] + n_bytes[k]], own.astype("<u8").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([pack_block(held)[:-1]], pa.binary())], names=["block"])

    # Ids are dealt by ranges before they are coded: what finds the ranges only reads the written table.
    ordered = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(code, "block binary").select(F.col("block").cast("string").alias("value")).write.option(
        "lineSep", "\n"
    ).option("maxRecordsPerFile", BLOCKS_PER_FILE).text(f"{path}/ids")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` decoded from the files; ``start`` counts all ids before."""
    book = spark.read.parquet(f"{path}/codebook").collect()
    lengths = np.zeros(max((r["id"] for r in book), default=0) + 1, np.uint8)
    for r in book:
        lengths[r["id"]] = r["bits"]

    def decode(batches):
        table = decode_table(lengths)
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                place = 0
                for docs, marks, payload in blocks(content.as_py()):
                    sizes = stretch_sizes(k for _, k in docs)
                    ids = decode_streams(payload, marks, sizes, table).astype("<u4")
                    ends = np.cumsum([k for _, k in docs])
                    sums = [zlib.crc32(ids[e - k:e].tobytes()) for e, (_, k) in zip(ends, docs)]
                    n = len(docs)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([name.as_py()] * n), pa.array(range(place, place + n), pa.int64()),
                        pa.array([d for d, _ in docs], pa.int64()), pa.array([k for _, k in docs], pa.int64()),
                        pa.array(sums, pa.int64()),
                    ], names=["file", "place", "doc_id", "n_tokens", "ids_crc32"])
                    place += n

    ship(spark)
    files = spark.read.format("binaryFile").load(f"{path}/ids/part-*").select("path", "content")
    rows = files.mapInArrow(decode, "file string, place bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint")
    summed = running_sums(
        materialise(rows, "decoded"), [F.col("file"), F.col("place")], {"_upto": F.col("n_tokens")}
    )
    return summed.select("doc_id", (F.col("_upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0) -> DataFrame:
    write_files(materialise(token_table(docs, tokenizer, end_id), "ids"), path, bpe.vocabulary_size(tokenizer, end_id))
    return read_files(docs.sparkSession, path)
