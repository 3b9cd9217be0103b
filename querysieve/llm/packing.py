"""Best-two-fit packing of token sequences.

A bin is filled greedily with the largest documents that fit; then its smallest document gives way to
two unpacked ones whose joint length fills the larger gap more tightly. Documents of one length are
interchangeable, so the plan is made over the histogram of lengths (at most ``capacity`` numbers, whatever
the corpus) and states patterns with their repetitions; each piece finds its place by its rank among the
pieces of its length. Only documents longer than ``capacity`` are cut, the first piece taking the remainder.

Defined results: null texts are empty and have the end id only; rows with equal ids are packed one by one;
an empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from querysieve.llm import bpe
from querysieve.llm.workers import tidied
from querysieve.operators.ordering import global_index
from querysieve.session import materialise, ship

CAPACITY = 1024
END_ID = 2
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of every (doc_id, text)."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for at, part in bpe.in_parts(texts):
                rows = [[], [], [], [], []]
                for k, held in enumerate(bpe.encode(part, path)):
                    held += end
                    n, doc = len(held) // 4, ids[at + k].as_py()
                    first = (n - 1) % capacity + 1
                    for piece, start in enumerate([0, *range(first, n, capacity)]):
                        stop = first if piece == 0 else start + capacity
                        for column, value in zip(rows, (
                            doc, piece, start, stop - start, zlib.crc32(held[4 * start:4 * stop])
                        )):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([
                    pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(rows)
                ], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(tidied(cut, bpe.forget), PIECES)


def best_two_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths, longest first) and how many bins follow each."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] += n
    places = np.arange(capacity + 1)
    plan = []
    while left.any():
        free = left.copy()

        def largest(room: int) -> int:
            found = np.flatnonzero(free[:room + 1])
            return int(found[-1]) if len(found) else 0

        held, gap = [], capacity
        while gap and (length := largest(gap)):
            held.append(length)
            free[length] -= 1
            gap -= length
        if gap and len(held) > 1:
            room = gap + held[-1]
            # For every first length the largest second one, itself included where two are left.
            reach = np.maximum.accumulate(np.where(free > 0, places, 0))
            first = np.flatnonzero(free[:room])
            first = first[first > 0]
            second = np.minimum(reach[room - first], first)
            second = reach[second]
            alone = (second == first) & (free[first] < 2)
            second = np.where(alone, reach[np.maximum(first - 1, 0)], second)
            both = np.where(second > 0, first + second, 0)
            if len(both) and both.max() > held[-1]:
                best = int(np.flatnonzero(both == both.max())[-1])
                held[-1:] = [int(first[best]), int(second[best])]
        need = np.bincount(held, minlength=capacity + 1)
        used = np.flatnonzero(need)
        times = int((left[used] // need[used]).min())
        left -= times * need
        plan.append((sorted(held, reverse=True), times))
    return plan


def slots(plan: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """``(length, first rank, end rank, per bin, first sequence, offset)`` for every pattern and length."""
    next_rank: dict[int, int] = {}
    sequence, out = 0, []
    for held, times in plan:
        offset = 0
        for length in dict.fromkeys(held):
            each = held.count(length)
            start = next_rank.get(length, 0)
            next_rank[length] = start + each * times
            out.append((length, start, start + each * times, each, sequence, offset))
            offset += each * length
        sequence += times
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; columns as given besides."""
    spark = cut.sparkSession
    held = materialise(cut, "pieces")
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # Bounded by the capacity: patterns times the lengths in each, never by the number of documents.
    table = spark.createDataFrame(
        slots(best_two_fit(counts, capacity)),
        "_length bigint, _from bigint, _to bigint, _each bigint, _sequence bigint, _offset bigint",
    )
    order = [F.col(c) for c in ("doc_id", "piece", "ids_crc32")]
    ranked = global_index(held, order, "_rank", groups=["length"])
    rank = F.col("_rank")
    placed = ranked.join(
        F.broadcast(table),
        (F.col("length") == F.col("_length")) & (rank >= F.col("_from")) & (rank < F.col("_to")),
    )
    inside = rank - F.col("_from")
    return placed.withColumns({
        "sequence_id": (F.col("_sequence") + F.floor(inside / F.col("_each"))).cast("bigint"),
        "offset": F.col("_offset") + (inside % F.col("_each")) * F.col("length"),
    }).select(*cut.columns, "sequence_id", "offset")
