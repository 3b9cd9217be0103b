"""Suffix ranks of many integer strings by a distributed difference-cover sort.

Suffixes at places 1 and 2 modulo 3 are the sample. Their triples are sorted and named; the names of a string's
two residues are two strings a third as long, ranked by recursion. The remaining suffixes are merged by counting:
(symbol, rank of the next) orders residues 0 and 1, (two symbols, rank after them) residues 0 and 2. Each
step sorts distinct keys with their counts, so a key that repeats a billion times is one row.

``depth`` bounds the comparison: suffixes that agree in so many symbols may share a rank or stand in any order.
The recursion ends where a triple reaches that far. Ranks count strictly smaller suffixes; the end of a string sorts
before every symbol (symbols are not negative).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from querysieve.session import materialise, ship


def smaller(counted: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """``keys`` and, for each count column, its sum over all smaller keys; keys are distinct.

    Sorted ranges sum on their own; one row per range carries the sums of earlier ranges.
    """
    ordered = counted.select(*keys, *names).repartitionByRange(*keys).sortWithinPartitions(*keys)
    n_keys, columns = len(keys), [*keys, *names, "_range", *(f"_all_{n}" for n in names)]

    def add(batches):
        block, total = TaskContext.get().partitionId(), np.zeros(len(names), np.int64)
        for batch in batches:
            counts = np.stack([c.to_numpy() for c in batch.columns[n_keys:]]) if batch.num_rows else np.zeros((len(names), 0))
            upto = np.cumsum(counts, axis=1).astype(np.int64) + total[:, None]
            before = upto - counts.astype(np.int64)
            total = upto[:, -1] if batch.num_rows else total
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n_keys], *map(pa.array, before), pa.array(np.full(batch.num_rows, block, np.int64)),
                 *map(pa.array, upto)], names=columns,
            )

    ship(counted.sparkSession)
    held = materialise(ordered.mapInArrow(add, ", ".join(f"{c} bigint" for c in columns)), "sums")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = held.groupBy("_range").agg(*[F.max(f"_all_{n}").alias(f"_all_{n}") for n in names]).select(
        "_range", *[F.coalesce(F.sum(f"_all_{n}").over(earlier), F.lit(0)).alias(f"_off_{n}") for n in names]
    )
    return held.join(F.broadcast(ranges), "_range").select(*keys, *[(F.col(n) + F.col(f"_off_{n}")).alias(n) for n in names])


def suffix_ranks(strings: DataFrame, depth: int) -> DataFrame:
    """``sid, i, rank`` for strings given as rows ``sid, i, s`` (bigint) with places from 0 on.

    A written table may hold the next two symbols (-1 behind the end) as ``t1`` and ``t2``; else they are looked up.
    """
    along = Window.partitionBy("sid").orderBy("i")
    follow = lambda c, by: F.coalesce(F.lead(c, by).over(along), F.lit(-1).cast("bigint"))
    residue = (F.col("i") % 3).cast("int")
    if "t1" in strings.columns:
        triples = strings.select("sid", "i", "s", "t1", "t2", residue.alias("m"))
    else:
        triples = strings.select("sid", "i", "s").withColumns({"t1": follow("s", 1), "t2": follow("s", 2)})
        triples = materialise(triples.withColumn("m", residue), "triples")
    key = ["s", "t1", "t2"]
    sample = triples if depth <= 3 else triples.where(F.col("m") != 0)
    names = smaller(sample.groupBy(*key).agg(F.count("*").alias("name")), key, ["name"])
    named = sample.join(names, key)
    if depth <= 3:
        return named.select("sid", "i", F.col("name").alias("rank"))
    shorter = named.select(
        (F.col("sid") * 2 + F.col("m") - 1).alias("sid"), F.floor(F.col("i") / 3).cast("bigint").alias("i"), F.col("name").alias("s")
    )
    ranked = suffix_ranks(shorter, -(-depth // 3)).select(
        F.shiftright("sid", 1).alias("sid"), (F.col("i") * 3 + 1 + F.pmod("sid", F.lit(2))).alias("i"), F.col("rank").alias("r")
    )
    whole = triples.join(ranked, ["sid", "i"], "left").withColumns({"r1": follow("r", 1), "r2": follow("r", 2)})
    whole = materialise(whole, "merged")
    count = lambda residue, name: F.count_if(F.col("m") == residue).alias(name)
    first, second = ["s", "r1"], ["s", "t1", "r2"]
    a = smaller(whole.where(F.col("m") != 2).groupBy(*first).agg(count(0, "a0"), count(1, "a1")), first, ["a0", "a1"])
    b = smaller(whole.where(F.col("m") != 1).groupBy(*second).agg(count(0, "b0"), count(2, "b2")), second, ["b0", "b2"])
    both = whole.join(a, first, "left").join(b, second, "left")
    rank = (
        F.when(F.col("m") == 0, F.col("a0") + F.col("a1") + F.col("b2"))
        .when(F.col("m") == 1, F.col("r") + F.col("a0"))
        .otherwise(F.col("r") + F.col("b0"))
    )
    return both.select("sid", "i", rank.alias("rank"))
