"""Nearest neighbours through several random-projection hash tables (Datar et al., SCG 2004), in bounded blocks.

In each table a vector's bucket is made of the signs of random projections against their medians, about as many as
there are doublings between a block and the base. Base and queries are sorted together by bucket and by one further
projection; ranks among the base cut the order into blocks of equal size, so a heavy bucket becomes many blocks and light
ones share a block. A query visits the block at its own rank and the nearer neighbouring one, in every table: ``2 *
tables * block_rows`` base rows, however large the base is. Candidates found in several tables count once.

The medians are those of ``SAMPLE`` base rows (they shape buckets only); every base row is indexed and every query searches.
Neighbours outside the visited blocks are missed: the recall is measured against the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from querysieve.operators.detectors.batches import slices, vector_columns
from querysieve.operators.detectors.neighbours import nearest_in_blocks, weigh_nearest
from querysieve.operators.detectors.ocsvm import TERMS, term_normals
from querysieve.operators.ordering import running_sums
from querysieve.session import materialise, ship

TABLES = 10
BLOCK_ROWS = 512
QUERY_ROWS = 4096
SAMPLE = 4096
MOST_BITS = 40
SEED = 11


class Tables:
    """Directions of all tables: ``bits`` for the bucket and one for the order inside it."""

    def __init__(self, tables: int, bits: int, seed: int):
        self.tables, self.bits, self.seed = tables, bits, seed
        self.medians = np.zeros(tables * bits)

    def project(self, part: pd.DataFrame) -> np.ndarray:
        wide = self.tables * (self.bits + 1)
        if "vec" in part:
            x = np.array(part["vec"].tolist(), dtype=np.float64)
            return x @ term_normals(np.arange(x.shape[1]), wide, self.seed)
        sizes = [len(i) for i in part["indices"]]
        row, out = np.repeat(np.arange(len(part)), sizes), np.zeros((len(part), wide))
        joined = lambda c, kind: np.concatenate([np.zeros(0, kind), *(np.asarray(v, kind) for v in part[c])])
        terms, place = np.unique(joined("indices", np.int64), return_inverse=True)
        what = joined("counts", np.float64)
        for at in range(0, len(terms), TERMS):
            own = (place >= at) & (place < at + TERMS)
            x = np.zeros((len(part), len(terms[at:at + TERMS])))
            x[row[own], place[own] - at] = what[own]
            out += x @ term_normals(terms[at:at + TERMS], wide, self.seed)
        return out

    def fit(self, sample: pd.DataFrame) -> None:
        signs = [self.project(part)[:, self.tables:] for part in slices(sample)]
        if self.bits and signs:
            self.medians = np.median(np.concatenate(signs), axis=0)

    def places(self, part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and place in it, rows by tables."""
        values = self.project(part)
        signs = (values[:, self.tables:] > self.medians).reshape(len(part), self.tables, self.bits)
        return signs @ (1 << np.arange(self.bits, dtype=np.int64)), values[:, :self.tables]


def hash_tables(base: DataFrame, key: str, tables: int, block_rows: int, seed: int = SEED) -> Tables:
    """As many bits as leave about a block of base rows in a bucket."""
    made = Tables(tables, min(MOST_BITS, ceil(log2(max(1.0, base.count() / block_rows)))), seed)
    made.fit(base.orderBy(F.xxhash64(key), key).limit(SAMPLE).select(*vector_columns(base)).toPandas())
    return made


def visits(
    queries: DataFrame, base: DataFrame, key: str, tables: int = TABLES, block_rows: int = BLOCK_ROWS, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """(key, tbl, block) of the base rows, one per table, and of the queries, two per table at most."""
    ship(base.sparkSession)
    shared = base.sparkSession.sparkContext.broadcast(hash_tables(base, key, tables, block_rows, seed))
    vec, key_type = vector_columns(base), base.schema[key].dataType.simpleString()

    def lay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = shared.value
        for frame in frames:
            for part in slices(frame):
                bucket, place = held.places(part)
                yield pd.DataFrame({
                    key: np.repeat(part[key].to_numpy(), tables), "tbl": np.tile(np.arange(tables, dtype=np.int32), len(part)),
                    "bucket": bucket.ravel(), "place": place.ravel(),
                })

    placed = lambda df: df.select(key, *vec).mapInPandas(lay, f"{key} {key_type}, tbl int, bucket long, place double")
    both = placed(base).withColumn("held", F.lit(1)).unionByName(placed(queries).withColumn("held", F.lit(0)))
    order = [F.col("bucket"), F.col("place"), F.col("held").desc(), F.col(key)]
    ranked = materialise(running_sums(both, order, {"upto": F.col("held").cast("bigint")}, ("tbl",)), "ranked")
    own = F.floor(F.greatest(F.col("upto") - 1, F.lit(0)) / block_rows).cast("bigint")
    last = F.floor((base.agg(F.count("*").alias("n")).scalar() - 1) / block_rows).cast("bigint")
    beside = F.when(F.pmod(F.col("upto") - 1, F.lit(block_rows)) * 2 < block_rows, F.col("own") - 1).otherwise(F.col("own") + 1)
    stored = ranked.where(F.col("held") == 1).select(key, "tbl", own.alias("block"))
    asked = ranked.where(F.col("held") == 0).withColumns({"own": own, "last": last})
    asked = asked.withColumn("block", F.explode(F.array(F.col("own"), beside))).where(F.col("block").between(0, F.col("last")))
    return stored, asked.select(key, "tbl", "block")


def k_nearest_hashed(
    queries: DataFrame, base: DataFrame, k: int, exclude_self: bool = False, carry: tuple[str, ...] = (), key: str = "id",
    tables: int = TABLES, block_rows: int = BLOCK_ROWS, seed: int = SEED,
) -> DataFrame:
    """As ``neighbours.k_nearest``, among the base rows of the visited blocks."""
    vec = vector_columns(base)
    block_rows = max(block_rows, 2 * k + 2)
    stored, asked = visits(queries, base, key, tables, block_rows, seed)
    # A block that many queries visit meets them in parts.
    parts = asked.groupBy("tbl", "block").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("parts"))
    left = asked.join(parts, ["tbl", "block"]).withColumn("part", F.pmod(F.xxhash64(key), F.col("parts")).cast("int"))
    right = stored.join(parts, ["tbl", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    group = ["tbl", "block", "part"]
    left = queries.select(key, *vec).join(left.select(key, *group), key).groupBy(*group)
    right = base.select(key, *vec, "m", *carry).join(right.select(key, *group), key)
    # Both sides come from one table: fresh names tell their columns apart.
    right = right.select(*[F.col(c).alias(c) for c in right.columns]).groupBy(*group)
    pairs = nearest_in_blocks(left, right, base, k, carry, key)
    return weigh_nearest(pairs.dropDuplicates([key, "nid"]), k, exclude_self, carry, key)
