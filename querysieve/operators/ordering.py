"""Global order, running sums and quantiles without putting the order in one task."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window, functions as F

from querysieve.session import materialise

BLOCK = "_block"


def range_blocks(df: DataFrame, keys: Sequence[Column | str], blocks: int | None = None) -> DataFrame:
    """Range-partition ``df`` on ``keys`` and record each row's block number as data.

    The numbered table is written once, so later passes agree on the block boundaries
    even when executors are lost. Without ``blocks``, AQE merges neighbouring ranges up to
    its advisory size, so small tables make few blocks and large ones many.
    """
    ranged = df.repartitionByRange(blocks, *keys) if blocks else df.repartitionByRange(*keys)
    return materialise(ranged.withColumn(BLOCK, F.spark_partition_id()), "ranges")


def running_sums(
    df: DataFrame,
    order: Sequence[Column],
    sums: dict[str, Column],
    groups: Sequence[str] = (),
    blocks: int | None = None,
) -> DataFrame:
    """Inclusive running sums along ``order`` (a total order) inside each group.

    Every window covers one (group, block); the sums of earlier blocks arrive from a
    table with one row per (group, block).
    """
    held = range_blocks(df, [*[F.col(g) for g in groups], *order], blocks)
    addends = held.withColumns({f"_add_{name}": expr for name, expr in sums.items()})
    totals = addends.groupBy(*groups, BLOCK).agg(*[F.sum(f"_add_{n}").alias(f"_tot_{n}") for n in sums])
    earlier = Window.partitionBy(*groups).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *groups,
        BLOCK,
        *[F.coalesce(F.sum(f"_tot_{n}").over(earlier), F.lit(0)).alias(f"_off_{n}") for n in sums],
    )
    inside = (
        Window.partitionBy(*groups, BLOCK)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    scanned = addends.withColumns({f"_run_{n}": F.sum(f"_add_{n}").over(inside) for n in sums})
    return scanned.join(offsets, [*groups, BLOCK]).select(
        *df.columns, *[(F.col(f"_run_{n}") + F.col(f"_off_{n}")).alias(n) for n in sums]
    )


def global_index(
    df: DataFrame, order: Sequence[Column], name: str, groups: Sequence[str] = (), start: int = 0,
    blocks: int | None = None,
) -> DataFrame:
    """Dense row positions along a total order."""
    ranked = running_sums(df, order, {name: F.lit(1).cast("bigint")}, groups, blocks)
    return ranked.withColumn(name, F.col(name) + F.lit(start - 1))


def previous_row(
    df: DataFrame, order: Sequence[Column], columns: dict[str, str], groups: Sequence[str] = (),
    blocks: int | None = None,
) -> DataFrame:
    """``lag`` of ``columns`` (new name -> column) along ``order`` inside each group.

    Inside a block it is a window; a block's first row takes the last row of the closest
    earlier block of its group from a one-row-per-block table.
    """
    held = range_blocks(df, [*[F.col(g) for g in groups], *order], blocks)
    inside = Window.partitionBy(*groups, BLOCK).orderBy(*order)
    packed = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    rows = held.withColumn("_row", packed).withColumns(
        {"_lag": F.lag("_row").over(inside), "_next": F.lead("_row").over(inside)}
    )
    tails = rows.where(F.col("_next").isNull()).select(*groups, BLOCK, F.col("_row").alias("_tail"))
    across = Window.partitionBy(*groups).orderBy(BLOCK)
    tails = tails.select(*groups, BLOCK, F.lag("_tail").over(across).alias("_tail"))
    return (
        rows.join(tails, [*groups, BLOCK], "left")
        .withColumn("_prev", F.coalesce("_lag", "_tail"))
        .select(*df.columns, *[F.col("_prev").getField(n).alias(n) for n in columns])
    )


def exact_quantile(
    df: DataFrame, value: str, q: float, groups: Sequence[str] = (), name: str = "quantile",
    blocks: int | None = None,
) -> DataFrame:
    """Linear-interpolation quantile per group, exact at any cardinality.

    Values are pre-aggregated to (value, count), ranked by running sums, and only the two
    rows around the target rank are kept.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_n"))
    ranked = running_sums(counted, [F.col(value)], {"_upto": F.col("_n")}, groups, blocks)
    totals = ranked.groupBy(*groups).agg(F.sum("_n").alias("_total"))
    if groups:
        ranked = ranked.join(totals, list(groups))
    else:
        ranked = ranked.withColumn("_total", totals.scalar())
    target = (F.col("_total") - 1) * F.lit(float(q))
    low, high = F.floor(target), F.ceil(target)
    first, last = F.col("_upto") - F.col("_n"), F.col("_upto") - 1
    near = ranked.withColumns({"_t": target, "_lo": low, "_hi": high}).where(
        F.col("_lo").between(first, last) | F.col("_hi").between(first, last)
    )
    at = lambda rank: F.max(F.when(F.col(rank).between(first, last), F.col(value)))
    return (
        near.groupBy(*groups)
        .agg(at("_lo").alias("_a"), at("_hi").alias("_b"), F.max(F.col("_t") - F.col("_lo")).alias("_f"))
        .select(*groups, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias(name))
    )


def bracketed_quantile(df: DataFrame, value: str, q: float, low: float, high: float, bins: int = 4096, few: int = 20_000) -> float:
    """Linear-interpolation quantile of finite values between two bounds, exact, without sorting or writing them.

    Values are counted in equal bins and the bin of each wanted rank is divided again until it holds few rows or
    cannot be divided; only that bin's different values reach the driver, or ``bins`` counts. Each division reads ``df`` once.
    Null and not-a-number count as no value; no values give nan.
    """
    held = F.col(value)

    def counted(low: float, high: float) -> dict[int, tuple[int, float, float]]:
        width = (high - low) / bins
        place = F.least(F.greatest(F.floor((held - F.lit(low)) / F.lit(width)), F.lit(0)), F.lit(bins - 1))
        rows = df.where(held.between(low, high)).groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
        return {r["b"]: (r["n"], r["lo"], r["hi"]) for r in rows.collect()}

    def find(ranks: list[int], held_bins: dict[int, tuple[int, float, float]]) -> dict[int, float]:
        out, before, inside = {}, 0, {}
        for b in sorted(held_bins):
            n = held_bins[b][0]
            for rank in ranks:
                if before <= rank < before + n:
                    inside.setdefault(b, []).append((rank, rank - before))
            before += n
        for b, wanted in inside.items():
            n, lo, hi = held_bins[b]
            if n <= few or hi - lo <= 1e-13 * max(abs(lo), abs(hi)):
                rows = df.where(held.between(lo, hi)).groupBy(value).agg(F.count("*").alias("n")).collect() if lo < hi else [{value: lo, "n": n}]
                rows, at = sorted((r[value], r["n"]) for r in rows), 0
                for x, times in rows:
                    out |= {rank: x for rank, place in wanted if at <= place < at + times}
                    at += times
            else:
                deeper = find([place for _, place in wanted], counted(lo, hi))
                out |= {rank: deeper[place] for rank, place in wanted}
        return out

    first = counted(low, high)
    target = (sum(n for n, *_ in first.values()) - 1) * q
    if target < 0:
        return float("nan")
    values = find([floor(target), ceil(target)], first)
    below, above = values[floor(target)], values[ceil(target)]
    return below + (above - below) * (target - floor(target))
