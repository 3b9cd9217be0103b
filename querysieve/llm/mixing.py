"""Mixing sources to target weights, in native column expressions only.

Every source gets a share of a word budget by its weight, at most ``max_repeat`` times its own
size; what lies above that is shared again among the others. A document is emitted
``floor(rate)`` times plus one copy with the probability of the fraction, drawn from a hash of
its id, so reruns and recomputed tasks take the same copies.

Defined results: null texts have size 0; a null source is one source, ordered last; rows with equal
ids share their draw; an empty table gives an empty table; a source without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from querysieve.llm.quality import n_words
from querysieve.session import broadcast_if_small, materialise

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL_SHARE = 1.5
MAX_REPEAT = 2.0
SEED = "mix-1"
DRAW_DIGITS = 13


def unit_draw(seed: str, key: Column) -> Column:
    """A number in [0, 1) from 52 bits of a digest of the seed and the key."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, DRAW_DIGITS), 16, 10).cast("bigint") / F.lit(float(16**DRAW_DIGITS))


def source_targets(
    sizes: DataFrame, source: str = "source", size: str = "size", weights: tuple[float, ...] = WEIGHTS,
    total_share: float = TOTAL_SHARE, max_repeat: float = MAX_REPEAT,
) -> DataFrame:
    """One row per source: ``source_size``, ``target``.

    Sources by cap per weight: those before the first one whose fair share of the rest fits its cap are
    capped. The windows run over one row per source; document rows are summed before.
    """
    each = sizes.groupBy(source).agg(F.sum(size).alias("source_size"))
    by_name = Window.orderBy(F.col(source).asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    listed = F.array(*[F.lit(float(w)) for w in weights])
    each = each.withColumn("_weight", F.get(listed, place)).withColumn("_cap", F.col("source_size") * max_repeat)
    order = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col(source).asc_nulls_last())
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    each = each.withColumns({
        "_total": F.sum("source_size").over(everything) * total_share,
        "_taken": F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0)),
        "_rest": F.sum("_weight").over(onward),
    })
    # The price of a unit of weight if this source and all later ones are free.
    each = each.withColumn("_unit", (F.col("_total") - F.col("_taken")) / F.col("_rest"))
    each = each.withColumn("_free", F.col("_weight") * F.col("_unit") < F.col("_cap"))
    price = F.first(F.when(F.col("_free"), F.col("_unit")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    first_free = F.max(F.col("_free").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    target = F.when(first_free == 1, F.least(F.col("_weight") * price, F.col("_cap"))).otherwise(F.col("_cap"))
    return each.withColumn("target", target).select(source, "source_size", "target")


def copies(sized: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size", seed: str = SEED,
           **how) -> DataFrame:
    """``sized`` with ``source_size``, ``target`` and ``copies``, in place of columns of these names."""
    sized = sized.drop("source_size", "target", "copies", "_mix_source")
    targets = broadcast_if_small(source_targets(sized.select(source, size), source, size, **how))
    clash = targets.withColumnRenamed(source, "_mix_source")
    joined = sized.join(clash, F.col(source).eqNullSafe(F.col("_mix_source")), "left").drop("_mix_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    extra = (unit_draw(seed, F.col(key)) < rate - whole).cast("bigint")
    return joined.withColumn("copies", whole + extra)


def sizes(docs: DataFrame, text: str = "text", columns: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """The narrow side: texts are read once, the targets and the draws need only their sizes."""
    counted = docs.select(*columns, n_words(F.coalesce(F.col(text), F.lit(""))).alias("size"))
    return materialise(counted, "sizes")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it; columns as given, whatever their names."""
    targets = source_targets(sizes(docs, text, (source,)), source, "size", **how)
    rates = broadcast_if_small(targets.select(
        F.col(source).alias("_source"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("_rate"),
    ))
    held = docs.select(F.struct(*docs.columns).alias("_row"), F.col(source).alias("_by"), F.col(key).alias("_key"))
    joined = held.join(rates, F.col("_by").eqNullSafe(F.col("_source")), "left")
    whole = F.floor("_rate")
    times = whole + (unit_draw(SEED, F.col("_key")) < F.col("_rate") - whole).cast("bigint")
    repeated = joined.withColumn("_times", times).where(F.col("_times") > 0)
    return repeated.withColumn(
        "_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_times")))
    ).select(*[F.col("_row")[c].alias(c) for c in docs.columns])
