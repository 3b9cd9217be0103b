"""Dataset statistics of a query log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from querysieve.session import broadcast_if_small

STAGES = ["exploit", "recon"]
MOST_STAGES = 1000


def found_stages(log: DataFrame) -> list[str]:
    """The usual stages and all others of the log, in order; too many for columns raise."""
    found = log.select("attack_stage").where(F.col("attack_stage").isNotNull()).distinct().limit(MOST_STAGES + 1).collect()
    if len(found) > MOST_STAGES:
        raise ValueError(f"more than {MOST_STAGES} stages")
    return sorted({*STAGES, *(r[0] for r in found)})


def stage_pivot(log: DataFrame, stages: Sequence[str] | None = None) -> DataFrame:
    """Rows per campaign and stage, zero-filled: all stages found, or those given, beside which any other raises."""
    stages = found_stages(log) if stages is None else stages
    stage = F.col("attack_stage")
    unknown = F.raise_error(F.concat(F.lit("unlisted stage "), stage)).cast("string")
    return (
        log.where(F.col("attack_id").isNotNull() & F.col("attack_stage").isNotNull())
        .withColumn("attack_stage", F.when(stage.isin(*stages), stage).otherwise(unknown))
        .groupBy("attack_id").pivot("attack_stage", list(stages)).count().na.fill(0)
    )


def success_rate(log: DataFrame, order: str = "id") -> DataFrame:
    """Per technique: successful campaigns (first row decides), their rate, and log rows."""
    attacks = log.where(F.col("attack_technique").isNotNull())
    firsts = attacks.groupBy("attack_id").agg(
        F.min_by(F.struct("attack_technique", "attack_status"), F.col(order)).alias("f")
    ).select("f.*")
    campaigns = firsts.groupBy("attack_technique").agg(
        F.count_if(F.col("attack_status") == "success").alias("successful"), F.count("*").alias("campaigns")
    )
    totals = attacks.groupBy("attack_technique").agg(F.count("*").alias("total_queries"))
    return campaigns.join(totals, "attack_technique").select(
        "attack_technique", "successful",
        F.bround(F.col("successful") / F.col("campaigns"), 4).alias("success_rate"), "total_queries",
    )


def split_label_counts(log: DataFrame) -> DataFrame:
    """Attack and benign rows per split."""
    return log.groupBy("split").agg(
        F.count_if(F.col("label") == 1).alias("attacks"), F.count_if(F.col("label") == 0).alias("normals")
    )


def _ids(log: DataFrame, cond) -> DataFrame:
    return log.where(cond).select("query_template_id").distinct()


def templates_test_only(log: DataFrame) -> DataFrame:
    """Templates seen in test but not in train."""
    return _ids(log, F.col("split") == "test").subtract(_ids(log, F.col("split") == "train"))


def templates_no_attack(log: DataFrame) -> DataFrame:
    """Templates with benign rows only."""
    return log.groupBy("query_template_id").agg(
        F.bool_or(F.col("label") == 0).alias("_n"), F.bool_or(F.col("label") == 1).alias("_a")
    ).where(F.col("_n") & ~F.col("_a")).select("query_template_id")


def template_overlap(log: DataFrame) -> DataFrame:
    """Template counts in test only, train only and both (one row)."""
    seen = log.groupBy("query_template_id").agg(
        F.coalesce(F.bool_or(F.col("split") == "test"), F.lit(False)).alias("_te"),
        F.coalesce(F.bool_or(F.col("split") == "train"), F.lit(False)).alias("_tr"),
    )
    return seen.agg(
        F.count_if(F.col("_te") & ~F.col("_tr")).alias("test_only"),
        F.count_if(~F.col("_te") & F.col("_tr")).alias("train_only"),
        F.count_if(F.col("_te") & F.col("_tr")).alias("both"),
    )


def stmt_proportions(log: DataFrame) -> DataFrame:
    """Share of each statement type among normal, attack, train and test rows.

    The log is reduced once to (statement type, label, split) counts; the four subsets
    are sums over that table.
    """
    cells = log.groupBy("statement_type", "label", "split").agg(F.count("*").alias("n"))
    subsets = F.array_compact(F.array(
        F.when(F.col("label") == 0, "normal"), F.when(F.col("label") == 1, "attack"),
        F.when(F.col("split") == "train", "train"), F.when(F.col("split") == "test", "test"),
    ))
    counts = cells.withColumn("subset", F.explode(subsets)).groupBy("subset", "statement_type").agg(
        F.sum("n").alias("n")
    )
    totals = counts.groupBy("subset").agg(F.sum("n").alias("total"))
    return counts.join(broadcast_if_small(totals), "subset").select(
        "subset", "statement_type", (F.col("n") / F.col("total")).alias("proportion")
    )


def template_split_stats(log: DataFrame) -> DataFrame:
    """Rows, templates, attacks and benign rows per template split."""
    return log.groupBy("template_split").agg(
        F.count("*").alias("queries"),
        F.count_distinct("query_template_id").alias("templates"),
        F.count_if(F.col("label") == 1).alias("attacks"),
        F.count_if(F.col("label") == 0).alias("normals"),
    )
