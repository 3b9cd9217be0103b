"""Query-log files: typed CSV scan, sinks and resumable campaign output."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from querysieve.functions.text import null_if_token
from querysieve.operators.ordering import global_index
from querysieve.schemas import QUERY_LOG
from querysieve.session import materialise
from querysieve.sources.catalogue import CSV_OPTIONS
from querysieve.sources.records import read_csv


def read_log(
    spark: SparkSession, path: str, null_tokens: list[str] | None = None
) -> DataFrame:
    """Typed eleven-column scan; quoted statements may hold quotes and line breaks, files are split at any byte.

    Empty strings come back as null. ``null_tokens`` adds further null spellings.
    """
    df = read_csv(spark, path, QUERY_LOG, CSV_OPTIONS)
    return with_null_tokens(df, null_tokens) if null_tokens is not None else df


def with_null_tokens(df: DataFrame, tokens: list[str] | None = None) -> DataFrame:
    """Null out token values in every string column."""
    names = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    return df.withColumns({c: null_if_token(F.col(c), tokens) for c in names})


def write_log_csv(df: DataFrame, path: str) -> None:
    df.select(*QUERY_LOG.names).write.options(**CSV_OPTIONS).csv(path)


def write_log(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Columnar sink, one folder per split so that scans prune."""
    df.write.mode(mode).partitionBy("split").parquet(path)


CAMPAIGN = ["query_template_id", "attack_technique"]


def pending_campaigns(planned: DataFrame, done: DataFrame) -> DataFrame:
    """Campaigns still to run, numbered on from the highest finished id.

    ``done`` holds one row per finished campaign with its number in ``campaign_no``.
    """
    todo = planned.select(*CAMPAIGN).distinct().join(done.select(*CAMPAIGN), CAMPAIGN, "left_anti")
    last = done.agg(F.coalesce(F.max("campaign_no"), F.lit(-1)).alias("last"))
    numbered = global_index(todo, [F.col(c) for c in CAMPAIGN], "_i")
    return numbered.select(
        *CAMPAIGN, (last.scalar() + 1 + F.col("_i")).cast("bigint").alias("campaign_no")
    )


def append_campaigns(df: DataFrame, path: str) -> None:
    """Add finished campaigns, partitioned so that the next run sees them by listing only."""
    df.write.mode("append").partitionBy(*CAMPAIGN).parquet(path)


def put_campaigns(df: DataFrame, path: str) -> None:
    """Write whole campaigns below ``path``; what a lost run left of them is replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*CAMPAIGN).parquet(f"{path}/rows")


def finish_campaigns(df: DataFrame, path: str) -> None:
    """Write whole campaigns and then mark them as done, so a run that is lost in between does them again.

    Rows are replaced and markers counted once: repeated runs neither double nor skip a campaign.
    """
    held = materialise(df, "campaigns")
    put_campaigns(held, path)
    held.select(*CAMPAIGN).distinct().write.mode("append").parquet(f"{path}/done")


def finished(spark: SparkSession, path: str) -> DataFrame:
    """The marked campaigns, each once."""
    schema = ", ".join(f"{c} string" for c in CAMPAIGN)
    try:
        return spark.read.schema(schema).parquet(f"{path}/done").distinct()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def unfinished(planned: DataFrame, path: str) -> DataFrame:
    """Planned campaigns without a marker."""
    done = finished(planned.sparkSession, path)
    return planned.select(*CAMPAIGN).distinct().join(done, CAMPAIGN, "left_anti")


def finished_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of marked campaigns only."""
    return spark.read.parquet(f"{path}/rows").join(finished(spark, path), CAMPAIGN, "left_semi")
