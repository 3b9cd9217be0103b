"""Statement templates from CSV files, one file or folder per statement type."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from querysieve.functions import text as tx
from querysieve.schemas import STATEMENT_SHARES, TEMPLATE_FILE

CSV_OPTIONS = {
    "header": True, "quote": '"', "escape": '"', "multiLine": True,
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}
SHARE_TOLERANCE = 1e-10


def check_shares(shares: dict[str, float]) -> dict[str, float]:
    """Fail fast when statement-type shares do not sum to one."""
    total = sum(shares.values())
    if abs(total - 1.0) > SHARE_TOLERANCE:
        raise ValueError(f"statement shares must sum to 1, got {total}")
    return shares


def share_check(shares: DataFrame, column: str = "proportion", groups: Sequence[str] = ()) -> DataFrame:
    """The same check on a table of shares: (total, ok) of each group, or of the table."""
    total = F.sum(column)
    return shares.groupBy(*groups).agg(
        F.round(total, 6).alias("total"), (F.abs(total - 1) <= F.lit(1e-9)).alias("ok")
    )


def read_templates(
    spark: SparkSession, root: str, shares: dict[str, float] = STATEMENT_SHARES
) -> DataFrame:
    """Union of ``root/<type>.csv`` files tagged with type, share and placeholder list."""
    def one(kind: str, share: float) -> DataFrame:
        return (
            spark.read.schema(TEMPLATE_FILE).options(**CSV_OPTIONS).csv(f"{root}/{kind}.csv")
            .withColumns({"proportion": F.lit(float(share)), "statement_type": F.lit(kind)})
        )

    frames = [one(kind, share) for kind, share in check_shares(shares).items()]
    return reduce(DataFrame.unionByName, frames).withColumn("placeholders", tx.placeholders(F.col("template")))


def write_templates(templates: DataFrame, root: str) -> None:
    """Inverse of :func:`read_templates`."""
    for kind in STATEMENT_SHARES:
        (
            templates.where(F.col("statement_type") == kind)
            .select(*TEMPLATE_FILE.names)
            .write.options(**CSV_OPTIONS).csv(f"{root}/{kind}.csv")
        )
