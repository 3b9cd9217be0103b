"""Placeholder dictionaries: long tables (schema, dict_name, pos, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from querysieve.operators.ordering import global_index
from querysieve.sources.paths import relative_path

# Line breaks a text file may hold besides CR and LF.
OTHER_BREAKS = "[\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]"


def read_dictionaries(spark: SparkSession, root: str, schema_name: str) -> DataFrame:
    """Every entry of ``root`` is one dictionary: a text file, or a folder of them in name order.

    One value per line, duplicates kept. Files are read line by line and may be split across
    tasks: positions are line ranks inside a file block (bounded by the scan's split size)
    plus the lines of the dictionary's earlier blocks.
    """
    path = relative_path(root)
    lines = spark.read.option("recursiveFileLookup", True).text(root).select(
        F.regexp_replace(F.split_part(path, F.lit("/"), F.lit(1)), "^dict_name=|\\.txt$", "").alias("dict_name"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_seq"),
        F.posexplode(F.split("value", OTHER_BREAKS, -1)).alias("_sub", "value"),
    )
    block = ["dict_name", "_file", "_start"]
    inside = Window.partitionBy(*block).orderBy("_seq", "_sub")
    ranked = lines.withColumn("_rank", F.row_number().over(inside) - 1)
    sizes = ranked.groupBy(*block).agg((F.max("_rank") + 1).alias("_n"))
    before = (
        Window.partitionBy("dict_name").orderBy("_file", "_start")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select(*block, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return ranked.join(offsets, block).select(
        F.lit(schema_name).alias("schema"),
        "dict_name",
        (F.col("_rank") + F.col("_off")).cast("bigint").alias("pos"),
        "value",
    )


def column_values(df: DataFrame, row: str, columns: dict[str, str]) -> DataFrame:
    """(dict_name, row, value): the non-null values of each column with their bigint row order."""
    keyed = df.select(
        F.col(row).cast("bigint").alias("row"), *[F.col(c).cast("string").alias(d) for d, c in columns.items()]
    )
    return keyed.unpivot("row", list(columns), "dict_name", "value").where(F.col("value").isNotNull())


def build_dictionaries(parts: list[DataFrame], schema_name: str) -> DataFrame:
    """Dictionaries from column values: row order and duplicates kept, positions dense from 0."""
    values = reduce(DataFrame.unionByName, parts)
    indexed = global_index(values, [F.col("row")], "pos", groups=["dict_name"])
    return indexed.select(F.lit(schema_name).alias("schema"), "dict_name", "pos", "value")


def write_dictionaries(df: DataFrame, root: str) -> None:
    """One folder per dictionary, lines in position order inside and across its files."""
    (
        df.select("dict_name", "pos", "value")
        .repartitionByRange("dict_name", "pos").sortWithinPartitions("dict_name", "pos")
        .select("dict_name", "value").write.partitionBy("dict_name").text(root)
    )
