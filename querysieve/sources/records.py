"""CSV records with line breaks inside quotes, read from any number of byte ranges of a file.

Lines are read by ranges, as any text. A line inside a record has an odd number of quotes before it in its file, and a
range's share in that is one bit: the parity of its own quotes. A first scan counts the bits; their running sum over the
ranges of a file tells each range whether it begins inside a quoted value, so a second scan cuts every range into records by
itself. Only the first and last record of a range can go beyond it; these pieces, two for each range at most, are joined.

Quotes inside a quoted value are doubled, and a value with a quote is quoted, as writers of CSV do. Lines end with a line
feed; a carriage return before it is dropped where a record ends. Empty lines between records are none.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from querysieve.session import broadcast_if_small, materialise, ship

# Ranges that are told their start by a broadcast; beyond it lines are shuffled and sorted.
MOST_RANGES = 1_000_000
RECORD = "file string, block bigint, ordinal bigint, record string, piece string"


def _assemble(batches):
    """Records of the lines of each range; ``piece``: whole, head (of an earlier range's record) or tail."""
    names = [f.split()[0] for f in RECORD.split(", ")]
    key, rows, held, odd_so_far, head, ordinal = None, [], [], 0, False, 0

    def close(piece):
        nonlocal held, ordinal, head
        rows.append((*key, ordinal, "\n".join(held), piece))
        held, ordinal, head = [], ordinal + (piece != "head"), False

    for batch in batches:
        for line, file, block, odd, inside in zip(*(c.to_pylist() for c in batch.columns[:5])):
            if (file, block) != key:
                if held:
                    close("head" if head else "tail")
                key, odd_so_far, head, ordinal = (file, block), inside, bool(inside), 0
            held.append(line)
            odd_so_far ^= odd
            if not odd_so_far:
                close("head" if head else "whole")
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
            rows.clear()
    if held:
        close("head" if head else "tail")
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)


def read_records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """``file, block, ordinal, record``: the text of every record; a file's first one has block and ordinal 0."""
    ship(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )
    quotes = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    lines = lines.withColumn("odd", (quotes % 2).cast("int"))
    ranges = materialise(lines.groupBy("file", "block").agg((F.sum("odd") % 2).cast("int").alias("odd")), "ranges")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("file", "block", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).cast("int").alias("inside"))
    columns = ["value", "file", "block", "odd", "inside"]
    if ranges.count() <= MOST_RANGES:
        told = lines.join(broadcast_if_small(starts, MOST_RANGES, 1 << 28), ["file", "block"]).select(*columns)
    else:
        told = lines.withColumn("_at", F.monotonically_increasing_id()).join(starts, ["file", "block"])
        told = told.repartition("file", "block").sortWithinPartitions("file", "block", "_at").select(*columns)
    pieces = materialise(told.mapInArrow(_assemble, RECORD), "records")

    cut = pieces.where(F.col("piece") != "whole")
    order = Window.partitionBy("file").orderBy("block", "piece")  # a range's head stands before its tail
    numbered = cut.withColumn("_record", F.count_if(F.col("piece") == "tail").over(order))
    joined = numbered.groupBy("file", "_record").agg(
        F.min(F.struct("block", F.when(F.col("piece") == "tail", F.col("ordinal")).otherwise(0).alias("ordinal"))).alias("at"),
        F.array_sort(F.collect_list(F.struct("block", "piece", "record"))).alias("parts"),
    ).select("file", "at.block", "at.ordinal", F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"))
    every = pieces.where(F.col("piece") == "whole").select("file", "block", "ordinal", "record").unionByName(joined)
    return every.withColumn("record", F.regexp_replace("record", "\r$", "")).where(F.col("record") != "")


def read_csv(spark: SparkSession, path: str, schema, options: dict) -> DataFrame:
    """Typed rows of CSV files as ``spark.read.csv`` gives them with ``multiLine``, but in parallel over a single file."""
    records = read_records(spark, path, options.get("quote", '"'))
    if options.get("header"):
        records = records.where((F.col("block") != 0) | (F.col("ordinal") != 0))
    kept = {k: str(v) for k, v in options.items() if k not in ("header", "multiLine")}
    return records.select(F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), kept).alias("r")).select("r.*")
