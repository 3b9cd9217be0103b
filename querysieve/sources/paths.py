"""File paths as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def relative_path(root: str) -> Column:
    """Path of the row's file below ``root``, decoded."""
    decoded = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.substring_index(decoded, f"{root.rstrip('/')}/", -1)
