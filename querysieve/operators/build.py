"""The whole generation chain as one plan: attacks and generated statements to a split, cleaned log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from querysieve.functions import draws as dr
from querysieve.operators import cleaning as cl, synth as sy
from querysieve.schemas import QUERY_LOG
from querysieve.session import materialise

# Draws of the second batch begin this many rows further on, so it does not repeat the first.
SECOND_BATCH = 1_000_000_007


def build_log(
    attacks: DataFrame, rows: DataFrame, templates: DataFrame, dictionaries: DataFrame, draw: dr.Draw, key: str,
    fields: dict[str, list[str]] = sy.AIRPORT_SEARCH_FIELDS, ratio: float = 0.1,
) -> DataFrame:
    """Log rows (``schemas.QUERY_LOG``): attacks, one benign statement per row of ``rows``, and benign test rows.

    1. A statement is generated for every ``key``; attacks go to test, benign rows to train.
    2. Benign rows are added to test until attacks are ``ratio`` of it.
    3. Statements under both labels go; user inputs of administrative statements are emptied.

    The log is written once before the last step, because its statements are read twice there. Without attacks
    nothing is added to test; without rows only that is generated; statements may repeat.
    """
    names = QUERY_LOG.names
    dictionaries = sy.held_dictionaries(dictionaries)
    normals = sy.generate_normals(rows.select(key), templates, dictionaries, draw, key, fields)
    log = cl.first_split(attacks.select(*names).unionByName(normals.select(*names)))

    def later(row: Column | str, slot: Column) -> Column:
        column = F.col(row) if isinstance(row, str) else row
        return draw(column + F.lit(SECOND_BATCH), slot)

    if hasattr(draw, "space"):
        later.space = draw.space
    every = sy.augment_test_split(log, templates, dictionaries, later, ratio, fields)
    held = materialise(every.select(*names), "generated")
    admin = templates.where(F.col("statement_type") == "admin").select(F.col("ID").alias("query_template_id"))
    return cl.blank_admin_inputs(cl.drop_contradictions(held), admin)
