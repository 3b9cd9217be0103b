"""Repeatable draws: a pure function of row id and slot, never ``rand()``.

A lost task recomputes exactly the same values, whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# (row id, slot) -> non-negative bigint below the draw's ``space`` (DRAW_SPACE where it names none)
Draw = Callable[[Column, Column], Column]
DRAW_SPACE = 2147483647

# Alphabet of random strings.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
STRING_LENGTH = 20

# Inclusive ranges of the numeric fillers.
NUMBER_RANGES = {
    "rand_pos_number": (0, 64000),
    "rand_medium_pos_number": (1000, 6400),
    "rand_small_pos_number": (2, 5),
}
RANDOM_STRING = "rand_string"


def _long(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("bigint")


def hashed(seed: int = 42) -> Draw:
    """Well-mixed draws of 62 bits for production use."""
    def draw(row, slot) -> Column:
        return F.shiftrightunsigned(F.xxhash64(_long(row), _long(slot), F.lit(seed)), 2)

    draw.space = 1 << 62
    return draw


def linear() -> Draw:
    """The plain integer generator of the fixtures, shared with the SQL oracles.

    The row is reduced first, so the product stays in range for every row id.
    """
    return lambda row, slot: (
        _long(row) % F.lit(DRAW_SPACE).cast("bigint") * F.lit(1103515245).cast("bigint") + _long(slot) * F.lit(12345).cast("bigint")
    ) % F.lit(DRAW_SPACE).cast("bigint")


def unit(draw: Draw, row, slot) -> Column:
    """Draw in [0, 1)."""
    space = getattr(draw, "space", DRAW_SPACE)
    if space <= 1 << 53:
        return draw(row, slot) / F.lit(float(space))
    # A double tells 2^53 values in [0, 1) apart; more bits could round up to 1.
    return F.shiftright(draw(row, slot), space.bit_length() - 54) / F.lit(2.0**53)


def below(draw: Draw, row, slot, n) -> Column:
    """Draw in [0, n)."""
    return draw(row, slot) % _long(n)


def number_filler(draw: Draw, row, slot, kind: str) -> Column:
    lo, hi = NUMBER_RANGES[kind]
    return F.lit(lo).cast("bigint") + below(draw, row, slot, hi - lo + 1)


def string_filler(draw: Draw, row, slot) -> Column:
    """Twenty alphanumeric characters, one sub-slot per character."""
    letters, first = F.lit(list(ALPHABET)), _long(slot) * F.lit(STRING_LENGTH)
    # A loop, not twenty expressions: a statement has many slots, and their generated code has a size limit.
    picks = F.transform(
        F.sequence(F.lit(1), F.lit(STRING_LENGTH)),
        lambda i: F.get(letters, below(draw, row, first + i, len(ALPHABET)).cast("int")),
    )
    return F.array_join(picks, "")


def synthetic_filler(draw: Draw, row, slot, name: Column) -> Column:
    """Filler for a synthetic placeholder name; null for dictionary placeholders."""
    out = F.when(name == RANDOM_STRING, string_filler(draw, row, slot))
    for kind in NUMBER_RANGES:
        out = out.when(name == kind, number_filler(draw, row, slot, kind).cast("string"))
    return out
