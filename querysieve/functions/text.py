"""Text helpers on column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PLACEHOLDER = "\\{([-a-zA-Z_]+)\\}"
TOKEN = "[\\p{L}\\p{N}_]{2,}"

# Strings a data-frame CSV reader takes for a missing value.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def tokens(text: Column) -> Column:
    """Lower-cased runs of two or more word characters, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def placeholder_names(template: Column) -> Column:
    """Placeholder names in order of appearance, repeats included."""
    return F.regexp_extract_all(template, F.lit(PLACEHOLDER), F.lit(1))


def placeholders(template: Column) -> Column:
    """Placeholder names, the n-th repeat (n >= 2) of a name suffixed with n."""
    def numbered(names: Column) -> Column:
        seen = lambda x, i: F.size(F.filter(F.slice(names, F.lit(1), i + 1), lambda y: y == x))
        return F.transform(
            names, lambda x, i: F.when(seen(x, i) > 1, F.concat(x, seen(x, i).cast("string"))).otherwise(x)
        )

    # The names are bound once: a lambda would search the template again for every place.
    return F.get(F.transform(F.array(placeholder_names(template)), numbered), F.lit(0))


def bare_name(placeholder: Column) -> Column:
    """Placeholder name without its repeat suffix."""
    return F.regexp_replace(placeholder, "[0-9]+$", "")


def fixed_parts(template: Column) -> Column:
    """Text between placeholders, one part more than there are placeholders."""
    return F.split(template, PLACEHOLDER, -1)


def double_quotes(text: Column) -> Column:
    return F.replace(text, F.lit('"'), F.lit('""'))


def payload(statement: Column, template: Column) -> Column:
    """What is left of ``statement`` once every fixed part of its template became a space."""
    parts = F.filter(fixed_parts(template), lambda p: p != "")
    return F.aggregate(parts, statement, lambda acc, p: F.replace(acc, p, F.lit(" ")))


def null_if_token(value: Column, tokens_: list[str] | None = None) -> Column:
    """Null for the listed tokens; by default only the empty string."""
    return F.when(value.isin(tokens_ if tokens_ is not None else [""]), F.lit(None)).otherwise(value)
