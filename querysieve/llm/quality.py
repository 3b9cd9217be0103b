"""Quality rules as a short-circuit cascade, in native column expressions only.

Every rule is a boolean column over the whole text. A document is kept when no rule rejects it,
so the order of the rules changes the work, never the verdict: ``cascade`` measures each rule's
cost and rejection rate on a sample and evaluates the rules by rejection per cost, each one only
for documents that all earlier ones have passed.

Defined results: a null text has no words, lines or symbols; a document with fewer than ten words
fails the base rule and is not kept; rows are judged one by one, so repeated rows and ids give
repeated verdicts; an empty table gives an empty table. Names that begin with ``_quality`` are the operator's own;
measures take the place of columns of their names.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from querysieve.session import materialise

# Fixed values of the word definition: everything but space and \t \n \v \f \r.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

# Rows of the sample that orders the rules; it has no influence on a verdict.
SAMPLE_ROWS = 2000
# Copies of the sample that a rule is timed on, and the least time that counts: shorter ones are noise.
COPIES, LEAST_SECONDS = 20, 0.02


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for a text to drop; it may use the columns of ``base_measures``."""

    name: str
    rejects: Column


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(
        F.array().cast("array<string>")
    )


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.length(F.btrim(line, F.lit(SPACES))) > 0)


def _shifted(array: str, by: int, length: Column) -> Column:
    return F.slice(F.col(array), F.lit(by + 1), length)


def base_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words``.

    Windows are compared by 64-bit hashes of their words' hashes inside one document. Only a
    document with a repeated window sorts its windows to find the words they cover.
    """
    held = F.coalesce(F.col(text), F.lit(""))
    wide = docs.withColumns({"_quality_text": held}).withColumns({
        "_quality_hashes": F.transform(words(F.col("_quality_text")), lambda w: F.xxhash64(w)),
        "_quality_lines": worded_lines(F.col("_quality_text")),
        "word_chars": F.length(F.translate(F.col("_quality_text"), SPACES, "")).cast("bigint"),
        "n_symbols": (F.length("_quality_text") - F.length(F.translate(F.col("_quality_text"), SYMBOLS, ""))).cast("bigint"),
    })
    wide = wide.withColumns({
        "n_words": F.size("_quality_hashes").cast("bigint"),
        "n_lines": F.size("_quality_lines").cast("bigint"),
        "n_dup_lines": (F.size("_quality_lines") - F.size(F.array_distinct("_quality_lines"))).cast("bigint"),
        "_quality_spots": F.greatest(F.size("_quality_hashes") - F.lit(WINDOW - 1), F.lit(0)),
    })
    parts = [_shifted("_quality_hashes", k, F.col("_quality_spots")).alias(f"w{k}") for k in range(WINDOW)]
    wide = wide.withColumn("_quality_windows", F.transform(F.arrays_zip(*parts), lambda z: F.xxhash64(z)))
    wide = wide.withColumn("_quality_repeats", F.size("_quality_windows") > F.size(F.array_distinct("_quality_windows")))
    # Sorted (window, place) pairs, each beside its neighbours; repeated ones give their places.
    none = F.lit(None).cast("array<bigint>")
    placed = F.transform(F.col("_quality_windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    wide = wide.withColumn("_quality_sorted", F.when(F.col("_quality_repeats"), F.sort_array(placed)))
    n = F.size("_quality_sorted")
    last = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    beside = F.arrays_zip(
        F.col("_quality_sorted").alias("here"),
        F.concat(last, F.slice("_quality_sorted", F.lit(1), n - 1)).alias("before"),
        F.concat(F.slice("_quality_sorted", F.lit(2), n - 1), last).alias("after"),
    )
    same = lambda z: (z["here"]["h"].eqNullSafe(z["before"]["h"])) | (z["here"]["h"].eqNullSafe(z["after"]["h"]))
    places = F.sort_array(F.transform(F.filter(beside, same), lambda z: z["here"]["i"].cast("bigint")))
    wide = wide.withColumn("_quality_places", F.when(F.col("_quality_repeats"), places).otherwise(none))
    following = F.concat(
        F.slice("_quality_places", F.lit(2), F.size("_quality_places") - 1), F.array(F.lit(1 << 40).cast("bigint"))
    )
    steps = F.arrays_zip(F.col("_quality_places").alias("here"), following.alias("after"))
    covered = F.aggregate(
        steps, F.lit(0).cast("bigint"),
        lambda total, z: total + F.least(F.lit(WINDOW).cast("bigint"), z["after"] - z["here"]),
    )
    wide = wide.withColumn("n_repeat_words", F.when(F.col("_quality_repeats"), covered).otherwise(F.lit(0).cast("bigint")))
    return wide.drop("_quality_hashes", "_quality_spots", "_quality_windows", "_quality_repeats", "_quality_sorted", "_quality_places", "_quality_lines", "_quality_text")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def default_rules(text: str = "text") -> list[Rule]:
    """Bounds in the manner of the published web-corpus rules, set so that clean prose passes."""
    held = F.coalesce(F.col(text), F.lit(""))
    count = lambda pattern: F.regexp_count(held, F.lit(pattern))
    words_, lines = F.col("n_words"), F.col("n_lines")
    return [
        Rule("word_length", (F.col("word_chars") < 2 * words_) | (F.col("word_chars") > 15 * words_)),
        Rule("symbols", 10 * F.col("n_symbols") > words_),
        Rule("repeated_lines", 2 * F.col("n_dup_lines") > lines),
        Rule("bullet_lines", 10 * count("(?m)^[ \\t]*[-*\u2022]") > 9 * lines),
        Rule("cut_lines", 10 * count("(?m)(?:\\.\\.\\.|\u2026)[ \\t]*$") > 5 * lines),
        Rule("letterless_words", 10 * count(r"[^\x20\x09-\x0D]*\p{L}[^\x20\x09-\x0D]*") < 6 * words_),
    ]


def rule_costs(sample: DataFrame, rules: list[Rule], copies: int = COPIES) -> list[float]:
    """Seconds of each rule over ``copies`` copies of the sample, beyond those of a job without a rule; the less of two runs."""
    wide = sample.withColumn("_quality_copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))

    def seconds(condition: Column) -> float:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            wide.agg(F.count_if(condition)).first()
            runs.append(time.perf_counter() - start)
        return min(runs)

    seconds(F.col("_quality_copy") > 0)  # the first job compiles
    without = seconds(F.col("_quality_copy") > 0)
    return [max(seconds(rule.rejects) - without, LEAST_SECONDS) for rule in rules]


def order_rules(measured: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second on about ``sample_rows`` rows; ties keep the given order.

    A rule's rejections are counted among the rows that the base and the rules before it have passed.
    """
    total = measured.count()
    if not total or not rules:
        return rules
    sample = materialise(measured.sample(min(1.0, sample_rows / total), seed=7), "sample")
    costs = rule_costs(sample, rules)
    passed = sample.where(~base_failed()).select(*[F.coalesce(r.rejects, F.lit(False)).alias(f"r{i}") for i, r in enumerate(rules)])
    # One row per combination of verdicts: no more than rows of the sample.
    seen = [(tuple(r)[:-1], r["count"]) for r in passed.groupBy(*passed.columns).count().collect()]
    order, left = [], list(range(len(rules)))
    while left:
        worth = {i: (sum(n for verdicts, n in seen if verdicts[i]) + 0.5) / costs[i] for i in left}
        best = max(left, key=lambda i: (worth[i], -i))
        order.append(best)
        left.remove(best)
        seen = [(verdicts, n) for verdicts, n in seen if not verdicts[best]]
    return [rules[i] for i in order]


def verdict(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, else null; later rules are not evaluated."""
    chain = F.when(base_failed(), F.lit("base"))
    for rule in rules:
        chain = chain.when(rule.rejects, F.lit(rule.name))
    return chain


def cascade(
    docs: DataFrame, text: str = "text", rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """``docs`` with its measures, ``base_failed``, ``rejected_by`` and ``kept``."""
    rules = default_rules(text) if rules is None else rules
    total = docs.count()
    if total:
        sample = base_measures(docs.sample(min(1.0, sample_rows / total), seed=7), text)
        rules = order_rules(sample, rules, sample_rows)
    return (
        base_measures(docs, text)
        .withColumns({"base_failed": base_failed(), "rejected_by": verdict(rules)})
        .withColumn("kept", F.col("rejected_by").isNull())
    )


def keep_good(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` without the rejected rows; columns as given."""
    held = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_judged"))
    judged = cascade(held, "_judged", default_rules("_judged") if rules is None else rules)
    # A row number keeps the filter above the measures; pushed below, it would repeat them in every rule.
    numbered = judged.select("_row", "kept", F.monotonically_increasing_id().alias("_at"))
    return numbered.where(F.col("kept") & (F.col("_at") >= 0)).select(*[F.col("_row")[c].alias(c) for c in docs.columns])
