"""Thirty-two lexical measures of a statement as native column expressions.

Word characters are Unicode letters, numbers and the underscore. Every regular expression
is guarded by a substring test it implies, so most rows never enter the regex engine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Whole-word flags (feature -> word).
WORD_FLAGS = {
    "has_null": "null",
    "has_union": "union",
    "has_exec": "exec",
    "has_exist_keyword": "exists",
    "has_floor": "floor",
    "has_rand": "rand",
    "has_group": "group",
    "has_order": "order",
    "has_length": "length",
    "has_ascii": "ascii",
    "has_concat": "concat",
    "has_if": "if",
    "has_count": "count",
    "has_sleep": "sleep",
}

# Flags set by any whole word of a list.
WORD_SETS = {
    "has_query_keywords": ["select", "update", "drop", "insert", "create"],
    "has_string_functions": ["substr", "substring", "mid", "asc"],
}

# Flags set by any substring of a list.
SUBSTRING_SETS = {
    "has_database_keywords": ["sysobjects", "msysobjects", "version", "information_schema"],
    "has_connection_keywords": ["inner join", "and", "or", "xor"],
    "has_file_keywords": ["load_file", "infile", "outfile", "dumpfile"],
}

# Comparison operators, each counted on its own.
COMPARISONS = ["=", "<", ">", "<=", ">=", "<>", "!="]

# Characters with a digit value outside the decimal digits.
OTHER_DIGITS = (
    "\\x{B2}\\x{B3}\\x{B9}\\x{1369}-\\x{1371}\\x{19DA}\\x{2070}\\x{2074}-\\x{2079}\\x{2080}-\\x{2089}"
    "\\x{2460}-\\x{2468}\\x{2474}-\\x{247C}\\x{2488}-\\x{2490}\\x{24EA}\\x{24F5}-\\x{24FD}\\x{24FF}"
    "\\x{2776}-\\x{277E}\\x{2780}-\\x{2788}\\x{278A}-\\x{2792}\\x{10A40}-\\x{10A43}\\x{10E60}-\\x{10E68}"
    "\\x{11052}-\\x{1105A}\\x{1F100}-\\x{1F10A}"
)
WORD = "\\p{L}\\p{N}_"
# ASCII characters leave each class after one or two cheap tests.
DIGITS = f"[0-9\\x{{80}}-\\x{{10FFFF}}&&[\\p{{Nd}}{OTHER_DIGITS}]]"
UPPER = "[A-Z]|(?![\\x00-\\x7F])\\p{IsUppercase}"
SPACE = "(?U)[\\s\\x1c-\\x1f]"
# Circled, squared and negative capitals count as upper case, not as special characters.
ENCLOSED = "\\x{24B6}-\\x{24CF}\\x{1F130}-\\x{1F149}\\x{1F150}-\\x{1F169}\\x{1F170}-\\x{1F189}"
SPECIAL = f"(?U)[^\\p{{L}}\\p{{N}}\\s\\x1c-\\x1f/*+\\-\\[\\](){{}}{ENCLOSED}]"

ROLLING_PRIME, ROLLING_BASE = 2147483647, 1000003

FEATURES = [
    "len_query", "has_null", "has_comment", "has_query_keywords", "has_union",
    "has_database_keywords", "has_connection_keywords", "has_file_keywords", "has_exec",
    "has_string_functions", "c_comparison", "has_exist_keyword", "has_floor", "has_rand",
    "has_group", "has_order", "has_length", "has_ascii", "has_concat", "has_if", "has_count",
    "has_sleep", "has_tautology", "c_num", "c_upper", "c_space", "c_special", "c_arith",
    "c_square_brackets", "c_round_brackets", "has_multiline_comment", "c_curly_brackets",
]


def _flag(cond: Column) -> Column:
    return cond.cast("int")


def _any(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def has_word(lowered: Column, word: str) -> Column:
    # The literal comes first, so the engine can skip ahead to it.
    return lowered.contains(word) & lowered.rlike(f"{word}(?<![{WORD}]{word})(?![{WORD}])")


def occurrences(text: Column, piece: str) -> Column:
    """Non-overlapping count of ``piece``."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)).cast("int")


def _without_lower_case(text: Column) -> Column:
    """What is left for counts of single characters that are no lower-case letters: a fifth of most texts."""
    return F.regexp_replace(text, "[a-z]+", "")


def _count_chars(text: Column, chars: str) -> Column:
    return reduce(lambda a, b: a + b, [occurrences(text, c) for c in chars])


def _count_class(text: Column, char_class: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, char_class, ""))).cast("int")


def _ends_meet(left: Column, right: Column) -> Column:
    """Some end of ``left`` is a beginning of ``right``."""
    most = F.least(F.length(left), F.length(right))
    characters = F.arrays_zip(
        F.reverse(F.split(F.right(left, most), "")).alias("x"), F.split(F.left(right, most), "").alias("y")
    )
    number = lambda c: F.ascii(c).cast("bigint")
    whole = lambda n: F.lit(n).cast("bigint")

    def step(held: Column, pair: Column) -> Column:
        end = F.pmod(held["end"] + number(pair["x"]) * held["weight"], whole(ROLLING_PRIME))
        begin = F.pmod(held["begin"] * whole(ROLLING_BASE) + number(pair["y"]), whole(ROLLING_PRIME))
        size = held["size"] + 1
        met = held["met"] | ((end == begin) & (F.right(left, size) == F.left(right, size)))
        weight = F.pmod(held["weight"] * whole(ROLLING_BASE), whole(ROLLING_PRIME))
        return F.struct(end.alias("end"), begin.alias("begin"), weight.alias("weight"), size.alias("size"), met.alias("met"))

    start = F.struct(
        whole(0).alias("end"), whole(0).alias("begin"), whole(1).alias("weight"), F.lit(0).alias("size"), F.lit(False).alias("met")
    )
    return F.aggregate(characters, start, step)["met"]


def has_tautology(text: Column) -> Column:
    """Some non-empty run of word characters stands on both sides of an equals sign.

    For each ``left=right`` pair of maximal runs, some suffix of the left run equals a prefix of the right
    run of the same length. One fold over the length keeps a rolling hash of both ends, so the work is linear
    in the runs; ends are compared as text where their hashes agree. Only texts with an equals sign between
    word characters get that far.
    """
    touching = text.rlike(f"=(?<=[{WORD}]=)[{WORD}]")
    pattern = f"(?<![{WORD}])([{WORD}]++)=(?=([{WORD}]+))"
    left = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    right = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    found = F.exists(F.arrays_zip(left.alias("l"), right.alias("r")), lambda p: _ends_meet(p["l"], p["r"]))
    return F.when(text.isNull(), F.lit(None)).when(touching, _flag(found)).otherwise(F.lit(0))


def escape_counts(text: Column) -> dict[str, Column]:
    """Counts of ``\\xHH`` and ``\\uHHHH`` escapes."""
    return {
        "c_hex": F.regexp_count(text, F.lit("\\\\x[0-9a-fA-F]{2}")).cast("int"),
        "c_unicode": F.regexp_count(text, F.lit("\\\\u[0-9a-fA-F]{4}")).cast("int"),
    }


def lexical_features(text: Column) -> dict[str, Column]:
    """All measures of ``text``, keyed by feature name."""
    lowered, rest = F.lower(text), _without_lower_case(text)
    out = {"len_query": F.length(text)}
    out |= {name: _flag(has_word(lowered, word)) for name, word in WORD_FLAGS.items()}
    out |= {name: _flag(_any([has_word(lowered, w) for w in ws])) for name, ws in WORD_SETS.items()}
    out |= {
        name: _flag(_any([lowered.contains(p) for p in parts])) for name, parts in SUBSTRING_SETS.items()
    }
    out["has_comment"] = _flag(lowered.contains("--") | lowered.contains("#"))
    out["c_comparison"] = reduce(
        lambda a, b: a + b, [occurrences(rest if len(op) == 1 else text, op) for op in COMPARISONS]
    )
    out["has_tautology"] = has_tautology(text)
    out["c_num"] = _count_class(rest, DIGITS)
    out["c_upper"] = _count_class(rest, UPPER)
    out["c_space"] = _count_class(rest, SPACE)
    out["c_special"] = _count_class(rest, SPECIAL)
    out["c_arith"] = _count_chars(rest, "/*+-") - occurrences(text, "/*") - occurrences(text, "*/")
    out["c_square_brackets"] = _count_chars(rest, "[]")
    out["c_round_brackets"] = _count_chars(rest, "()")
    out["has_multiline_comment"] = _flag(text.contains("/*") | text.contains("*/"))
    out["c_curly_brackets"] = _count_chars(rest, "{}")
    return {name: out[name] for name in FEATURES}
