"""Spelling variants: words one edit apart, found among the sorted rotations of terminator-marked words.

A word ``x c y`` marked with ``$`` has the rotation ``y $ x c``. Without its last character it is the prefix that every
word shares with it that has another character there (``y $ x d``) or none (``y $ x``, itself a rotation of ``x y $``).
So each rotation goes to the group of its prefix, skipping the character it ends in, and whole rotations go to the group
of their own string; two words are in one group exactly if they are one replacement or one indel apart.

1. Words are counted over all texts, added up inside tasks before the shuffle.
2. Rotations are shuffled by group and sorted in it, the most frequent words first. A group holds one word for each
   character and one without, so it is bounded by the alphabet. A scan gives every member the number of its neighbours
   and the best of them (the group's first, or second for the first itself): rows grow with words, never with pairs.
3. A character repeated beside itself can be left out in several places with one result; only its first place counts.

Words longer than ``SPELLED`` code points name their groups by digests of ``x`` and ``y`` and go by a short name (their
beginning and their place among the long words), so the rotations of a word take room in proportion to its length.

Defined results: null texts have no words; the id of a row without one is written ``null`` where it makes a draw; rows
with equal ids are documents of their own; only (doc_id, text) are read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from querysieve.operators.ordering import global_index
from querysieve.session import broadcast_if_small, materialise, ship

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_FOLD = {i: i + 32 for i in range(65, 91)}
EVERY = 97  # one run of so many loses a character
MIN_LENGTH, MIN_COUNT, RATIO = 5, 3, 2
SPELLED = 256
# Characters of different words that a task holds before it passes their counts on.
HELD_CHARS = 16_000_000


def altered(doc: int | None, text: str | None, every: int = EVERY) -> Counter:
    """Runs of letters and their counts, some runs without one character as ``crc32("<doc>:<run>")`` says."""
    runs = Counter(RUN.findall(text.translate(_FOLD) if text else ""))
    head, out = zlib.crc32(f"{'null' if doc is None else doc}:".encode()), Counter()
    for run, times in runs.items():
        draw = zlib.crc32(run.encode(), head)
        if draw % every == 0:
            gone = draw % len(run)
            run = run[:gone] + run[gone + 1:]
        out[run] += times
    return out


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, every: int = EVERY) -> DataFrame:
    """``word, n`` of the words long and frequent enough."""

    def count(batches):
        found, held = Counter(), 0

        def batch_of():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"]
            )

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                runs = altered(doc, text.as_py(), every)
                for run, times in runs.items():
                    if len(run) >= min_length:
                        if run not in found:
                            held += len(run) + 100
                        found[run] += times
                if held >= HELD_CHARS:
                    yield batch_of()
                    found, held = Counter(), 0
        if found:
            yield batch_of()

    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    counted = docs.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= min_count)


def _digests(text: str) -> list[bytes]:
    """Digests of all beginnings of ``text``, the empty one first."""
    held = hashlib.blake2b(digest_size=16)
    out = [held.digest()]
    for character in text:
        held.update(character.encode())
        out.append(held.digest())
    return out


def long_rotations(words: DataFrame) -> DataFrame:
    """Groups of words (name, word, n) beyond ``SPELLED``, named by digests."""

    def rotate(batches):
        for batch in batches:
            for name, word, n in zip(*(batch.column(c).to_pylist() for c in range(3))):
                head, tail, last = _digests(word), _digests(word[::-1])[::-1], len(word)
                whole = ((head[i], tail[i], False, False) for i in range(last + 1))
                members = chain(whole, ((head[i], tail[i + 1], True, word[i] != word[i - 1:i]) for i in range(last)))
                while part := list(islice(members, 20_000)):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([f"{tail.hex()}${head.hex()}" for head, tail, *_ in part]),
                            pa.array([name] * len(part)), pa.array([n] * len(part)),
                            pa.array([skips for *_, skips, _ in part]), pa.array([first for *_, first in part]),
                            pa.array([last] * len(part)),
                        ],
                        names=["at", "name", "n", "skips", "first", "size"],
                    )

    return words.mapInArrow(rotate, "at string, name string, n bigint, skips boolean, first boolean, size bigint")


def named(words: DataFrame, spelled: int = SPELLED) -> DataFrame:
    """``words`` with ``name``: the word, or for a long one its beginning and its place among the long words.

    Names of words that are near each other sort as the words do.
    """
    long = global_index(words.where(F.length("word") > spelled), [F.col("word")], "_place")
    name = F.concat(F.substring("word", 1, spelled), F.lit("#"), F.lpad(F.col("_place").cast("string"), 20, "0"))
    return words.where(F.length("word") <= spelled).withColumn("name", F.col("word")).unionByName(
        long.withColumn("name", name).drop("_place")
    )


def rotations(words: DataFrame, spelled: int = SPELLED) -> DataFrame:
    """``at, name, n, skips, first``: the groups of each word (name, word, n).

    A group's name is a rotation: of the word itself, or with a character left out (``skips``; ``first`` if the
    character before it is another one). Names of up to ``spelled`` letters are spelled out, longer ones are digests;
    a word of ``spelled + 1`` letters takes part in both kinds.
    """
    size = F.length("word")
    place = F.col("_i")
    before, here = F.substring("word", F.lit(1), place), F.substring("word", place + 1, F.lit(1))
    spell = lambda rest: F.concat(F.substring("word", rest, size), F.lit("$"), before)
    spots = words.withColumn("_i", F.explode(F.sequence(F.lit(0), size)))
    whole = F.when(size <= spelled, F.struct(
        spell(place + 1).alias("at"), F.lit(False).alias("skips"), F.lit(False).alias("first")))
    skipping = F.when(place < size, F.struct(
        spell(place + 2).alias("at"), F.lit(True).alias("skips"),
        ((place == 0) | (here != F.substring("word", place, F.lit(1)))).alias("first")))
    short = spots.where(size <= spelled).select("name", "n", F.explode(F.array(whole, skipping)).alias("m"))
    short = short.where(F.col("m").isNotNull()).select("m.at", "name", "n", "m.skips", "m.first")
    # The words just beyond the bound meet the longest spelled ones under spelled names.
    border = spots.where(size == spelled + 1).where(place < size).select(
        skipping["at"].alias("at"), "name", "n", F.lit(True).alias("skips"), skipping["first"].alias("first"))
    beyond = long_rotations(words.where(size > spelled).select("name", "word", "n"))
    beyond = beyond.where(~F.col("skips") | (F.col("size") > spelled + 1)).drop("size")
    return short.unionByName(border).unionByName(beyond)


def neighbours(words: DataFrame, spelled: int = SPELLED) -> DataFrame:
    """``name, n_near, best`` (struct of minus n and name) of every word that is near another."""
    members = rotations(words, spelled)
    group = Window.partitionBy("at")
    order = group.orderBy(F.desc("n"), "name").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = F.struct((-F.col("n")).alias("minus_n"), F.col("name").alias("near"))
    scanned = members.withColumns({
        "_members": F.count(F.lit(1)).over(order),
        "_skips": F.count_if("skips").over(order),
        "_firsts": F.count_if("first").over(order),
        "_one": F.first(best).over(order),
        "_two": F.nth_value(best, 2).over(order),
    }).where(F.col("_members") > 1)
    has_whole = F.col("_members") - F.col("_skips")
    near = F.when(F.col("skips"), F.col("_skips") - 1 + F.when(F.col("first"), has_whole).otherwise(0)).otherwise(F.col("_firsts"))
    other = F.when(F.col("_one.near") == F.col("name"), F.col("_two")).otherwise(F.col("_one"))
    return scanned.select("name", near.alias("near"), other.alias("best")).groupBy("name").agg(
        F.sum("near").alias("n_near"), F.min("best").alias("best")
    )


def roots(forms: DataFrame) -> DataFrame:
    """``name, root`` for ``name, form``: forms followed to the last one, twice as far each round."""
    at = materialise(forms.where(F.col("form").isNotNull()).select("name", F.col("form").alias("root")), "roots")
    while True:
        onward = at.select(F.col("name").alias("root"), F.col("root").alias("_far"))
        step = at.join(onward, "root", "left").select("name", F.coalesce("_far", "root").alias("root"), F.col("_far").isNotNull().alias("moved"))
        step = materialise(step, "roots")
        at = step.select("name", "root")
        if not step.where("moved").limit(1).count():
            return at


def variants(docs: DataFrame, ratio: int = RATIO, every: int = EVERY, spelled: int = SPELLED) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the texts of (doc_id, text).

    ``form``: the most frequent near word (ties: the first in code-point order) if it occurs ``ratio`` times as often.
    """
    ship(docs.sparkSession)
    words = materialise(named(materialise(word_counts(docs, every=every), "words"), spelled), "named")
    near = words.join(neighbours(words, spelled), "name", "left")
    form_n = -F.col("best.minus_n")
    accepted = form_n >= ratio * F.col("n")
    formed = materialise(near.select(
        "name", "word", F.when(accepted, F.col("best.near")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(accepted, form_n).alias("form_n"),
    ), "forms")
    out = formed.join(roots(formed), "name", "left").withColumn("root", F.coalesce("root", "name"))
    long = broadcast_if_small(words.where(F.length("word") > spelled).select(F.col("name").alias("_name"), F.col("word").alias("_word")))
    for column in ("form", "root"):
        out = out.join(long, F.col(column) == F.col("_name"), "left").withColumn(column, F.coalesce("_word", column)).drop("_name", "_word")
    return out.select("word", "form", "root", "n", "n_near", "form_n")
