"""License notices: exact phrases, and an exact set-similarity join of text blocks with notice templates.

Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z folded. Base phrases are looked up word by
word. Beside them every block of a text is joined with the templates on containment, ``|block & template| /
|template|`` of distinct words:

1. The words of the templates are counted over all documents and ordered by that count, rare ones first.
2. A template of up to ``S = 2^k`` words meets blocks of ``2 S`` words that begin at every multiple of ``S``, so a
   notice lies whole in some block. A block keeps its template words in the global order. Blocks with fewer of them
   than the least overlap of their size class go at once (length filter).
3. A template that is met shares a word inside both prefixes: prefixes are joined on (class, word), pairs whose
   positions leave too few words are dropped, and what is left is compared by whole sets.

Nothing is approximate: the filters drop no block that meets the threshold. The templates are a parameter, a list that
the caller holds, so their index is small beside any text. Defined results: null and empty texts have no words, null
places, empty label strings and score 0; rows with equal ids stay rows of their own; only (doc_id, text) are read, so
extra columns cannot clash; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, functions as F

from querysieve.session import materialise, ship

# Phrase and label.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

# Label and notice, as licenses publish them.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
PERCENT = 85

CHUNK_WORDS = 400_000
_SPACES = bytes(i if i >= 0x80 or chr(i).isalnum() else 0x20 for i in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().translate(_SPACES).split() if text else []


def needed(size: int, percent: int) -> int:
    """Words a block must share with a template of ``size`` distinct words."""
    return max(1, -(-percent * size // 100))


class Templates:
    """Templates as sets of word numbers in the global order, by size class."""

    def __init__(self, templates: list[tuple[str, str]], percent: int):
        self.held = [(label, words_of(text.encode())) for label, text in templates]
        self.held = [(label, words) for label, words in self.held if words]
        self.percent = percent
        self.vocabulary = sorted({w for _, words in self.held for w in words})

    def span(self, words: list[bytes]) -> int:
        return 1 << (len(words) - 1).bit_length()

    def ordered(self, counts: dict[bytes, int]) -> tuple[dict[bytes, int], list[Row]]:
        """Word -> place in the order (rare words first), and one row per template."""
        place = {w: i for i, w in enumerate(sorted(self.vocabulary, key=lambda w: (counts.get(w, 0), w)))}
        rows = []
        for number, (label, words) in enumerate(self.held):
            tokens = sorted({place[w] for w in words})
            rows.append(Row(template=number, label=label, span=self.span(words), tokens=tokens, least=needed(len(tokens), self.percent)))
        return place, rows


TEMPLATE = "template int, label string, span int, tokens array<int>, least int"


def word_counts(docs: DataFrame, vocabulary: list[bytes]) -> dict[bytes, int]:
    """In how many of all documents each word of the templates stands."""
    known = frozenset(vocabulary)

    def count(batches):
        found = Counter()
        for batch in batches:
            for value in batch.column(0).cast(pa.binary()):
                found.update(known.intersection(words_of(value.as_py())))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"]
        )

    counted = docs.select("text").mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in counted.collect()}


def blocks_of(owner: np.ndarray, at: np.ndarray, token: np.ndarray, span: int, least: int):
    """``(owner, tokens)`` of the blocks with ``least`` distinct tokens; entries are template words of texts at places."""
    half = at // span
    owner, half, token = np.concatenate([owner, owner]), np.concatenate([half, half - 1]), np.concatenate([token, token])
    own = half >= 0
    order = np.lexsort((token[own], half[own], owner[own]))
    owner, half, token = owner[own][order], half[own][order], token[own][order]
    block = np.concatenate([[True], (owner[1:] != owner[:-1]) | (half[1:] != half[:-1])]) if len(owner) else np.zeros(0, bool)
    fresh = block.copy()
    fresh[1:] |= token[1:] != token[:-1]
    number = np.cumsum(block)[fresh] - 1
    owner, token = owner[fresh], token[fresh]
    sizes = np.bincount(number) if len(number) else np.zeros(0, np.int64)
    stops = np.cumsum(sizes)
    for k in np.flatnonzero(sizes >= least):
        yield int(owner[stops[k] - 1]), token[stops[k] - sizes[k]:stops[k]]


def _measured(docs: DataFrame, place: dict[bytes, int], rows: list[Row], phrases: list[tuple[str, str]]) -> DataFrame:
    """One written row per document: its base columns and its blocks that pass the length filter."""
    sought = [([w.encode() for w in phrase.split()], label) for phrase, label in phrases]
    spans = {span: min(r.least for r in rows if r.span == span) for span in sorted({r.span for r in rows})}
    in_class = {span: np.array(sorted({t for r in rows if r.span == span for t in r.tokens})) for span in spans}
    # Words of phrases only come behind the templates' words.
    numbers = dict(place)
    for phrase, _ in sought:
        for word in phrase:
            numbers.setdefault(word, len(numbers))
    coded = [([numbers[w] for w in phrase], label) for phrase, label in sought]
    names = ["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "blocks"]
    kind = pa.list_(pa.struct([("span", pa.int32()), ("tokens", pa.list_(pa.int32()))]))

    def judge(ids: list, texts: list[list[bytes]], row: int) -> pa.RecordBatch:
        sizes = np.array([len(t) for t in texts])
        get = numbers.get
        codes = np.fromiter((get(w, -1) for words in texts for w in words), np.int64, int(sizes.sum()))
        begin = np.cumsum(sizes) - sizes
        found = [[] for _ in texts]
        for phrase, label in coded:
            spots = np.flatnonzero(codes == phrase[0])
            for k, code in enumerate(phrase[1:], 1):
                spots = spots[spots + k < len(codes)]
                spots = spots[codes[spots + k] == code]
            owner = np.searchsorted(begin, spots, "right") - 1
            # A phrase ends inside the text it begins in.
            for text, spot in zip(owner, spots):
                if spot + len(phrase) <= begin[text] + sizes[text]:
                    found[text].append((int(spot - begin[text]), label))
        blocks = [[] for _ in texts]
        for span, least in spans.items():
            spots = np.flatnonzero(np.isin(codes, in_class[span]))
            owner = np.searchsorted(begin, spots, "right") - 1
            for text, tokens in blocks_of(owner, spots - begin[owner], codes[spots], span, least):
                blocks[text].append({"span": span, "tokens": tokens.tolist()})
        starts = [[spot for spot, _ in each] for each in found]
        columns = [
            pa.array(range(row, row + len(texts)), pa.int64()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
            pa.array([len(s) for s in starts], pa.int64()), pa.array([min(s, default=None) for s in starts], pa.int64()),
            pa.array([max(s, default=None) for s in starts], pa.int64()),
            pa.array([sorted({label for _, label in each}) for each in found], pa.list_(pa.string())), pa.array(blocks, kind),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def measure(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, texts, held = [], [], 0
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                ids.append(doc)
                texts.append(words_of(value.as_py()))
                held += len(texts[-1])
                if held >= CHUNK_WORDS:
                    yield judge(ids, texts, row)
                    row, ids, texts, held = row + len(ids), [], [], 0
            if ids:
                yield judge(ids, texts, row)
                row += len(ids)

    schema = (
        "row bigint, doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
        "base_labels array<string>, blocks array<struct<span:int,tokens:array<int>>>"
    )
    return materialise(docs.mapInArrow(measure, schema), "license-blocks")


def matches(measured: DataFrame, rows: list[Row]) -> DataFrame:
    """``row, label, score`` of every block and template with enough words in common."""
    spark = measured.sparkSession
    templates = spark.createDataFrame(rows, TEMPLATE)
    index = templates.select(
        "span", "template", "least", F.size("tokens").alias("size"), F.col("tokens").alias("wanted"), "label",
        F.posexplode(F.slice("tokens", F.lit(1), F.size("tokens") - F.col("least") + 1)).alias("place", "token"),
    )
    least = templates.groupBy("span").agg(F.min("least").alias("class_least"))
    blocks = measured.select("row", F.explode("blocks").alias("b")).select("row", "b.span", "b.tokens").join(F.broadcast(least), "span")
    probes = blocks.select(
        "row", "span", "tokens",
        F.posexplode(F.slice("tokens", F.lit(1), F.size("tokens") - F.col("class_least") + 1)).alias("at", "token"),
    )
    # Words that can still meet behind the two places bound the overlap.
    left = F.least(F.col("size") - F.col("place"), F.size("tokens") - F.col("at"))
    met = probes.join(F.broadcast(index), ["span", "token"]).where((F.size("tokens") >= F.col("least")) & (left >= F.col("least")))
    shared = F.size(F.array_intersect("tokens", "wanted"))
    checked = met.withColumn("shared", shared).where(F.col("shared") >= F.col("least"))
    return checked.select("row", "label", (F.col("shared") / F.col("size")).alias("score"))


def scan(
    docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, percent: int = PERCENT
) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every (doc_id, text).

    ``score`` is 1 with a base phrase, else the largest containment met, else 0.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    known = Templates(templates, percent)
    place, rows = known.ordered(word_counts(docs, known.vocabulary))
    measured = _measured(docs, place, rows, phrases)
    found = matches(measured, rows).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    joined = measured.drop("blocks").join(found, "row", "left")
    every = F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
