"""Removal of repeated byte strings by a suffix array over anchors.

A byte goes if a string of ``LENGTH`` bytes around it starts anywhere else as well. All byte suffixes of a corpus
are too many rows, so the sampled suffixes are anchors: the places whose 16 bytes hash smallest among ``W``
neighbours. Equal strings of ``LENGTH`` bytes have an anchor in common, at the same distance ``W - 1 .. 2 W - 2``
from their start; a start belongs to its first such anchor.

1. An anchor's core (the bytes common to all starts that belong to it) must repeat, else none of them does. Cores
   are counted as hashes; what is left are the candidates, about as many as repeated bytes / 30.
2. Runs of candidates are strings of cores and the steps between them. Their suffixes are sorted by the difference-cover
   algorithm, ``DEPTH`` cores deep, and adjacent ones are compared. Where the suffix that begins one anchor earlier shares
   cores with one beside it that reach to the end of the anchor's last string, all its strings repeat: the order settles it.
3. The remaining suffixes are starts of anchors with their core in a suffix beside them that are not settled (the first and the
   last ones of a repeated passage, mostly). They are merged with those of one settled anchor for each sequence of cores: their
   strings of ``LENGTH`` bytes are compared by 64 bits of a digest (128 do not fit the disk limit).

Equal whole texts are one text; a text of ``LENGTH`` bytes or more with a copy goes entirely. Whole texts are compared by
128-bit digests, settled strings by a hash of three or more cores in a row, of the suffixes beside each other only.

Defined results: null texts are empty; shorter texts lose nothing; rows with equal ids are documents of their own;
an empty table gives an empty table.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from xxhash import xxh3_64_digest

from querysieve.llm.difference_cover import suffix_ranks
from querysieve.llm.workers import tidied
from querysieve.operators.ordering import BLOCK, range_blocks
from querysieve.session import broadcast_if_small, drop_written, materialise, ship, written

LENGTH, W, K = 200, 60, 16
# Anchors to compare: LENGTH bytes hold about LENGTH / 30. Suffixes whose cores do not reach far enough meet in step 3.
DEPTH = 9
CHUNK_BYTES = 1 << 18
SIDE_ROWS, SIDE_BYTES = 3_000_000, 256 * 1024 * 1024
_NONE = np.zeros(0, np.int64)
_ODD = 0x9E3779B97F4A7C15
_C1, _C2, _C3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C1
    x = (x ^ (x >> np.uint64(29))) * _C2
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def _bytes_table() -> np.ndarray:
    return _mix(np.arange(1, 257, dtype=np.uint64) * _C3)


@lru_cache(maxsize=4)
def _powers(size: int, odd: int) -> np.ndarray:
    out = np.ones(size, np.uint64)
    done = 1
    while done < size:
        step = min(done, size - done)
        out[done:done + step] = out[:step] * np.uint64(pow(odd, done, 1 << 64))
        done += step
    return out


def forget() -> None:
    """Empty the tables of powers."""
    _powers.cache_clear()


def _room(n: int) -> int:
    return 1 << max(12, n.bit_length())


class Rolling:
    """Hashes of any byte range of a text."""

    def __init__(self, raw: np.ndarray):
        size = _room(len(raw))
        self.up, down = _powers(size, _ODD), _powers(size, pow(_ODD, -1, 1 << 64))
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_bytes_table()[raw] * down[:len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        value = (self.sums[stop] - self.sums[start]) * self.up[start]
        return _mix(value + (stop - start).astype(np.uint64) * _C3)


def anchor_windows(text: bytes) -> np.ndarray:
    """Of every run of ``W`` places the one whose ``K`` bytes hash smallest; the last one on ties."""
    n = len(text) - K + 1
    eight = np.zeros(len(text) - 7, np.uint64)
    for k in range(8):
        eight[k::8] = np.frombuffer(text, "<u8", len(eight[k::8]), k)
    held = _mix(eight[:n] * _C3 + eight[8:8 + n] * _C1)
    key = (held & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    span = 1
    while 2 * span <= W:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < W:
        key = np.minimum(key[:span - W], key[W - span:])
    return (np.uint64(0xFFFFFFFF) - (key & np.uint64(0xFFFFFFFF))).astype(np.int64)


def anchors(texts: list[bytes]):
    """``(text, ordinal, place, core hash, first start, last start)`` arrays of the anchors of several texts that have starts.

    The texts lie one behind the other; runs of places that reach into the next text are left out.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    raw = b"".join(texts)
    if (sizes >= LENGTH).sum() == 0:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    runs = np.where(sizes >= LENGTH, sizes - K - W + 2, 0)
    places = anchor_windows(raw)
    # A run begins a new anchor where its place is another one than before, and at the begin of a text.
    new = np.append(True, places[1:] != places[:-1])
    new[begin[runs > 0]] = True
    run = np.flatnonzero(new)
    text = np.searchsorted(begin, run, side="right") - 1
    inside = run - begin[text] < runs[text]
    text, at = text[inside], places[run[inside]] - begin[text[inside]]
    opens = np.concatenate([[True], text[1:] != text[:-1]])
    ordinal = np.arange(len(text)) - np.flatnonzero(opens)[np.cumsum(opens) - 1]
    before = np.where(opens, -1, np.concatenate([[-1], at[:-1]]))
    first = np.maximum(before + 1 - (W - 1), 0)
    last = np.minimum(at - (W - 1), sizes[text] - LENGTH)
    own = np.flatnonzero(first <= last)
    text, ordinal, at, first, last = text[own], ordinal[own], at[own], first[own], last[own]
    middle = begin[text] + at
    core = Rolling(np.frombuffer(raw, np.uint8)).of(middle - (W - 1), middle - 2 * (W - 1) + LENGTH)
    return text, ordinal, at, (core >> np.uint64(1)).astype(np.int64), first, last


def keep_bytes(text: bytes, lows: np.ndarray, highs: np.ndarray, characters: bool = False) -> tuple[bytes, int]:
    """What is left without the strings that start in the given ranges, and the number of removed runs.

    ``characters``: a character that loses a byte goes whole, so UTF-8 stays UTF-8.
    """
    size = len(text) + 1
    change = np.bincount(lows, minlength=size) - np.bincount(np.minimum(highs + LENGTH, len(text)), minlength=size)
    gone = np.cumsum(change[:-1]) > 0
    if characters and len(text):
        place = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
        gone = (np.bincount(place, gone) > 0)[place]
    runs = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), runs


def _texts(batch: pa.RecordBatch, column: int):
    return (v.as_py() or b"" for v in batch.column(column).cast(pa.binary()))


def _fields(ranges: pa.ListScalar, *names: str) -> list[np.ndarray]:
    """The fields of a list of structs as arrays."""
    held = ranges.values
    return [held.field(name).to_numpy(zero_copy_only=False) for name in names]


def _chunks(batches):
    """Keys and texts, about ``CHUNK_BYTES`` at a time."""
    for batch in batches:
        keys, texts, size = [], [], 0
        for key, text in zip(batch.column(0).to_pylist(), _texts(batch, 1)):
            keys.append(key)
            texts.append(text)
            size += len(text)
            if size >= CHUNK_BYTES:
                yield keys, texts
                keys, texts, size = [], [], 0
        if texts:
            yield keys, texts


def _cores(texts: DataFrame) -> DataFrame:
    def emit(batches):
        for _, held in _chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(anchors(held)[3])], names=["core"])

    return texts.mapInArrow(tidied(emit, forget), "core bigint")


def _anchor_rows(texts: DataFrame) -> DataFrame:
    names = ["key", "ordinal", "at", "core", "first", "last"]

    def emit(batches):
        for keys, held in _chunks(batches):
            text, *columns = anchors(held)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()).take(pa.array(text)), *map(pa.array, columns)], names=names)

    return texts.mapInArrow(tidied(emit, forget), "key binary, ordinal bigint, at bigint, core bigint, first bigint, last bigint")


def _start_digests(asked: DataFrame) -> DataFrame:
    """``n, start, string, settled`` for all starts of the listed ranges of texts ``n``; ``string`` is a digest of the bytes."""
    names = ["n", "start", "string", "settled"]

    def emit(batches):
        for batch in batches:
            for n, text, ranges in zip(batch.column(0).to_pylist(), _texts(batch, 1), batch.column(2)):
                first, last, settled = _fields(ranges, "first", "last", "settled")
                each = last - first + 1
                start = np.arange(each.sum()) + np.repeat(first - np.cumsum(each) + each, each)
                done = np.repeat(settled, each)
                for at in range(0, len(start), 50_000):
                    part = start[at:at + 50_000].tolist()
                    digests = b"".join([xxh3_64_digest(text[i:i + LENGTH]) for i in part])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), n, np.int64)), pa.array(part), pa.array(np.frombuffer(digests, "<i8")), pa.array(done[at:at + 50_000])], names=names
                    )

    return asked.mapInArrow(tidied(emit), "n bigint, start bigint, string bigint, settled boolean")


def beside(rows: DataFrame, order: list[str], column: str) -> DataFrame:
    """``rows`` with ``_before`` and ``_after``: ``column`` of the rows beside each in the order.

    Sorted ranges look inside themselves; one row per range carries its ends to the next ones.
    """
    held = range_blocks(rows, [F.col(c) for c in order])
    inside, across = Window.partitionBy(BLOCK).orderBy(*order), Window.orderBy(BLOCK)
    place = F.struct(*order)
    ends = held.groupBy(BLOCK).agg(F.min_by(column, place).alias("_low"), F.max_by(column, place).alias("_high"))
    ends = ends.select(BLOCK, F.lag("_high").over(across).alias("_earlier"), F.lead("_low").over(across).alias("_later"))
    looked = held.withColumns({"_lag": F.lag(column).over(inside), "_lead": F.lead(column).over(inside)})
    return looked.join(F.broadcast(ends), BLOCK).select(
        *rows.columns, F.coalesce("_lag", "_earlier").alias("_before"), F.coalesce("_lead", "_later").alias("_after")
    )


def _by_keys(batches):
    """Tables of rows that come in the order of their first column; rows of one value lie in one table."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0)
        if not held or keys[-1] != held[0].column(0)[0]:
            change = np.flatnonzero(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False))
            cut = int(change[-1]) + 1 if len(change) else 0
            if held or cut:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held, batch = [], batch.slice(cut)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def suffix_columns(new: np.ndarray, at: np.ndarray, core: np.ndarray, depth: int):
    """``(place in its run, symbol, the next two symbols, name, has a name)`` of candidates; ``new`` marks where runs begin.

    A name covers the cores, and the steps between them, that reach to the end of the last string of the next anchor.
    """
    row, opens = np.arange(len(at)), np.flatnonzero(new)
    run = np.cumsum(new) - 1
    left = np.append(opens[1:], len(at))[run] - row
    behind = lambda values, k, other: np.where(left > k, np.append(values[k:], np.zeros(min(k, len(values)), values.dtype)), other)
    far = behind(at, 1, 0) + (W - 1)
    going, has, name = left > 1, np.zeros(len(at), bool), np.zeros(len(at), np.uint64)
    for k in range(depth):
        going &= left > k
        place = behind(at, k, 0)
        more = _mix(name * _C1 + behind(core, k, 0).astype(np.uint64) * _C3 + (place - at).astype(np.uint64))
        name = np.where(going, more, name)
        has |= going & (place >= far)
        going &= ~has
    # A core and behind it its step, so suffixes that share only their first core stand together too.
    symbol = core >> 7 << 7 | np.where(left > 1, behind(at, 1, 0) - at, 127)
    return row - opens[run], symbol, behind(symbol, 1, -1), behind(symbol, 2, -1), name.view(np.int64), has


def _strings(found: DataFrame, depth: int) -> DataFrame:
    """Candidates whose ordinals follow each other, as strings numbered in the order of their places."""
    types = "key binary, at bigint, core bigint, first bigint, last bigint, sid bigint, i bigint, s bigint, t1 bigint, t2 bigint, own bigint"
    names = [field.split()[0] for field in types.split(", ")]

    def emit(batches):
        number = TaskContext.get().partitionId() << 33
        for rows in _by_keys(batches):
            key = rows.column(0).combine_chunks()
            ordinal, at, core, first, last = (c.to_numpy() for c in rows.columns[1:])
            new = np.append(True, np.diff(ordinal) != 1)
            new[1:] |= pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)
            place, s, t1, t2, own, has = suffix_columns(new, at, core, depth)
            sid = number + np.arange(len(at)) - place
            number += len(at)
            yield pa.RecordBatch.from_arrays(
                [key, *map(pa.array, (at, core, first, last, sid, place, s, t1, t2)), pa.array(own, mask=~has)], names=names
            )

    ordered = found.select("key", "ordinal", "at", "core", "first", "last").repartition("key").sortWithinPartitions("key", "ordinal")
    return ordered.mapInArrow(tidied(emit), types)


def settled_anchors(found: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``found`` (key, ordinal, at, core, first, last) with ``settled``, ``met`` and ``name``.

    A suffix's name is a digest of the cores, and the steps between them, that cover all strings of the anchor behind
    its first one. ``settled``: a suffix beside that of the anchor before, in the sorted order, begins with the same cores.
    ``met``: a suffix beside the anchor's own begins with its core; other anchors have nothing to be compared with.
    """
    spark, since = found.sparkSession, written()
    strings = materialise(_strings(found, depth), "runs")
    ranked = suffix_ranks(strings.select("sid", "i", "s", "t1", "t2"), depth)
    begins = strings.select("sid", "i", F.struct(F.hash("core").alias("core"), F.col("own").alias("name")).alias("own"))
    sorted_rows = ranked.join(begins, ["sid", "i"]).select("rank", "sid", "i", "own")
    looked = beside(sorted_rows, ["rank", "sid", "i"], "own")
    either = lambda c: F.coalesce(F.col("_before")[c] == F.col("own")[c], F.lit(False)) | F.coalesce(F.col("_after")[c] == F.col("own")[c], F.lit(False))
    looked = materialise(looked.select("sid", "i", either("name").alias("shared"), either("core").alias("met"), F.col("own.name").alias("name")), "beside")
    drop_written(spark, since, strings, looked)

    earlier = looked.where("shared").select("sid", (F.col("i") + 1).alias("i"), F.lit(True).alias("settled"), "name")
    marks = looked.select("sid", "i", "met").join(earlier, ["sid", "i"], "left")
    marked = strings.join(marks, ["sid", "i"]).select(
        "key", "at", "core", "first", "last", "met", F.coalesce("settled", F.lit(False)).alias("settled"), "name"
    )
    marked = materialise(marked, "marked")
    drop_written(spark, since, marked)
    return marked


def repeated_ranges(texts: DataFrame, copied: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``key, ranges, starts``: the starts whose strings repeat, as ranges and one by one, for distinct texts (key, text).

    ``copied`` lists the keys of texts with equal copies: all of their starts repeat, so these texts are left out.
    """
    since = written()
    cores = _cores(texts).groupBy("core").agg(F.count("*").alias("c")).where(F.col("c") > 1).select("core")
    side = broadcast_if_small(cores, SIDE_ROWS, SIDE_BYTES)
    found = materialise(_anchor_rows(texts).join(side, "core", "left_semi"), "anchors")
    marked = settled_anchors(found, depth)
    drop_written(texts.sparkSession, since, marked)
    whole = marked.join(copied.withColumn("whole", F.lit(True)), "key", "left").withColumn("whole", F.coalesce("whole", F.lit(False)))
    still = whole.where(F.col("met") & ~F.col("settled") & ~F.col("whole"))
    classes = still.select("core").distinct()
    # Of the anchors whose strings all repeat one for each name is enough to meet, added up before cores meet: a common
    # core has many anchors. Those of copied texts that the order leaves open stand for themselves.
    reach = [F.col("core"), F.col("name"), (F.col("at") - F.col("first")).alias("reach")]
    settled = whole.where(F.col("settled")).groupBy(*reach).agg(F.min(F.struct("key", "first", "last")).alias("one")).select("core", "one.*")
    open_copies = whole.where(F.col("met") & F.col("whole") & ~F.col("settled")).select("core", "key", "first", "last")
    partners = settled.unionByName(open_copies).join(classes, "core", "left_semi").select("key", "first", "last", F.lit(True).alias("settled"))
    members = still.select("key", "first", "last", "settled").unionByName(partners)
    wanted = members.groupBy("key").agg(F.collect_list(F.struct("first", "last", "settled")).alias("ranges"))
    # A start travels with its text's number, which takes less room than the key.
    wanted = materialise(wanted.withColumn("n", F.monotonically_increasing_id()), "wanted")
    listed = broadcast_if_small(wanted.select("key"), SIDE_ROWS, SIDE_BYTES)
    asked = texts.join(listed, "key", "left_semi").join(wanted, "key")
    starts = materialise(_start_digests(asked.select("n", "text", "ranges")), "starts")
    twice = starts.groupBy("string").agg(F.count("*").alias("c")).where(F.col("c") > 1).select("string")
    late = starts.where(~F.col("settled")).join(twice, "string", "left_semi").groupBy("n").agg(F.collect_list("start").alias("starts"))
    ranges = whole.where(F.col("settled") & ~F.col("whole")).groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    return ranges.join(late.join(wanted.select("n", "key"), "n").select("key", "starts"), "key", "full")


def cut_repeats(
    docs: DataFrame, depth: int = DEPTH, columns: tuple[str, ...] = ("doc_id",), characters: bool = False
) -> DataFrame:
    """``columns, n_bytes, n_removed, n_spans, kept`` (the remaining bytes) of every document."""
    ship(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(*columns, text.alias("text"), F.unhex(F.md5(text)).alias("key"))
    narrow = docs.select("doc_id", text.alias("text"), F.unhex(F.md5(text)).alias("key"))
    long = narrow.where(F.octet_length("text") >= LENGTH)
    ids = materialise(long.select("doc_id", "key"), "keys")
    firsts = ids.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("many"))
    copied = materialise(firsts.where(F.col("many") > 1), "copied")
    # Later copies, by key and id; rows that share both stay and belong to a copied text anyway.
    later = ids.join(copied, "key").where(F.col("doc_id") > F.col("first_id")).select("key", "doc_id").distinct()
    skip = broadcast_if_small(later, SIDE_ROWS, SIDE_BYTES)
    texts = long.join(skip, ["key", "doc_id"], "left_anti").select("key", "text")

    # A copied text has neither ranges nor starts: all of it goes.
    marks = repeated_ranges(texts, copied.select("key"), depth).unionByName(copied.select("key"), allowMissingColumns=True)
    marks = materialise(marks, "marks")
    listed = broadcast_if_small(marks.select("key"), SIDE_ROWS, SIDE_BYTES)
    n_bytes = F.octet_length("text").cast("bigint")
    zero = F.lit(0).cast("bigint")
    clean = keyed.join(listed, "key", "left_anti").select(
        *columns, n_bytes.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").cast("binary").alias("kept")
    )
    cut = keyed.join(listed, "key", "left_semi").join(marks, "key").select(*columns, "text", "ranges", "starts")
    n_columns = len(columns)

    def remove(batches):
        for batch in batches:
            sizes, gone, spans, left = [], [], [], []
            for value, ranges, starts in zip(_texts(batch, n_columns), *batch.columns[n_columns + 1:]):
                if not ranges.is_valid and not starts.is_valid:
                    rest, runs = b"", 1
                else:
                    first, last = _fields(ranges, "first", "last") if ranges.is_valid else (_NONE, _NONE)
                    alone = starts.values.to_numpy(zero_copy_only=False) if starts.is_valid else _NONE
                    rest, runs = keep_bytes(value, np.append(first, alone), np.append(last, alone), characters)
                sizes.append(len(value))
                gone.append(len(value) - len(rest))
                spans.append(runs)
                left.append(rest)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(n_columns)), *(pa.array(c, pa.int64()) for c in (sizes, gone, spans)),
                 pa.array(left, pa.binary())],
                names=[*columns, "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return clean.unionByName(cut.mapInArrow(tidied(remove), clean.schema))


def dedup_digests(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    return cut_repeats(docs, depth).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``docs`` with its texts cut (whole characters), columns as given; ``n_chars`` follows the text where present."""
    rest = F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("_row")
    cut = cut_repeats(docs.select(rest, "doc_id", "text"), depth, ("_row",), characters=True)
    text = F.col("kept").cast("string")
    made = {"text": text} | ({"n_chars": F.length(text).cast("bigint")} if "n_chars" in docs.columns else {})
    return cut.select(*[made.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
