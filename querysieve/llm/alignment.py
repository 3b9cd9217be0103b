"""Alignment of two tokenizers by merging their token ends.

Both tokenizers cut the same bytes (a space and the text). Where tokens of A and B end together a group ends; a token of
A and one of B are linked where their byte ranges overlap.

1. Texts are encoded by both libraries. Merging the two sorted lists of ends is cut into pieces of ``WORK`` ends: a
   binary search along the diagonal ``i + j = k`` finds how many ends of A and of B are among the first ``k``, so pieces are
   independent and equal in work however tokens are spread. Most texts are one piece; pieces of longer ones are dealt anew.
2. Each piece merges its ends. Every different end is one link: of the tokens of A and B that hold the byte before it.
   Per document different id pairs are counted, added up in tasks before the shuffle.
3. Pieces are merged again to look the counts up. The commonest ``LISTED`` pairs are a list of that length in every task;
   rows of all other pairs, which are rare, are joined with the table of counts.
4. Groups that a piece boundary cuts are put together: a piece gives the ends of its first group, the text of its whole
   groups and the beginning of its last one.

Defined results: null and empty texts and texts that a tokenizer does not give back byte by byte have no tokens, zeros and
an empty digest; rows with equal ids are documents of their own; only (doc_id, text) are read; an empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from querysieve.llm import bpe
from querysieve.session import materialise, ship

WORK = 32_768
LISTED = 200_000  # it has no influence on results
CHUNK_TOKENS = 150_000
BATCH_ROWS = 500  # in one Arrow batch
BUFFER = 1_500_000
# Bytes in each of the two generations of a worker's cache.
CACHE_BYTES = 40_000_000


def byte_characters() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: visible Latin-1 stands for itself, the rest follows at 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """One tokenizer: ids of texts with a space before them, and the bytes of every id."""

    def __init__(self, path: str):
        if path.endswith(".json"):
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            library.encode_special_tokens = True
            self._encode = lambda texts: [e.ids for e in library.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
            held, plain = library.get_vocab(with_added_tokens=True), byte_characters()
            self.bytes = [b""] * (max(held.values()) + 1)
            for token, i in held.items():
                self.bytes[i] = bytes(map(plain.__getitem__, token)) if set(token) <= plain.keys() else token.encode()
        else:
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda texts: library.encode(texts, num_threads=1)
            self.bytes = []
            for i in range(library.get_piece_size()):
                piece = library.id_to_piece(i)
                self.bytes.append(bytes([int(piece[1:-1], 16)]) if library.is_byte(i) else piece.replace("▁", " ").encode())
        self.size = len(self.bytes)
        self.widths = np.array([len(b) for b in self.bytes], np.int64)
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32

    def encode(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of each text behind a space; None where their bytes are not those of the text."""
        out = []
        for text, ids in zip(texts, self._encode(texts)):
            same = b"".join(map(self.bytes.__getitem__, ids)) == (" " + text).encode()
            out.append(np.array(ids, self.kind) if same else None)
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Ids of whole texts by both tokenizers, with a bounded cache of the pieces between safe spaces.

    Both start a new token at a single space between plain characters (tested: no entry holds a space behind
    another character, except runs of white space), so the ids of a text are those of its pieces.
    """

    JOINED = 3_000

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = vocabulary(path_a), vocabulary(path_b)
        self.young: dict[str, tuple[bytes, bytes] | None] = {}
        self.old: dict[str, tuple[bytes, bytes] | None] = {}
        self.held = 0

    def load(self, pieces: set[str]) -> None:
        if self.held > CACHE_BYTES:
            self.young, self.old, self.held = {}, self.young, 0
        joinable, single = [], []
        for piece in pieces.difference(self.young):
            if piece in self.old:
                self.young[piece] = self.old[piece]
                self.held += 330 + 4 * len(piece)
            elif piece and bpe._IS_PLAIN.match(piece[0]) and bpe._IS_PLAIN.match(piece[-1]):
                joinable.append(piece)
            else:
                single.append(piece)
        for at in range(0, len(joinable), self.JOINED):
            part = joinable[at:at + self.JOINED]
            if not self._joined(part):
                single += part
        for piece, ids_a, ids_b in zip(single, self.a.encode(single), self.b.encode(single)):
            self.young[piece] = None if ids_a is None or ids_b is None else (ids_a.tobytes(), ids_b.tobytes())
            self.held += 330 + 4 * len(piece)

    def _joined(self, pieces: list[str]) -> bool:
        """Encode pieces as one text and cut its ids where the pieces end."""
        text = " ".join(pieces)
        ends, cuts = np.cumsum([len(p.encode()) + 1 for p in pieces]), []
        for side in (self.a, self.b):
            ids = side.encode([text])[0]
            if ids is None:
                return False
            upto = np.cumsum(side.widths[ids])
            stops = np.searchsorted(upto, ends) + 1
            if (upto[stops - 1] != ends).any():
                return False
            held, at = ids.tobytes(), (stops * ids.itemsize).tolist()
            cuts.append([held[low:high] for low, high in zip([0, *at], at)])
        self.young.update(zip(pieces, zip(*cuts)))
        self.held += 330 * len(pieces) + len(text)
        return True

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        cut = [bpe._CUT.split(text) if text else [] for text in texts]
        self.load(set().union(*cut))
        out = []
        for pieces in cut:
            found = [self.young[p] for p in pieces]
            if not found or None in found:
                out.append(None)
            else:
                out.append((
                    np.frombuffer(b"".join([f[0] for f in found]), self.a.kind), np.frombuffer(b"".join([f[1] for f in found]), self.b.kind)
                ))
        return out


@lru_cache(maxsize=2)
def encoder(path_a: str, path_b: str) -> Encoder:
    return Encoder(path_a, path_b)


def diagonal(a: np.ndarray, b: np.ndarray, k: int) -> tuple[int, int]:
    """How many of the ``k`` smallest ends are from ``a`` and from ``b``; equal ends stay together."""
    low, high = max(0, k - len(b)), min(k, len(a))
    while low < high:
        middle = (low + high) // 2
        if a[middle] <= b[k - 1 - middle]:
            low = middle + 1
        else:
            high = middle
    i, j = low, k - low
    if i and j < len(b) and a[i - 1] == b[j]:
        j += 1
    return i, j


def cuts(a: np.ndarray, b: np.ndarray, work: int) -> list[tuple[int, int]]:
    """Places (i, j) that divide the merging of two lists of ends into pieces of ``work`` ends."""
    inner = [diagonal(a, b, k) for k in range(work, len(a) + len(b), work)]
    return sorted({(0, 0), *inner, (len(a), len(b))})


PIECE = (
    "row bigint, doc_id bigint, piece int, pieces int, a_from bigint, b_from bigint, a_own int, b_own int, a binary, b binary"
)
PIECE_NAMES = [f.split()[0] for f in PIECE.split(", ")]


def pieces_of(docs: DataFrame, path_a: str, path_b: str, work: int = WORK) -> DataFrame:
    """The pieces of every (doc_id, text): their ids with one token more, where it goes on, and where they begin."""

    def encode(batches):
        held, row = encoder(path_a, path_b), TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, part in bpe.in_parts(batch.column(1).to_pylist()):
                rows = []
                for doc, found in zip(ids[at:at + len(part)], held.encode(part)):
                    if found is None:
                        rows.append((row, doc, 0, 1, 0, 0, 0, 0, b"", b""))
                    elif len(found[0]) + len(found[1]) <= work:
                        a, b = found
                        rows.append((row, doc, 0, 1, 0, 0, len(a), len(b), a.tobytes(), b.tobytes()))
                    else:
                        a, b = found
                        ends_a, ends_b = np.cumsum(held.a.widths[a]), np.cumsum(held.b.widths[b])
                        places = cuts(ends_a, ends_b, work)
                        for k, ((i, j), (up_i, up_j)) in enumerate(zip(places, places[1:])):
                            rows.append((
                                row, doc, k, len(places) - 1, int(ends_a[i - 1]) if i else 0, int(ends_b[j - 1]) if j else 0,
                                up_i - i, up_j - j, a[i:up_i + 1].tobytes(), b[j:up_j + 1].tobytes(),
                            ))
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=PIECE_NAMES)

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return materialise(docs.mapInArrow(encode, PIECE), "token-pieces")


class Merged:
    """The merged ends of several pieces, laid one behind the other on a line of bytes."""

    def __init__(self, batch: pa.RecordBatch, a: Vocabulary, b: Vocabulary):
        ids = lambda column, side: [np.frombuffer(x, side.kind) for x in column.to_pylist()]
        numbers = lambda name: batch.column(PIECE_NAMES.index(name)).to_numpy(zero_copy_only=False)
        held_a, held_b = ids(batch.column(8), a), ids(batch.column(9), b)
        self.n_a, self.n_b = numbers("a_own").astype(np.int64), numbers("b_own").astype(np.int64)
        self.a, at_a, ends_a, first_a = self._ends(held_a, numbers("a_from"), a)
        self.b, at_b, ends_b, first_b = self._ends(held_b, numbers("b_from"), b)
        size_a, size_b = np.diff(first_a), np.diff(first_b)
        start = np.minimum(numbers("a_from"), numbers("b_from"))
        last = np.zeros(len(start), np.int64)
        for ends, first, size in ((ends_a, first_a, size_a), (ends_b, first_b, size_b)):
            some = size > 0
            last[some] = np.maximum(last[some], ends[first[1:][some] - 1])
        span = np.where(last > 0, last - start, 0)
        self.line = np.concatenate([[0], np.cumsum(span)])
        shift = self.line[:-1] - start
        ends_a += shift[at_a]
        ends_b += shift[at_b]
        self.own_a = np.arange(len(ends_a)) - first_a[at_a] < self.n_a[at_a]
        self.own_b = np.arange(len(ends_b)) - first_b[at_b] < self.n_b[at_b]
        own_ends_a, own_ends_b = ends_a[self.own_a], ends_b[self.own_b]
        both = np.concatenate([own_ends_a, own_ends_b])
        both.sort(kind="stable")
        twice = both[1:] == both[:-1]
        self.common = both[1:][twice]
        ends = both[np.concatenate([[True], ~twice])] if len(both) else both
        self.piece = np.searchsorted(self.line, ends, "left") - 1
        self.link_a = self.a[np.searchsorted(ends_a, ends, "left")]
        self.link_b = self.b[np.searchsorted(ends_b, ends, "left")]
        self.ends_a, self.ends_b = own_ends_a, own_ends_b
        n = len(self.line) - 1
        self.n_links = np.bincount(self.piece, minlength=n)
        self.n_groups = np.bincount(np.searchsorted(self.line, self.common, "left") - 1, minlength=n)

    @staticmethod
    def _ends(held: list[np.ndarray], begin: np.ndarray, side: Vocabulary):
        sizes = np.array([len(x) for x in held], np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.concatenate(held) if held else np.zeros(0, side.kind)
        at = np.repeat(np.arange(len(held)), sizes)
        upto = np.cumsum(side.widths[ids])
        before = np.concatenate([[0], upto])[first[:-1]]
        return ids, at, upto - before[at] + begin[at], first

    def pairs(self, width_a: int, width_b: int):
        """``(piece, a * width_b + b, times)`` of the different pairs of each piece."""
        spread = width_a * width_b
        if len(self.line) * spread >= 1 << 63:
            raise ValueError("vocabularies too large for one number per piece and pair")
        key = self.piece * spread + self.link_a.astype(np.int64) * width_b + self.link_b
        key.sort()
        fresh = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        times = np.diff(np.concatenate([fresh, [len(key)]]))
        key = key[fresh]
        return key // spread, key % spread, times

    def texts(self, spelling: "Spelling") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The spelled tokens up to the last common end, group by group, and how many of A and B each common end closes."""
        cut_a = np.searchsorted(self.ends_a, self.common, "right")
        cut_b = np.searchsorted(self.ends_b, self.common, "right")
        done_a, done_b = (int(c[-1]) if len(c) else 0 for c in (cut_a, cut_b))
        # Tokens behind the last common end of a piece belong to a group that the next piece ends.
        group_a = np.searchsorted(self.common, self.ends_a[:done_a], "left")
        group_b = np.searchsorted(self.common, self.ends_b[:done_b], "left")
        out = np.zeros(done_a + done_b, spelling.kind)
        own_a, own_b = self.a[self.own_a][:done_a], self.b[self.own_b][:done_b]
        after = np.zeros(done_a, np.int64)
        after[cut_a - 1] = 1
        out[np.arange(done_a) + np.concatenate([[0], cut_b])[group_a]] = spelling.a[after, own_a]
        after = np.zeros(done_b, np.int64)
        after[cut_b - 1] = 1
        out[np.arange(done_b) + cut_a[group_b]] = spelling.b[after, own_b]
        return out, cut_a, cut_b


class Spelling:
    """Every id with the sign that follows it in a group: inside its side, or at the end of it."""

    def __init__(self, size_a: int, size_b: int):
        self.kind = f"S{len(str(max(size_a, size_b))) + 1}"
        signed = lambda size, inner, end: np.array([[f"{i}{s}" for i in range(size)] for s in (inner, end)], self.kind)
        self.a, self.b = signed(size_a, ",", "|"), signed(size_b, ",", ";")


@lru_cache(maxsize=2)
def spelling(size_a: int, size_b: int) -> Spelling:
    return Spelling(size_a, size_b)


def in_chunks(batches, tokens: int = CHUNK_TOKENS):
    """Slices of batches with about so many tokens."""
    for batch in batches:
        sizes = np.cumsum(batch.column(6).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = sizes[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(sizes, done + tokens)))
            yield batch.slice(at, stop - at)
            at = stop


def on_pieces(pieces: DataFrame, function, schema: str) -> DataFrame:
    """``function`` over all pieces: of whole texts where they lie, of cut ones dealt anew."""
    dealt = pieces.where(F.col("pieces") > 1).repartition("row", "piece")
    return pieces.where(F.col("pieces") == 1).mapInArrow(function, schema).unionByName(dealt.mapInArrow(function, schema))


def pair_counts(pieces: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``a, b, n``: in how many documents each id pair is linked."""
    names = ["row", "a", "b", "n"]

    def count(batches):
        encoder.cache_clear()  # workers are used again
        a, b, seen, held = vocabulary(path_a), vocabulary(path_b), [], 0

        def batch_of(row, pair, n):
            return pa.RecordBatch.from_arrays([row, pa.array(pair // b.size), pa.array(pair % b.size), pa.array(n)], names=names)

        def summed():
            pair, n = np.unique(np.concatenate(seen), return_counts=True)
            return batch_of(pa.nulls(len(pair), pa.int64()), pair, n)

        for batch in in_chunks(batches):
            piece, pair, _ = Merged(batch, a, b).pairs(a.size, b.size)
            whole = batch.column(3).to_numpy(zero_copy_only=False)[piece] == 1
            seen.append(pair[whole])
            held += len(seen[-1])
            if not whole.all():
                rows = batch.column(0).to_numpy(zero_copy_only=False)[piece[~whole]]
                yield batch_of(pa.array(rows), pair[~whole], np.ones(len(rows), np.int64))
            if held >= BUFFER:
                yield summed()
                seen, held = [], 0
        if seen:
            yield summed()

    found = on_pieces(pieces, count, "row bigint, a bigint, b bigint, n bigint")
    found = materialise(found, "pairs")
    # A pair in several pieces of one document counts once.
    several = found.where(F.col("row").isNotNull()).select("row", "a", "b").distinct().select("a", "b", F.lit(1).cast("bigint").alias("n"))
    every = found.where(F.col("row").isNull()).select("a", "b", "n").unionByName(several)
    return materialise(every.groupBy("a", "b").agg(F.sum("n").alias("n")), "pair-counts")


def graded(counts: DataFrame) -> DataFrame:
    """``counts`` with ``best``: no other pair of its A id counts more. One row per A id is broadcast."""
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


class Listed:
    """The commonest pairs with their counts, as sorted numbers."""

    def __init__(self, rows: list, width_b: int):
        pair = np.array([r.a * width_b + r.b for r in rows], np.int64)
        order = np.argsort(pair)
        self.pair = pair[order]
        self.n = np.array([r.n for r in rows], np.int64)[order]
        self.best = np.array([r.best for r in rows], bool)[order]

    def find(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs, and whether they are listed."""
        if not len(self.pair):
            return np.zeros(len(pair), np.int64), np.zeros(len(pair), bool)
        at = np.minimum(np.searchsorted(self.pair, pair), len(self.pair) - 1)
        return at, self.pair[at] == pair


ALIGNED = (
    "row bigint, doc_id bigint, piece int, pieces int, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, "
    "count_sum bigint, groups_sha256 string, head_a array<int>, head_b array<int>, ended boolean, middle binary, "
    "tail_a array<int>, tail_b array<int>, a bigint, b bigint, times bigint"
)
ALIGNED_NAMES = [f.split()[0] for f in ALIGNED.split(", ")]
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
ALIGNED_KINDS = [_ARROW[f.split()[1]] for f in ALIGNED.split(", ")]


def _batch(rows: int, **columns) -> pa.RecordBatch:
    """A batch of ``ALIGNED`` rows; columns not given are null."""
    arrays = [pa.array(columns[n], k) if n in columns else pa.nulls(rows, k) for n, k in zip(ALIGNED_NAMES, ALIGNED_KINDS)]
    return pa.RecordBatch.from_arrays(arrays, names=ALIGNED_NAMES)


def _aligned(pieces: DataFrame, path_a: str, path_b: str, listed) -> DataFrame:
    """Per piece its numbers and groups, and rows of its pairs that are not listed."""

    def align(batches):
        encoder.cache_clear()
        a, b = vocabulary(path_a), vocabulary(path_b)
        spelled, common = spelling(a.size, b.size), listed.value
        for batch in in_chunks(batches):
            merged = Merged(batch, a, b)
            n = batch.num_rows
            piece, pair, times = merged.pairs(a.size, b.size)
            at, known = common.find(pair)
            sums, bests = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(sums, piece[known], times[known] * common.n[at[known]])
            np.add.at(bests, piece[known], times[known] * common.best[at[known]])
            column = lambda k: batch.column(k).to_numpy(zero_copy_only=False)
            row, pieces_, number = column(0), column(3), column(2)
            if not known.all():
                rest = pair[~known]
                yield _batch(len(rest), row=row[piece[~known]], a=rest // b.size, b=rest % b.size, times=times[~known])
            out, cut_a, cut_b = merged.texts(spelled)
            stop_a, stop_b, stop = np.cumsum(merged.n_a), np.cumsum(merged.n_b), np.cumsum(merged.n_groups)
            own_a, own_b = merged.a[merged.own_a], merged.b[merged.own_b]
            digests, parts = [], {"head_a": [], "head_b": [], "ended": [], "middle": [], "tail_a": [], "tail_b": []}
            text = lambda low, high: out[low:high].tobytes().translate(None, b"\0")
            for k in range(n):
                first, last = int(stop[k] - merged.n_groups[k]), int(stop[k])
                low_a, low_b = int(stop_a[k] - merged.n_a[k]), int(stop_b[k] - merged.n_b[k])
                if pieces_[k] == 1:
                    held = text(low_a + low_b, int(stop_a[k] + stop_b[k]))[:-1]
                    digests.append(hashlib.sha256(held).hexdigest() if held else "")
                    for values in parts.values():
                        values.append(None)
                    continue
                digests.append(None)
                ended = last > first
                head = (int(cut_a[first]), int(cut_b[first])) if ended else (int(stop_a[k]), int(stop_b[k]))
                tail = (int(cut_a[last - 1]), int(cut_b[last - 1])) if ended else head
                parts["head_a"].append(own_a[low_a:head[0]].tolist())
                parts["head_b"].append(own_b[low_b:head[1]].tolist())
                parts["ended"].append(ended)
                parts["middle"].append(text(sum(head), sum(tail)))
                parts["tail_a"].append(own_a[tail[0]:int(stop_a[k])].tolist())
                parts["tail_b"].append(own_b[tail[1]:int(stop_b[k])].tolist())
            yield _batch(
                n, row=row, doc_id=batch.column(1), piece=number, pieces=pieces_, n_a=merged.n_a, n_b=merged.n_b, n_groups=merged.n_groups,
                n_links=merged.n_links, n_best=bests, count_sum=sums, groups_sha256=digests, **parts,
            )

    return materialise(on_pieces(pieces, align, ALIGNED), "aligned")


NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _stitched(aligned: DataFrame) -> DataFrame:
    """One row per document of several pieces; groups over boundaries are put together in the order of the pieces."""
    parts = F.struct("piece", "head_a", "head_b", "ended", "middle", "tail_a", "tail_b")
    whole = aligned.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in NUMBERS], F.array_sort(F.collect_list(parts)).alias("parts")
    )

    def stitch(batches):
        spell = lambda one, two: f"{','.join(map(str, one))}|{','.join(map(str, two))};".encode()
        for batch in batches:
            digests = []
            for parts in batch.column(batch.num_columns - 1):
                held, one, two = hashlib.sha256(), [], []
                pending = b""
                for part in parts.as_py():
                    one, two = one + part["head_a"], two + part["head_b"]
                    if part["ended"]:
                        added = pending + spell(one, two) + part["middle"]
                        held.update(added[:-1])
                        pending, one, two = added[-1:], part["tail_a"], part["tail_b"]
                digests.append(held.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(digests)], names=["row", "doc_id", *NUMBERS, "groups_sha256"]
            )

    schema = f"row bigint, doc_id bigint, {', '.join(f'{c} bigint' for c in NUMBERS)}, groups_sha256 string"
    return whole.mapInArrow(stitch, schema)


def align(docs: DataFrame, path_a: str, path_b: str, work: int = WORK, listed: int = LISTED) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every (doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    # Rows hold whole texts and their ids; the tables are written before the setting goes back.
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(setting)
    spark.conf.set(setting, str(BATCH_ROWS))
    try:
        return _align(spark, docs, path_a, path_b, work, listed)
    finally:
        spark.conf.set(setting, usual)


def _align(spark, docs: DataFrame, path_a: str, path_b: str, work: int, listed: int) -> DataFrame:
    pieces = pieces_of(docs.select(F.col("doc_id").cast("bigint"), "text"), path_a, path_b, work)
    counts = graded(pair_counts(pieces, path_a, path_b))
    counts = materialise(counts, "graded")
    top = counts.orderBy(F.desc("n"), "a", "b").limit(listed).collect()
    aligned = _aligned(pieces, path_a, path_b, spark.sparkContext.broadcast(Listed(top, vocabulary(path_b).size)))

    rest = aligned.where(F.col("times").isNotNull()).select("row", "a", "b", "times").join(counts, ["a", "b"])
    more = rest.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum")
    )
    columns = ["row", "doc_id", *NUMBERS, "groups_sha256"]
    numbered = aligned.where(F.col("times").isNull())
    every = numbered.where(F.col("pieces") == 1).select(*columns).unionByName(_stitched(numbered.where(F.col("pieces") > 1)))
    plus = lambda column, added: (F.col(column) + F.coalesce(added, F.lit(0))).cast("bigint").alias(column)
    return every.join(more, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", plus("n_best", "more_best"), plus("count_sum", "more_sum"), "groups_sha256"
    )
