"""Tokenizer ids of whole texts inside tasks, with a bounded cache of the corpus's words.

The byte-level vocabulary cuts a text into words before it merges bytes, and a single space between
two plain characters always starts a new word. So a text may be cut there, each distinct piece is
encoded once by the library, and the pieces' ids joined are the ids of the text. Texts and pieces of common
characters alone are cut into words, many texts at once and as columns of bytes: each distinct word of a batch is looked
up once, and new ones go to the library's merges as they are. Others take the library's whole way.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

# Characters that every Unicode version counts as visible: a cut needs one on both sides. The space
# comes first in the pattern, so the search jumps from space to space.
_PLAIN = "!-~À-ɏ"
_CUT = re.compile(f" (?<=[{_PLAIN}] )(?=[{_PLAIN}])")
_IS_PLAIN = re.compile(f"[{_PLAIN}]")
# What the vocabulary's own word pattern sees in plain characters and common white space, by bytes of UTF-8. The letters are
# ASCII and U+00C0 to U+024F, the two signs among the latter are set apart; the byte 0 stands between texts.
_COMMON = re.compile(f"[\\t\\n\\r {_PLAIN}]*")
_BETWEEN, _WHITE, _LETTER, _DIGIT, _SIGN = range(5)
_KINDS = np.full(256, _LETTER, np.uint8)
_KINDS[:0x80] = [
    _BETWEEN if b == 0 else _WHITE if b <= 32 else _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _SIGN for b in range(0x80)
]
_SHORT, _LONG = [ord(c) for c in "stmd"], [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]
# Pieces in each of the two generations of the cache, about 200 bytes each. More save little: most misses are words seen once.
CACHE_PIECES = 200_000
# Words of common texts, counted the same way.
CACHE_WORDS = 400_000
BATCH_CHARS = 2_000_000
JOINED = 5_000
JOINED_WORDS = 20_000


@lru_cache(maxsize=4)
def _library(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def _widths(path: str) -> np.ndarray:
    """Bytes of text behind each id: a byte-level token has one character per byte, an added one is plain text."""
    library = _library(path)
    added = library.get_added_tokens_decoder()
    vocabulary = library.get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, i in vocabulary.items():
        out[i] = len(token.encode()) if i in added else len(token)
    return out


def vocabulary_size(path: str, *others: int) -> int:
    """One more than the largest id of the library's vocabulary and ``others``."""
    return max(len(_widths(path)), *(i + 1 for i in others))


@lru_cache(maxsize=4)
def _word_library(path: str):
    """The library's merges of words that the byte 0 divides; None if the vocabulary cuts words in its own way."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

    library = _library(path)
    cut = library.pre_tokenizer
    if type(cut) is not ByteLevel or not cut.use_regex or cut.add_prefix_space or library.normalizer is not None:
        return None
    words = Tokenizer(library.model)
    words.pre_tokenizer = Sequence([Split("\0", "removed"), ByteLevel(add_prefix_space=False, use_regex=False)])
    return words


def _cut_ids(ids: np.ndarray, sizes: np.ndarray, path: str) -> list[bytes]:
    """Ids of several texts of ``sizes`` bytes that were encoded as one; the bytes behind the ids tell whose each is."""
    upto, ends = np.cumsum(_widths(path)[ids]), np.cumsum(sizes)
    stops = np.searchsorted(upto, ends) + 1
    if (upto[stops - 1] != ends).any():
        raise ValueError("an id crosses a cut between two pieces")
    held, stops = ids.tobytes(), (4 * stops).tolist()
    return [held[start:stop] for start, stop in zip([0, *stops], stops)]


def word_starts(raw: np.ndarray) -> np.ndarray:
    """Places where the words of common texts begin, the byte 0 behind each text included.

    The pattern: ``'(?:[stmd]|re|ve|ll)| ?letters| ?digits| ?signs|white space without its last one if more follows``.
    """
    kind = _KINDS[raw]
    lead = np.flatnonzero(raw == 0xC3)
    lead = lead[np.isin(raw[lead + 1], (0x97, 0xB7))]
    kind[lead] = kind[lead + 1] = _SIGN
    before = np.concatenate([[np.uint8(_BETWEEN)], kind[:-1]])
    begins = kind != before
    begins |= kind == _BETWEEN
    # A space belongs to the word behind it, and the last white space before a word is taken from its run.
    last = np.flatnonzero((kind > _WHITE) & (before == _WHITE))
    begins[last - 1] = True
    begins[last[raw[last - 1] == 0x20]] = False
    # A quote that begins a word takes short endings with it, whatever follows them.
    quote = np.flatnonzero((raw == 0x27) & begins)
    after = np.zeros((len(quote), 2), np.uint8)
    for k in range(2):
        inside = quote + 1 + k < len(raw)
        after[inside, k] = raw[quote[inside] + 1 + k]
    size = np.where(np.isin(after[:, 0], _SHORT), 2, 0)
    for a, b in _LONG:
        size[(after[:, 0] == a) & (after[:, 1] == b)] = 3
    quote, size = quote[size > 0], size[size > 0]
    begins[quote + 1] = False
    begins[quote + size] = True
    begins[:1] = True
    return np.flatnonzero(begins)


class _Cache:
    """Ids of words and pieces in two generations: a full young one becomes the old one, whose members in use come back."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.words: dict[bytes, bytes] = {}
        self.old_words: dict[bytes, bytes] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        special = [re.escape(t.content) for t in _library(path).get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special) or "(?!)").search

    def of_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of different words; the byte 0 has none."""
        held = list(map(self.words.get, words))
        missing = [i for i, ids in enumerate(held) if ids is None]
        for i, ids in zip(missing, map(self.old_words.get, [words[i] for i in missing])):
            held[i] = b"" if words[i] == b"\0" else ids
        new = [i for i in missing if held[i] is None]
        for at in range(0, len(new), JOINED_WORDS):
            part = [words[i] for i in new[at:at + JOINED_WORDS]]
            got = _word_library(self.path).encode_batch_fast([b"\0".join(part).decode()], add_special_tokens=False)[0].ids
            for i, ids in zip(new[at:], _cut_ids(np.array(got, "<u4"), np.fromiter(map(len, part), np.int64), self.path)):
                held[i] = ids
        self.words.update((words[i], held[i]) for i in missing)
        return held

    def common(self, texts: list[str]) -> list[bytes | None]:
        """Ids of texts of common characters; None for those that need the library's whole way."""
        held: list[bytes | None] = [None] * len(texts)
        own = [] if _word_library(self.path) is None else [i for i, t in enumerate(texts) if _COMMON.fullmatch(t) and not self.special(t)]
        if not own:
            return held
        data = "\0".join([texts[i] for i in own]).encode() + b"\0"
        raw = np.frombuffer(data, np.uint8)
        starts = word_starts(raw)
        bounds = np.append(starts, len(raw)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        stops = np.frombuffer(words.dictionary.buffers()[1], np.int32)[:len(words.dictionary) + 1].tolist()
        distinct = words.dictionary.buffers()[2].to_pybytes()
        known = self.of_words([distinct[a:b] for a, b in zip(stops, stops[1:])])
        sizes = np.fromiter(map(len, known), np.int32)
        places = np.append(0, np.cumsum(sizes, dtype=np.int64))
        known = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(places), pa.py_buffer(b"".join(known))])
        ids = known.take(words.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[np.flatnonzero(raw[starts] == 0) + 1].tolist()
        joined, start = ids.buffers()[2].to_pybytes(), 0
        for i, end in zip(own, ends):
            held[i] = joined[start:end]
            start = end
        return held

    def turn(self) -> None:
        """Full generations become old ones."""
        if len(self.words) > CACHE_WORDS:
            self.words, self.old_words = {}, self.words
        if len(self.young) > CACHE_PIECES:
            self.young, self.old = {}, self.young

    def load(self, pieces: set[str], path: str) -> None:
        """Bring every piece into the young generation."""
        joinable, single, missing = [], [], []
        for piece in pieces.difference(self.young):
            if piece in self.old:
                self.young[piece] = self.old[piece]
            else:
                missing.append(piece)
        for piece, ids in zip(missing, self.common([p[1:] if p[0] == FIRST else " " + p for p in missing])):
            if ids is not None:
                self.young[piece] = ids
            elif piece[0] != FIRST and _IS_PLAIN.match(piece[-1]):
                joinable.append(piece)
            else:
                single.append(piece)
        texts = [p[1:] if p[0] == FIRST else " " + p for p in single]
        for piece, got in zip(single, _library(path).encode_batch_fast(texts, add_special_tokens=False)):
            self.young[piece] = np.array(got.ids, "<u4").tobytes()
        for at in range(0, len(joinable), JOINED):
            self._joined(joinable[at:at + JOINED], path)

    def _joined(self, pieces: list[str], path: str) -> None:
        """Encode pieces as one text; the bytes behind the ids tell which piece each id belongs to."""
        text = " " + " ".join(pieces)
        ids = np.array(_library(path).encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        self.young.update(zip(pieces, _cut_ids(ids, np.array([len(p.encode()) + 1 for p in pieces]), path)))


# A text's first piece has no space before it, so its key is marked; a later piece starts with a plain character.
FIRST = "\0"


@lru_cache(maxsize=4)
def _cache(path: str) -> _Cache:
    return _Cache(path)


def forget() -> None:
    """Empty the cache; the next call fills it again."""
    _cache.cache_clear()


def encode(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers."""
    cache = _cache(path)
    cache.turn()
    held = cache.common(texts)
    cut = {i: _CUT.split(FIRST + texts[i]) for i, ids in enumerate(held) if ids is None}
    cache.load(set().union(*cut.values()), path)
    for i, pieces in cut.items():
        held[i] = b"".join(map(cache.young.__getitem__, pieces))
    return held


def in_parts(texts: list[str | None], chars: int = BATCH_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of bounded length (null as empty) with the place of the first."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "") + 64
        if size >= chars:
            yield start, [t or "" for t in texts[start:i + 1]]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, [t or "" for t in texts[start:]]
