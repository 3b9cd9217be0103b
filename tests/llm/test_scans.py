"""License scans, tokenizer alignment and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from querysieve.llm import alignment, license_scan, spelling

DOCS = "doc_id bigint, text string, row string, n bigint, label string"
PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "row", 1, None) for d, t in rows], DOCS).repartition(3)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# License scans


def license_words(text):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def scanned(held, templates, percent):
    out = []
    for doc, text in held:
        words, base, found = license_words(text), [], {}
        for phrase, label in license_scan.PHRASES:
            phrase = phrase.split()
            base += [(i, label) for i in range(len(words)) if words[i:i + len(phrase)] == phrase]
        for label, notice in templates:
            notice = license_words(notice)
            span = 1
            while span < len(notice):
                span *= 2
            for at in range(0, len(words), span):
                shared = len(set(notice) & set(words[at:at + 2 * span]))
                if 100 * shared >= percent * len(set(notice)):
                    found[label] = max(found.get(label, 0), shared / len(set(notice)))
        spots, labels = [i for i, _ in base], {label for _, label in base}
        out.append((doc, len(words), len(base), min(spots, default=None), max(spots, default=None), ",".join(sorted(labels)),
                    ",".join(sorted(labels | set(found))), 1.0 if base else max(found.values(), default=0.0)))
    return sorted(out, key=repr)


def test_license_blocks_against_brute_force(spark, monkeypatch):
    draw = random.Random(4)
    notices = [n for _, n in license_scan.TEMPLATES]
    vocabulary = sorted({w for n in notices for w in license_words(n)}) + ["é", "Straße", "x9"]
    prose = lambda n: " ".join(draw.choices(vocabulary, k=n))
    texts = [None, "", " \n-", "cc", "CC-BY", "cc by cc by", "by cc", "cc", "by", "All rights\nReserved. GENERAL public licenses", "général public license"]
    for notice in notices:
        words = notice.split()
        cut = [w for i, w in enumerate(words) if i % 7 != 3]
        texts += [notice, prose(37) + " " + notice.upper() + " " + prose(50), " ".join(cut), prose(9) + "\n" + " / ".join(words[::-1])]
    texts += [prose(n) for n in (5, 60, 400, 3000)] + ["=" * 5000, "a" * 9000]
    held = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(3, texts[12]), (3, texts[12]), (3, "cc by")]
    for templates, percent in ((license_scan.TEMPLATES, 85), (license_scan.TEMPLATES, 50), ([("x", "one"), ("y", ""), ("mit", "of the")], 100)):
        want = scanned(held, [t for t in templates if t[1]], percent)
        monkeypatch.setattr(license_scan, "CHUNK_WORDS", 500)
        assert rows(license_scan.scan(frame(spark, held), templates=templates, percent=percent)) == want
    assert license_scan.scan(frame(spark, held).limit(0)).count() == 0


def test_base_phrases_do_not_cross_texts(spark):
    held = [(i, t) for i, t in enumerate(["x cc", "by", "all rights", "reserved"])]
    assert all(r.n_base == 0 for r in license_scan.scan(spark.createDataFrame(held, "doc_id bigint, text string").coalesce(1)).collect())


# Alignment


def token_bytes(text):
    """The ids and bytes of both libraries, called directly; None without tokens."""
    if not text:
        return None
    byte_level = Tokenizer.from_file(PATHS[0])
    byte_level.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    plain = alignment.byte_characters()
    got = byte_level.encode(" " + text, add_special_tokens=False)
    one = [(i, bytes(plain[c] for c in token)) for i, token in zip(got.ids, got.tokens)]
    two = [(i, bytes([i - 3]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()) for i in pieces.encode(text)]
    whole = (" " + text).encode()
    return (one, two) if b"".join(b for _, b in one) == whole == b"".join(b for _, b in two) else None


def aligned(held):
    per, counts = [], Counter()
    for doc, text in held:
        both = token_bytes(text) or ([], [])
        spans = []
        for side in both:
            ends = np.cumsum([0] + [len(b) for _, b in side]).tolist()
            spans.append([(low, high, i) for low, high, (i, _) in zip(ends, ends[1:], side)])
        links, begin = [], 0
        for low, high, i in spans[0]:
            k = begin
            while k < len(spans[1]) and spans[1][k][0] < high:
                if spans[1][k][1] > low:
                    links.append((i, spans[1][k][2]))
                if spans[1][k][1] <= high:
                    begin = k + 1
                k += 1
        common, groups, low = sorted({h for _, h, _ in spans[0]} & {h for _, h, _ in spans[1]}), [], 0
        for high in common:
            groups.append("|".join(",".join(str(i) for _, h, i in side if low < h <= high) for side in spans))
            low = high
        per.append((doc, *map(len, spans), groups, links))
        counts.update(set(links))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    return sorted(((doc, n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links),
                    hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for doc, n_a, n_b, groups, links in per), key=repr)


@pytest.fixture(scope="module")
def mixed_texts():
    draw = random.Random(2)
    words = "the of and License straße naïve 日本語 don't x1234 🎉 é́ ﬁ ​ foo_bar http://a.b/c?d=e ABCdef <s> </s> <|endoftext|> <0x41> \0 ... ---- नमस्ते".split(" ")
    text = lambda n: "".join(draw.choice(words) + draw.choice([" ", " ", " ", "  ", "\n", "", "\t", " \n "]) for _ in range(n))
    texts = [text(draw.choice([1, 2, 5, 30, 200])) for _ in range(30)] + [
        None, "", " ", " ", "▁a b", "a ▁", "日" * 300, "é" * 900, "a" * 900, " " * 700, text(900), "the of " * 200, "the of " * 200]
    held = [(i if i % 6 else None, t) for i, t in enumerate(texts)] + [(7, "the of"), (7, "the of")]
    return held, aligned(held)


@pytest.mark.parametrize("kw", [{}, {"work": 7, "listed": 50}, {"work": 100, "listed": 0}])
def test_alignment_against_brute_force(spark, mixed_texts, kw):
    held, want = mixed_texts
    assert rows(alignment.align(frame(spark, held), *PATHS, **kw)) == want
    assert sum(r[1] == 0 for r in want) >= 4  # nothing to align: null, empty, a sign that the second library takes for a space
    assert alignment.align(frame(spark, held).limit(0), *PATHS).count() == 0


def test_diagonals_divide_the_work():
    draw = np.random.default_rng(6)
    for _ in range(50):
        a, b = (np.cumsum(draw.integers(1, 5, draw.integers(1, 60))) for _ in range(2))
        places = alignment.cuts(a, b, 8)
        assert places[0] == (0, 0) and places[-1] == (len(a), len(b))
        for (i, j), (k, m) in zip(places, places[1:]):
            assert i <= k and j <= m and k + m - i - j <= 9
            before, after = [*a[:k], *b[:m]], [*a[k:], *b[m:]]
            assert not before or not after or max(before) < min(after)


def test_no_entry_holds_a_space_behind_another_character():
    byte_level, pieces = (alignment.vocabulary(p) for p in PATHS)
    plain = re.compile(rb"[!-~] |[\xc3-\xc9][\x80-\xbf] ")  # what a cut needs before its space
    assert not [b for side in (byte_level, pieces) for b in side.bytes if plain.search(b)]


def test_small_caches_give_the_same_ids(monkeypatch):
    texts = [" ".join(f"w{(i * j) % 997}é" for j in range(60)) for i in range(60)] + ["a  b", "<|endoftext|> é", "\nx", "x\n"]
    held = alignment.Encoder(*PATHS)
    want = [tuple(x.tolist() for x in f) for f in held.encode(texts)]
    monkeypatch.setattr(alignment, "CACHE_BYTES", 5_000)
    small = alignment.Encoder(*PATHS)
    small.JOINED = 7
    got = [tuple(x.tolist() for x in f) for t in texts for f in small.encode([t])]
    assert got == want == [tuple([i for i, _ in side] for side in token_bytes(t)) for t in texts]


# Spelling variants


def variants(held, every):
    count = Counter()
    for doc, text in held:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            draw = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            if draw % every == 0:
                run = run[:draw % len(run)] + run[draw % len(run) + 1:]
            count[run] += 1
    n = {w: k for w, k in count.items() if len(w) >= 5 and k >= 3}

    def near(u, v):
        if len(u) == len(v):
            return sum(a != b for a, b in zip(u, v)) == 1
        u, v = sorted((u, v), key=len)
        return len(v) == len(u) + 1 and any(v[:i] + v[i + 1:] == u for i in range(len(v)))

    beside = {w: sorted((v for v in n if near(w, v)), key=lambda v: (-n[v], v)) for w in n}
    form = {w: beside[w][0] if beside[w] and n[beside[w][0]] >= 2 * n[w] else None for w in n}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(beside[w]), n.get(form[w])))
    return sorted(out, key=repr)


@pytest.mark.parametrize("every, spelled", [(3, 256), (97, 256), (3, 5), (3, 6)])
def test_variants_against_brute_force(spark, every, spelled):
    draw = random.Random(1)
    words = ["hello", "helllo", "hallo", "hullo", "halloo", "éclair", "eclair", "Ünder", "aaaaa", "aaaaaa", "aaaaaaa", "aaaab", "baaaa",
             "x×y÷z", "WORLD", "world", "worldly", "ab", "É", "abcdefgh" * 33, "b" + "a" * 256, "a" * 299 + "b", *("a" * n for n in (255, 256, 257, 258, 300, 301))]
    held = [(i if i % 7 else None, " ".join(draw.choices(words, k=60)) + "\n, don't1") for i in range(40)]
    held += [(1, None), (2, ""), (None, "hello hello"), (None, "hello hello"), (5, "Hello-hello " * 30)]
    assert rows(spelling.variants(frame(spark, held), every=every, spelled=spelled)) == variants(held, every)


def test_no_words(spark):
    for held in ([], [(1, None), (None, "a b c"), (2, "once upon")]):
        assert spelling.variants(spark.createDataFrame(held, "doc_id bigint, text string")).count() == 0


def test_a_very_long_word_takes_little_room(spark):
    long = "ab" * 20_000
    got = rows(spelling.variants(spark.createDataFrame([(i, long + ("c" if i < 3 else "")) for i in range(9)], "doc_id bigint, text string"), every=10**9))
    assert got == sorted([(long, None, long, 6, 1, None), (long + "c", long, long, 3, 1, 6)], key=repr)
