"""Operators on texts against brute force on small fixtures with nulls, empty and long texts, ties and repeats."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from querysieve.llm import bpe, huffman, mixing, ngram_join, packing, quality, suffix_dedup, token_counts
from querysieve.llm.difference_cover import suffix_ranks
from querysieve.session import materialise, scratch_path

DOCS = "doc_id bigint, text string, source string, _row string, key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = np.random.default_rng(3)
prose = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
LONG = prose(3000)
SHARED = prose(60)
TEXTS = [
    None, "", "  \t\n", "one", "Two words", LONG, LONG, LONG + " tail", SHARED, prose(90) + " " + SHARED + " " + prose(80),
    "é" * 150 + SHARED + "é", "=" * 700, "=" * 250, "a\n\nb\na\n b", "x " * 300, SHARED.upper(), SHARED.replace("w1", "v1", 1),
    "a  \n b <|endoftext|> c  d", "I'll say: ### ***", prose(40),
]
ROWS = [(i, t, f"s{i % 3}" if i % 5 else None, "row", "key") for i, t in enumerate(TEXTS)]
ROWS += [ROWS[6], (None, SHARED, None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_quality_measures_and_order_of_rules(spark, docs, none):
    want = []
    for doc, text, *_ in ROWS:
        words = WORD.findall(text or "")
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
        count, covered = Counter(windows), set()
        for i, w in enumerate(windows):
            if count[w] > 1:
                covered.update(range(i, i + 5))
        want.append((doc, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
                     len(lines) - len(set(lines)), len(covered)))
    got = quality.cascade(docs)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert rows(got.select(names)) == sorted(want, key=repr)
    verdicts = rows(got.select("doc_id", "kept"))
    assert rows(quality.cascade(docs, rules=quality.default_rules()[::-1]).select("doc_id", "kept")) == verdicts
    assert rows(quality.keep_good(docs).select("doc_id")) == sorted(((d,) for d, k in verdicts if k), key=repr)
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.cascade(none).count() == 0


def test_ids_of_pieces_are_ids_of_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = [t or "" for t in TEXTS] + ["".join(map(chr, rng.choice([32, 32, 97, 39, 115, 10, 160, 233, 8232, 46], 60))) for _ in range(300)]
    got = [np.frombuffer(ids, "<u4").tolist() for ids in bpe.encode(texts, path)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_counts_fill_the_cache_once(spark, docs, none, monkeypatch):
    cache, path = scratch_path(spark, "cache"), public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted(((d, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for d, t, *_ in ROWS), key=repr)
    assert rows(token_counts.count_tokens(docs, path, cache)) == want
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for t in TEXTS})
    assert rows(token_counts.count_tokens(docs, path, cache)) == want
    assert spark.read.parquet(cache).count() == stored
    assert token_counts.count_tokens(none, path, scratch_path(spark, "cache")).count() == 0


@pytest.mark.parametrize("limit", [6, 16])
def test_length_limited_code_is_optimal_and_decodes(limit):
    counts = np.array([0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 0, 89, 144])
    lengths = huffman.code_lengths(counts, limit)
    used = lengths[lengths > 0].astype(int)
    assert (2.0 ** -used).sum() == 1 and used.max() <= limit and (lengths > 0).tolist() == (counts > 0).tolist()
    if limit == 16:  # unlimited: equals the textbook construction
        heap, cost = sorted(counts[counts > 0].tolist()), 0
        while len(heap) > 1:
            a, b = heap.pop(0), heap.pop(0)
            cost += a + b
            heap = sorted([*heap, a + b])
        assert cost == int((counts * lengths).sum())
    ids = rng.choice(np.flatnonzero(counts), 5000)
    sizes = np.array([0, 1, 255, 256, 257, 4231])
    payload, starts, n_bytes, at = huffman.encode_streams(ids, sizes, huffman.canonical(lengths), lengths)
    marks = np.concatenate([at[f:f + s:huffman.STRIDE] for f, s in zip(np.cumsum(sizes) - sizes, sizes)])
    out = huffman.decode_streams(payload.tobytes(), marks, huffman.stretch_sizes(sizes), huffman.decode_table(lengths))
    assert out.tolist() == ids.tolist()


def test_files_give_the_ids_back(spark, docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = huffman.round_trip(docs, path, scratch_path(spark, "huffman")).collect()
    crc = lambda t: zlib.crc32(bpe.encode([t or ""], path)[0] + bytes(4))
    size = lambda t: len(bpe.encode([t or ""], path)[0]) // 4 + 1
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == sorted(
        ((d, size(t), crc(t)) for d, t, *_ in ROWS), key=repr)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0] + [r.n_tokens for r in ordered])[:-1].tolist()
    ids = [-1 if r.doc_id is None else r.doc_id for r in ordered]
    assert ids == sorted(ids)
    assert huffman.round_trip(none, path, scratch_path(spark, "huffman")).count() == 0


def test_wide_ids_do_not_wrap(spark):
    path, end = public_tokenizers.path("byte_bpe_50k.json"), 70_000
    few = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in huffman.round_trip(few, path, scratch_path(spark, "huffman"), end).collect()}
    for doc, text in ((1, "one two"), (2, "")):
        ids = np.append(np.frombuffer(bpe.encode([text], path)[0], "<u4"), np.uint32(end)).astype("<u4")
        assert got[doc] == (len(ids), zlib.crc32(ids.tobytes()))
    assert huffman.id_type(1 << 16) == "<u2" and huffman.id_type((1 << 16) + 1) == "<u4"


def test_packing_is_gapless_and_close_to_the_bound(spark, docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack(packing.pieces(docs, path)).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        held.sort()
        assert [o for o, _ in held] == np.cumsum([0] + [n for _, n in held])[:-1].tolist() and sum(n for _, n in held) <= 1024
    library, want = Tokenizer.from_file(path), []
    for doc, text, *_ in ROWS:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        for k, start in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[start:first if k == 0 else start + 1024]
            want.append((doc, k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(want)
    assert max(Counter(d for d, *_ in want).values()) > 3  # texts far over the limit are among them
    assert packing.pack(packing.pieces(none, path)).count() == 0


def test_two_documents_replace_the_smallest():
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10) == [([6, 2, 2], 1), ([3], 1)]
    lengths = rng.integers(1, 1025, 5000)
    plan = packing.best_two_fit(dict(Counter(lengths.tolist())), 1024)
    assert Counter(length for held, times in plan for length in held for _ in range(times)) == Counter(lengths.tolist())
    assert sum(times for _, times in plan) <= 1.02 * -(-lengths.sum() // 1024)


def test_mix_meets_targets(spark, none):
    many = spark.range(6000).selectExpr(
        "id AS doc_id", "repeat('w ', 5 + int(id % 7)) AS text", "CASE WHEN id % 3 = 0 THEN 'big' WHEN id % 50 = 1 THEN NULL WHEN id % 9 = 1 THEN 'a' ELSE 'z' END AS source")
    got = mixing.copies(mixing.sizes(many)).selectExpr("source", "size", "source_size", "target", "copies").toPandas()
    by = got.assign(taken=got.size * 0 + got["size"] * got["copies"]).groupby("source", dropna=False).agg(
        taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert (abs(by.taken - by.target) < 0.1 * by.target).all() and (by.target <= 2 * by["size"] + 1e-6).all()
    assert abs(by.target.sum() - 1.5 * by["size"].sum()) < 1e-3 and got["copies"].max() <= 2
    mixed = mixing.mix(many)
    assert mixed.columns == many.columns and mixed.count() == got["copies"].sum()
    assert mixing.mix(none).count() == 0
    clashing = many.selectExpr("*", "'x' AS _source", "1 AS _rate", "2 AS _times", "3 AS target", "4 AS copies", "5 AS _row", "6 AS _by")
    assert mixing.mix(clashing).columns == clashing.columns and mixing.mix(clashing).count() == mixed.count()
    assert mixing.copies(mixing.sizes(clashing, columns=("doc_id", "source", "target", "copies"))).agg({"copies": "sum"}).first()[0] == mixed.count()


def test_cheap_rules_come_first_every_time(spark):
    texts = [(" ".join(f"w{i}x{k}" for k in range(30)) + ("" if i % 4 else "x" * 400),) for i in range(400)]
    held = spark.createDataFrame(texts, "text string").selectExpr("*", "'l' AS _lines", "'h' AS _hashes")
    # Both reject the same rows; the dear one digests the text many times over.
    dear = quality.Rule("dear", (F.length(F.sha2(F.repeat("text", 300), 512)) > 0) & (F.col("word_chars") > 300))
    cheap = quality.Rule("cheap", F.col("word_chars") > 300)
    never = quality.Rule("never", F.col("n_words") < 0)
    measured = quality.base_measures(held)
    orders = [[r.name for r in quality.order_rules(measured, [dear, never, cheap])] for _ in range(3)]
    assert orders == [orders[0]] * 3 and orders[0][0] == "cheap"
    out = quality.cascade(held, rules=[dear, cheap])
    assert out.select("_lines", "_hashes").distinct().collect() == [("l", "h")] and out.where("kept").count() == 300


@pytest.mark.parametrize("kw", [{}, {"block": 2}])
def test_jaccard_groups(spark, none, kw):
    base = prose(200).split()
    texts = list(TEXTS)
    for k in range(12):  # a chain of near copies, some of them equal in size
        base = [*base[:15 * k], f"new{k % 5}", *base[15 * k + 1:]]
        texts += [" ".join(base), " ".join(base).upper()]
    held = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(None, SHARED, None, None, None)]

    def shingles(t):
        w = [x.lower() for x in WORD.findall(t or "")]
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

    sets = {i: shingles(t) for i, t, *_ in held if i is not None}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = ngram_join.jaccard_groups(spark.createDataFrame(held, DOCS), **kw)
    want = [(i, len(sets[i]) if i is not None else len(shingles(SHARED)), root.get(i)) for i, *_ in held]
    assert rows(got) == sorted(want, key=repr)
    assert ngram_join.jaccard_groups(none).count() == 0


def test_tree_walk_finds_all_plausible_pairs():
    sets = [np.unique(rng.choice(60, 40)) for _ in range(60)]
    entries = [(i, len(s), i, 0, s[1:12].tolist()) for i, s in enumerate(sets) if s[0] == 0]
    found = set(ngram_join.traverse(entries, None, 60))
    for a, *_ in entries:
        for b, *_ in entries:
            shared = len(np.intersect1d(sets[a], sets[b]))
            if a < b and 100 * shared >= 60 * (len(sets[a]) + len(sets[b]) - shared):
                assert (a, b) in found


def test_suffix_ranks_are_those_of_sorting(spark):
    strings = [rng.integers(0, 3, n).tolist() for n in rng.integers(1, 30, 20)] + [[1] * 40, [1] * 39, [0, 1] * 12, [5]]
    held = [(s, i, x) for s, t in enumerate(strings) for i, x in enumerate(t)]
    suffixes = sorted(tuple(strings[s][i:]) for s, i, _ in held)
    want = sorted((s, i, suffixes.index(tuple(strings[s][i:]))) for s, i, _ in held)
    assert rows(suffix_ranks(spark.createDataFrame(held, "sid bigint, i bigint, s bigint"), 64)) == sorted(want, key=repr)


@pytest.mark.parametrize("depth", [3, 9])
def test_repeated_strings_go(spark, docs, none, depth):
    texts = [(t or "").encode() for _, t, *_ in ROWS]
    count = Counter(t[i:i + 200] for t in texts for i in range(len(t) - 199))
    want = []
    for (doc, *_), t in zip(ROWS, texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if count[t[i:i + 200]] > 1:
                gone[i:i + 200] = True
        left = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((doc, len(t), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    assert rows(suffix_dedup.dedup_digests(docs, depth)) == sorted(want, key=repr)
    assert suffix_dedup.dedup_digests(none).count() == 0
    cut = suffix_dedup.without_repeats(docs, depth)
    assert cut.columns == docs.columns and cut.count() == len(ROWS)
    assert all("�" not in r.text for r in cut.collect())


def test_the_order_of_suffixes_settles_repeats(spark, monkeypatch):
    passage, other = prose(400), prose(400)
    texts = [prose(50) + passage + prose(50), prose(30) + passage, prose(90) + other, prose(200)]
    held = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    keyed = held.selectExpr("unhex(md5(text)) AS key", "text")
    found = suffix_dedup._anchor_rows(keyed)
    cores = found.groupBy("core").count().where("count > 1").select("core")
    marked = suffix_dedup.settled_anchors(materialise(found.join(cores, "core", "left_semi"), "found"))
    shares = [r["count"] for r in marked.groupBy("settled").count().orderBy("settled").collect()]
    assert shares[1] > 3 * shares[0]  # most anchors of a long passage are settled by the order
    right = rows(suffix_dedup.dedup_digests(held))
    # Wrong ranks give wrong rows: only what stands beside a suffix is looked at.
    monkeypatch.setattr(suffix_dedup, "suffix_ranks", lambda strings, depth: strings.selectExpr("sid", "i", "CAST(0 AS BIGINT) AS rank"))
    assert rows(suffix_dedup.dedup_digests(held)) != right


def test_cached_pieces_give_the_librarys_ids(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    hard = [
        "", " ", "a", " a", "a ", "  x  y", "<|endoftext|>", "x <|endoftext|> y", "é è ñ", "\0 \0a b", "don't 's x 's",
        "x \n y", "日本 語 x", "a​ b", "     a", "x\tb c", "ÿ Ā ɏ ə x", "× ÷ ª º ¼", "a" * 5000 + " b",
    ]
    # More different words than two small generations hold, so old pieces come back and others are encoded again.
    texts = hard + [" ".join(f"w{(i * j) % 997}é" for j in range(200)) for i in range(60)] + hard
    library = Tokenizer.from_file(path)
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    monkeypatch.setattr(bpe, "CACHE_PIECES", 50)
    monkeypatch.setattr(bpe, "JOINED", 7)
    bpe._cache.cache_clear()
    got = [b for at in range(0, len(texts), 3) for b in bpe.encode(texts[at:at + 3], path)]
    bpe._cache.cache_clear()
    assert got == want


def test_common_words_skip_the_librarys_whole_way(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    atoms = ["a", "b", "'", "'s", "'ll", " ", "  ", "\n", "\t", "\r", "\x0b", "\x85", "\xa0", "é", "Ø", "×", "÷", "ª", "µ", "1", "23", "½", "<|endoftext|>",
             "<|", "日本", "🙂", "\xad", "ɏ", "ɐ", "ǅ", ".", ",", "!!", "\0", "don't", "I'RE", "_", "٣"]
    rng = np.random.default_rng(7)
    odd = ["".join(rng.choice(atoms, rng.integers(0, 14))) for _ in range(3000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in bpe._library(path).encode_batch_fast(odd, add_special_tokens=False)]
    bpe.forget()
    assert bpe.encode(odd, path) == want
    plain = ["alphabetagamma, (alphabetagamma) don't\n\nAlphabêta.", "alphabetagamma.\nalphabetagamma 12"]
    want = [np.array(e.ids, "<u4").tobytes() for e in bpe._library(path).encode_batch_fast(plain, add_special_tokens=False)]
    bpe.forget()
    seen = []

    class Library:
        def __getattr__(self, name):
            return getattr(library, name)

        def encode_batch_fast(self, texts, **kw):
            seen.extend(texts)
            return library.encode_batch_fast(texts, **kw)

    library = bpe._library(path)
    monkeypatch.setattr(bpe, "_library", lambda _: Library())
    assert bpe.encode(plain, path) == want and not seen
    bpe.forget()


def test_words_are_cut_as_the_library_cuts_them_and_looked_up_once_a_batch(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    atoms = ["a", "bc", "'", "'s", "'t", "'re", "'ll", "'ve", "'m", "'d", " ", "  ", "\n", "\t", "\r", "é", "×", "÷", "ɏ", "1", "23", ".", "!!", "e", "l"]
    rng = np.random.default_rng(11)
    texts = ["".join(rng.choice(atoms, rng.integers(0, 12))) for _ in range(4000)]
    cut = bpe._library(path).pre_tokenizer.pre_tokenize_str
    raw = "".join(t + "\0" for t in texts).encode()
    want, at = [], 0
    for text in texts:
        for _, (start, _) in cut(text):
            want.append(at + len(text[:start].encode()))
        at += len(text.encode())
        want.append(at)
        at += 1
    assert bpe.word_starts(np.frombuffer(raw, np.uint8)).tolist() == want

    held = [np.array(e.ids, "<u4").tobytes() for e in bpe._library(path).encode_batch_fast(texts, add_special_tokens=False)]
    bpe.forget()
    asked, of_words = [], bpe._Cache.of_words
    monkeypatch.setattr(bpe._Cache, "of_words", lambda self, words: asked.append(list(words)) or of_words(self, words))
    monkeypatch.setattr(bpe, "CACHE_WORDS", 40)
    monkeypatch.setattr(bpe, "JOINED_WORDS", 7)
    got = [ids for at in range(0, len(texts), 50) for ids in bpe.encode(texts[at:at + 50], path)]
    bpe.forget()
    assert got == held
    assert len(asked) == 80 and all(len(words) == len(set(words)) for words in asked)


def test_anchors_of_joined_texts_are_those_of_each():
    rng = np.random.default_rng(5)
    whole = rng.integers(97, 101, 4000).astype(np.uint8).tobytes()
    texts = [whole[:n] for n in (0, 199, 200, 0, 201, 3000, 74, 4000, 200)]
    got = suffix_dedup.anchors(texts)
    for i, text in enumerate(texts):
        for mine, alone in zip(got[1:], suffix_dedup.anchors([text])[1:]):
            assert mine[got[0] == i].tolist() == alone.tolist()


def test_runs_of_candidates_have_their_symbols_and_names(spark):
    texts = []
    for key, n in enumerate(rng.integers(1, 60, 12)):
        ordinal = np.flatnonzero(rng.random(n) < 0.8)
        texts += [(bytes([key]), int(o), int(30 * o + rng.integers(0, 30)), int(rng.integers(0, 1 << 62)), 0, 1) for o in ordinal]
    names = ["key", "ordinal", "at", "core", "first", "last"]
    found = spark.createDataFrame(texts, "key binary, ordinal bigint, at bigint, core bigint, first bigint, last bigint").repartition(5)
    got = {(bytes(r.key), r.at): r for r in suffix_dedup._strings(found, 9).collect()}
    runs = []
    for row in sorted(texts):
        if not (runs and runs[-1][-1][0] == row[0] and runs[-1][-1][1] == row[1] - 1):
            runs.append([])
        runs[-1].append(row)
    assert len(got) == len(texts) and len({r.sid for r in got.values()}) == len(runs)
    by_name = {}
    for run in runs:
        at, core = [r[2] for r in run], [r[3] for r in run]
        symbols = [c >> 7 << 7 | (b - a if b is not None else 127) for c, a, b in zip(core, at, [*at[1:], None])]
        for i, row in enumerate(run):
            mine = got[row[0], row[2]]
            assert (mine.i, mine.sid) == (i, got[run[0][0], run[0][2]].sid)
            assert (mine.s, mine.t1, mine.t2) == tuple((symbols[i:] + [-1, -1])[:3])
            far = [k for k in range(i, min(i + 9, len(run))) if i + 1 < len(run) and at[k] >= at[i + 1] + 59]
            assert (mine.own is not None) == bool(far)
            if far:
                by_name.setdefault(mine.own, set()).add((tuple(core[i:far[0] + 1]), tuple(a - at[i] for a in at[i:far[0] + 1])))
    assert by_name and all(len(covered) == 1 for covered in by_name.values())
    # The same rows in other batches, a text over several of them and none of its bounds at theirs.
    table = pa.Table.from_pylist([dict(zip(names, r)) for r in sorted(texts)])
    for size in (1, 7, 1000):
        cut = list(suffix_dedup._by_keys(table.to_batches(size)))
        assert pa.concat_tables(cut).equals(table)
        assert sum(len(set(part.column(0).to_pylist())) for part in cut) == len({r[0] for r in texts})


def test_copied_texts_go_whole_beside_ranges_and_single_starts(spark):
    passage = prose(200)
    texts = [prose(60) + passage + prose(60), prose(40) + passage, "x" * 900, passage[:230] + prose(70), prose(80)]
    held = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0], texts[2]])], "doc_id bigint, text string")
    keyed = held.selectExpr("doc_id", "unhex(md5(text)) AS key", "text")
    copied = keyed.groupBy("key").count().where("count > 1").select("key")
    distinct = keyed.dropDuplicates(["key"]).select("key", "text")
    marks = suffix_dedup.repeated_ranges(distinct, copied).collect()
    alone = {bytes(r.key) for r in copied.collect()}
    count = Counter(t[i:i + 200] for t in [*texts, texts[0], texts[2]] for i in range(len(t) - 199))
    want = {hashlib.md5(t.encode()).digest(): {i for i in range(len(t) - 199) if count[t[i:i + 200]] > 1} for t in texts}
    got = {bytes(m.key): {i for r in m.ranges or [] for i in range(r.first, r.last + 1)} | set(m.starts or []) for m in marks}
    assert not alone & got.keys()
    assert got == {k: v for k, v in want.items() if v and k not in alone}


def test_ranges_are_read_as_arrays():
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    held = pa.array([[{"first": 1, "last": 2}], None, [], [{"first": 5, "last": 9}, {"first": 7, "last": 7}]], kind).slice(1)
    fields = lambda x: [a.tolist() for a in suffix_dedup._fields(x, "first", "last")]
    assert not held[0].is_valid and fields(held[1]) == [[], []] and fields(held[2]) == [[5, 7], [9, 7]]


def test_prefixes_are_kept_once_and_listed(spark):
    held = [(1, "a b c d e f g h i j k l"), (2, ""), (3, None), (4, "one two"), (5, "x " * 40 + "y")]
    docs = spark.createDataFrame(held, "doc_id bigint, text string")
    order = spark.sparkContext.broadcast(ngram_join.Order(np.zeros(0, np.uint64), 80))
    kept = materialise(ngram_join._prefixes(docs, order, 5), "keys")
    want = []
    for i, text in held:
        values = ngram_join.sets_of(pa.RecordBatch.from_arrays([pa.array([text], pa.string())], names=["t"]), 0, 5)
        for v in values:
            keys = order.value.prefix(v)
            assert order.value.short(keys).tolist() == order.value.short_prefix(v).tolist()
            want += [(k, i, len(v)) for k in keys.view(np.int64).tolist()]
    assert rows(ngram_join._listed(kept)) == sorted(want, key=repr) and len(want) > 3
