"""The chain of stages as a whole against brute force: rules, near copies, repeated strings, mix, packing."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Beside the columns of documents, names that operators might use themselves.
COLUMNS = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "_rate double, _times int, _row string, _text string, key string, ranges string, component_id bigint, kept string"
)


def fixture():
    rng = np.random.default_rng(11)
    prose = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 9000, n))
    passage, accents = prose(70), "é" * 130
    texts = [prose(int(n)) for n in rng.integers(20, 400, 40)]
    texts += [prose(80) + " " + passage + " " + prose(90) for _ in range(4)]
    texts += [prose(60) + " " + accents + " " + prose(60) for _ in range(3)]
    near = prose(300).split()
    texts += [" ".join([*near[:k], "other", *near[k + 1:]]) for k in (10, 100, 200)] + [" ".join(near)] * 3
    texts += [None, "", " \n\t", "too short", "### *** " * 30, "x " * 400, "same line of words\n" * 30, prose(3000), prose(1) * 3]
    texts += ["\n".join(f"- {prose(3)}" for _ in range(20)), "\n".join(f"{prose(4)}..." for _ in range(20)), "1234 " * 12 + prose(10)]
    rows = [(i, t, ("b", "a", None, "c")[i % 4]) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, prose(120), "a"), (None, None, None), (7, prose(50), "c")]
    return [(d, t, "xx", s, len(t or ""), 0.5, 2, "row", "text", "key", "ranges", 9, "kept") for d, t, s in rows]


def passes(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered.update(range(i, i + 5))
    n, chars = len(words), sum(map(len, words))
    return not (
        n < 10 or 100 * len(covered) > 20 * n or not 2 * n <= chars <= 15 * n or 10 * sum(c in "#*$%&|<>" for c in text) > n
        or 2 * (len(lines) - len(set(lines))) > len(lines) or 10 * len(re.findall(r"(?m)^[ \t]*[-*•]", text)) > 9 * len(lines)
        or 10 * len(re.findall(r"(?m)(?:\.\.\.|…)[ \t]*$", text)) > 5 * len(lines)
        or 10 * sum(any(c.isalpha() for c in w) for w in words) < 6 * n
    )


def one_of_each_group(rows):
    def shingles(text):
        w = [x.lower() for x in WORD.findall(text)]
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    held = [(d, shingles(t)) for d, t, _ in rows if d is not None]
    root = {d: d for d, _ in held}
    for _ in held:
        for a, x in held:
            for b, y in held:
                if 100 * len(x & y) >= 80 * len(x | y):
                    root[a] = root[b] = min(root[a], root[b])
    out, seen = [], set()
    for d, t, s in rows:
        if d is None or (root[d] == d and (d, t) not in seen):
            seen.add((d, t))
            out.append((d, t, s))
    return out


def without_repeats(rows):
    raw = [t.encode() for _, t, _ in rows]
    times = Counter(t[i:i + 200] for t in raw for i in range(len(t) - 199))
    out = []
    for (d, text, s), t in zip(rows, raw):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if times[t[i:i + 200]] > 1:
                gone[i:i + 200] = True
        at, left = 0, []
        for c in text:
            size = len(c.encode())
            if not gone[at:at + size].any():
                left.append(c)
            at += size
        out.append((d, "".join(left), s))
    return out


def mixed(rows):
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(WORD.findall(t))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, budget, free = {}, 1.5 * sum(size.values()), set(names)
    while free:
        unit = budget / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * unit >= 2 * size[s]}
        for s in above or free:
            target[s] = 2 * size[s] if above else weight[s] * unit
        budget -= sum(target[s] for s in above)
        free = free - above if above else set()
    out = []
    for d, t, s in rows:
        rate = target[s] / size[s] if size[s] else 0
        draw = int(hashlib.md5(f"mix-1:{'null' if d is None else d}".encode()).hexdigest()[:13], 16) / 16**13
        out += [(d, t)] * (int(rate) + (draw < rate - int(rate)))
    return out


def pieces(rows):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for d, t in rows:
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        for k, start in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[start:first if k == 0 else start + 1024]
            yield d, k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())


def test_chain_against_brute_force(spark, tmp_path):
    rows = fixture()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    good = [(d, t, s) for d, t, _, s, *_ in rows if passes(t)]
    single = one_of_each_group(good)
    cut = without_repeats(single)
    # Every stage has something to do here, and not all to take.
    assert len(rows) > len(good) > len(single) > 40 and 0 < sum(a != b for a, b in zip(single, cut)) < len(cut) / 2
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(pieces(mixed(cut)))
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        held.sort()
        assert [o for o, _ in held] == np.cumsum([0] + [n for _, n in held])[:-1].tolist() and sum(n for _, n in held) <= 1024


def test_stages_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
