"""Archives, vectors, conversations and the pipeline."""

import gzip
import hashlib

import duckdb
import numpy as np
import pytest

from querysieve.llm import chat, graph, near_vectors, warc
from querysieve.llm.oracle import ORACLE
from querysieve.llm.queries import QUERIES
from querysieve.session import scratch_path
from tools.check import TABLES, rows_of

PAGES = "page_id bigint, url string, html string, digest string, record string"
BODY = "<p>é\x00 WARC/1.1\r\n</p>" * 20
ROWS = [
    (5, "http://a/\n x", BODY, "d", "r"), (3, None, BODY, "d", "r"), (3, "u", BODY, "d", "r"), (9, "u", BODY, None, None), (None, "u", BODY, None, None),
    (1, "u", None, None, None), (2, "u", "", None, None), (4, "u", "short", None, None), (6, "u", "short", None, None), (7, "u", "z" * 300_000, None, None),
]


def test_every_llm_oracle(spark, sf):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in ORACLE.items():
        df, cur = QUERIES[name](spark, sf), db.execute(sql)
        assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall()), name


@pytest.mark.parametrize("compress", [True, False])
def test_archives_come_back(spark, compress):
    path = scratch_path(spark, "warc")
    warc.write_archives(spark.createDataFrame(ROWS, PAGES).repartition(2), path, compress, per_file=3)
    found = warc.read_archives(spark, path).collect()
    assert {r.kind for r in found} == {"record"}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(p, len((h or "").encode()), sha(h), "revisit" if h == BODY and p != 3 else "response", 3 if h == BODY and p != 3 else None)
            for p, _, h, *_ in ROWS]
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert all(bytes(r.payload) == (BODY if r.page_id == 3 else "z" * 300_000).encode() for r in found if r.page_id in (3, 7))


def test_no_pages(spark):
    path = scratch_path(spark, "warc")
    warc.write_archives(spark.createDataFrame([], PAGES), path)
    assert warc.read_archives(spark, path).count() == 0


@pytest.mark.parametrize("compress", [True, False])
def test_salvage_recovers_later_records(compress):
    def record(i):
        body = f"HTTP/1.1 200 OK\r\n\r\npage {i} ".encode() + bytes([i]) * 400
        digest = hashlib.sha256(body.partition(b"\r\n\r\n")[2]).hexdigest()
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Payload-Digest: sha256:{digest}\r\n"
        head += f"Content-Type: application/http\r\nContent-Length: {len(body)}\r\n\r\n"
        return head.encode() + body + b"\r\n\r\n"

    units = [warc.member(record(i)) if compress else record(i) for i in range(8)]
    bounds = np.cumsum([0] + [len(u) for u in units])
    data = bytearray(b"".join(units))
    data[bounds[2] + 120] ^= 255  # inside the third record
    del data[bounds[5] + 40:bounds[5] + 60]  # bytes lost in the sixth
    data += units[0][:50]  # cut off at the end
    found = list(warc.scan(bytes(data)))
    assert [r["page_id"] for r in found if r["kind"] == "record"] == [0, 1, 3, 4, 6, 7]
    gaps = [(r["start"], r["end"]) for r in found if r["kind"] == "gap"]
    pad = len(warc.PADDING) if compress else 0  # the empty member behind a damaged one is whole
    assert gaps == [(bounds[2], bounds[3] - pad), (bounds[5], bounds[6] - 20 - pad), (bounds[8] - 20, len(data))]
    assert list(warc.scan(b"")) == [] and [r["kind"] for r in warc.scan(b"rubbish")] == ["gap"]


def test_salvage_looks_inside_members():
    rng = np.random.default_rng(3)

    def record(i):
        body = b"HTTP/1.1 200 OK\r\n\r\n" + rng.bytes(40_000)
        digest = hashlib.sha256(body.partition(b"\r\n\r\n")[2]).hexdigest()
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Payload-Digest: sha256:{digest}\r\n"
        return f"{head}Content-Type: application/http\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    records = [record(i) for i in range(6)]
    inner = np.cumsum([0] + [len(r) for r in records])
    whole, after = gzip.compress(b"".join(records), mtime=0), warc.member(record(9))
    pages = lambda found: [r["page_id"] for r in found if r["kind"] == "record"]
    places = lambda found: [(r["start"], r["end"], r.get("inner_start"), r.get("inner_end")) for r in found if r["kind"] == "gap"]

    bad = bytearray(b"".join(records))
    bad[inner[2] + 5000] ^= 255  # the digest of one record in a whole member
    found = list(warc.scan((member := gzip.compress(bytes(bad), mtime=0)) + after))
    assert pages(found) == [0, 1, 3, 4, 5, 9] and places(found) == [(0, len(member), inner[2], inner[3])]

    cut = whole[:int(len(whole) * 0.7)]  # the tail is lost: four records are whole
    found = list(warc.scan(cut))
    assert pages(found) == [0, 1, 2, 3] and found[-1]["reason"] == "member without end"
    assert [(a, b, c) for a, b, c, _ in places(found)] == [(0, len(cut), inner[4])]
    assert pages(warc.scan(cut + after))[:4] == [0, 1, 2, 3] and pages(warc.scan(cut + after))[-1] == 9

    whole = gzip.compress(b"".join(records) + b"A" * 3_000_000, mtime=0)
    broken = whole[:-30] + b"\xff" * 30  # the bytes go bad behind the last record
    assert pages(warc.scan(broken + after)) == [0, 1, 2, 3, 4, 5, 9]
    wrong = whole[:-8] + bytes(8)  # only the sum is wrong
    assert pages(warc.scan(wrong)) == [0, 1, 2, 3, 4, 5]


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "src bigint, dst bigint")).collect()}
    want = dict.fromkeys(range(61), 0) | dict.fromkeys(range(100, 160), 100) | {200: 200, 201: 200}
    assert got == want


@pytest.mark.parametrize("kw", [{}, {"cell_target": 20, "block": 8}])
def test_vectors_against_brute_force(spark, kw):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 8))
    near = [x[i % 6] + rng.normal(size=8) * 0.12 for i in range(60)]
    vectors = [*x, *near, x[0] * 3, x[1], x[1]]
    held = [(i, [float(f) for f in v]) for i, v in enumerate(vectors)]
    odd = [(900, None), (901, []), (902, [0.0] * 8), (903, [float("nan")] * 8), (904, [float("inf")] * 8), (905, [1.0, None]), (906, [1.0, 2.0]), (None, [1.0] * 8)]
    unit = np.stack(vectors) / np.linalg.norm(np.stack(vectors), axis=1)[:, None]
    linked = unit @ unit.T >= 0.95 - 1e-12
    np.fill_diagonal(linked, False)
    root = np.arange(len(vectors))
    for _ in vectors:
        root = np.minimum(root, np.where(linked, root[None], len(root)).min(1))
    want = [(i, int(linked[i].sum()), int(root[i]), bool(root[i] == i)) for i in range(len(vectors))]
    want += [(i, 0, i, i is not None) for i, _ in odd]
    df = spark.createDataFrame(held + odd, "vec_id bigint, embedding array<double>")
    got = sorted((tuple(r) for r in near_vectors.near_duplicates(df, **kw).collect()), key=repr)
    assert got == sorted(want, key=repr)
    assert near_vectors.near_duplicates(df.limit(0)).count() == 0


def test_vectors_travel_packed_and_meet_in_bounded_tiles(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 16))
    x[300:] = x[rng.integers(0, 100, 100)] + rng.normal(size=(100, 16)) * 0.1
    kept, write = {}, near_vectors.materialise
    monkeypatch.setattr(near_vectors, "materialise", lambda df, name="table": kept.setdefault(name, write(df, name)))
    monkeypatch.setattr(near_vectors, "TILE_ROWS", 7)
    monkeypatch.setattr(near_vectors, "TILE_COLUMNS", 11)
    monkeypatch.setattr(near_vectors, "MOST_WAITING", 5)
    df = spark.createDataFrame([(i, [float(f) for f in v]) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors.near_duplicates(df, cell_target=40, block=100).collect()}
    # A vector is one row of its cell, however many cells it is compared in, and one place of one block.
    assert kept["cells"].count() == 400 and kept["cells"].select("node").distinct().count() == 400
    assert sum(len(r["nodes"]) for r in kept["blocks"].collect()) == 8 * 400
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    row, col = np.nonzero(linked)
    root = near_vectors.union(np.arange(400), row, col)
    assert linked.any() and got == {i: (int(linked[i].sum()), int(root[i])) for i in range(400)}


def test_screen_of_vectors_is_never_below_the_product():
    x = near_vectors.normalised(np.random.default_rng(7).normal(size=(300, 40)) + 0.4)
    screen = near_vectors.screened(x, near_vectors.leading_axes(x))
    assert screen.shape == (300, 17) and (screen @ screen.T >= x @ x.T - near_vectors.SLACK).all()
    mixed = [*near_vectors.as_bytes(np.array([[0.5, 2.0]])), *near_vectors.as_bytes(np.array([[0.1, 1e300]]))]
    assert [len(v) for v in mixed] == [8, 16]
    packed = near_vectors.pack(near_vectors.pd.DataFrame({"size": 2, "block": 0, "cell": [1, 0], "node": [5, 6], "weight": [1, 2], "vec": mixed}))
    block = near_vectors._Block(packed, 2, np.eye(2))
    assert block.node.tolist() == [6, 5] and block.weight.tolist() == [2, 1] and np.allclose(block.x[1], np.array([0.5, 2.0]) / np.sqrt(4.25))


EVENTS = "conv_id bigint, slot int, seq int, kind string, role string, text string, formatted string"


def test_events_fold_into_final_messages(spark):
    log = [
        (1, 0, 1, "open", "user", None), (1, 0, 2, "delta", None, "Hel"), (1, 0, 3, "delta", None, "lo"),
        (1, 1, 4, "open", "assistant", None), (1, 1, 5, "delta", None, "bad"), (1, 2, 6, "open", "user", None), (1, 2, 7, "delta", None, "gone"),
        (1, 1, 8, "regenerate", None, None), (1, 1, 9, "delta", None, "good"), (1, 2, 10, "open", "user", None), (1, 2, 11, "delta", None, "new"),
        (1, 0, 12, "edit", None, "Hi"), (1, 0, 13, "delta", None, "!"),
        (2, 0, 1, "open", "assistant", None), (2, 0, 2, "delta", None, "x"), (2, 1, 3, "open", "user", None), (2, 0, 4, "regenerate", None, None),
        (None, 0, 1, "open", None, None), (None, 0, 2, "delta", None, None),
    ]
    got = chat.fold(spark.createDataFrame([(*r, "clash") for r in log][::-1], EVENTS))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(
        [(1, 0, "user", "Hi!"), (1, 1, "assistant", "good"), (1, 2, "user", "new"), (2, 0, "assistant", ""), (None, 0, "", "")], key=repr)


def test_escapes_are_reversible(spark):
    hard = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<\\s>", "<", "[", "a</s", "<<s>>", "[INST][/INST]</s>", "", "é\\[INST]", "\\n", "x" * 5000, None]
    held = [(1, i, "assistant" if i % 2 else "</s>\\", t) for i, t in enumerate(hard)] + [(2, 0, None, "a"), (2, 0, None, "a"), (None, 0, "user", "b")]
    df = spark.createDataFrame(held, "conv_id bigint, turn bigint, role string, text string")
    formatted = chat.render(chat.fold(chat.as_events(df)))
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r, t or "") for _, _, r, t in held[:len(hard)]]
    assert got[1].learned == "".join(t or "" for t in hard[1::2])
    assert [(t.role, t.text) for t in got[2].turns] == [("", "a")] * 2 and got[None].turns[0].text == "b"
    assert chat.read_back(chat.render(chat.fold(chat.as_events(df.limit(0))))).count() == 0


def test_pipeline_stages_take_effect(spark, sf):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(cp.STAGES):
        from querysieve.session import materialise

        before, docs = docs, materialise(stage(spark, docs, sf), "stage")
        assert docs.count() > 0
        if k < 4:
            assert docs.columns == columns, name
        if k == 1:
            from querysieve.llm.ngram_join import jaccard_groups

            assert jaccard_groups(docs).where("doc_id != component_id").count() == 0 and docs.count() < before.count()
        if k == 2:
            assert docs.count() == before.count()
    assert set(docs.columns) >= {"doc_id", "piece", "sequence_id", "offset"}
