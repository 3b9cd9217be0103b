"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products, one representative per group.

The cells are fitted on a bounded sample (``SAMPLE`` vectors with the smallest id digests); every vector is then
assigned. A pair with cosine >= ``threshold`` lies at most one chord apart, so of two cells only the vectors within the
chord of their bisector are compared: no pair is lost, and each is compared once. Whole cells are put together to
blocks, large ones are cut; a block travels packed, once for each block it meets, and one task compares two blocks and
returns a link count per vector and the group it is in, never the pairs. Inside a task, tiles of bounded size are
screened by a few coordinates and the length of the rest, which bounds a product from above; what passes is computed.

On directions without clusters a chord crosses many bisectors and the cells spare only a part of all
comparisons; ``margin`` below 1 compares within that part of the chord and may lose links.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing, nor do vectors
of different lengths; a null id keeps a null component and is not kept; rows with equal ids are compared as rows of
their own; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from querysieve.llm.graph import components
from querysieve.session import materialise, ship

THRESHOLD = 0.95
SAMPLE = 20_000
CELL_TARGET = 4096
MAX_CELLS = 4096
ROUNDS = 8
# Vectors of a block: small tables make some blocks for all cores, a large one, of 64 numbers each, is what a worker holds twice.
LEAST_BLOCK, MOST_BLOCK, SOME_BLOCKS = 2048, 1 << 15, 8
# Vectors of a packed row, numbers of a matrix made at a time, tasks of a stage.
PACKED_ROWS, MOST_CELLS_AT_ONCE, MOST_PARTITIONS = 2048, 1 << 22, 4096
# Rows and columns of a tile; leading coordinates of the screen and the error it may have as 4-byte numbers.
TILE_ROWS, TILE_COLUMNS, LEADING, SLACK = 256, 4096, 16, 1e-5
# Links that wait until groups are put together.
MOST_WAITING = 1 << 18
PACKED = "size int, block int, part int, cells binary, nodes binary, weights binary, vecs binary"


def normalised(rows: list[np.ndarray] | np.ndarray) -> np.ndarray:
    x = np.asarray(rows, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest_cell(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    step = max(1, MOST_CELLS_AT_ONCE // len(centres))
    return np.concatenate([(x[at:at + step] @ centres.T).argmax(axis=1) for at in range(0, len(x), step)])


def fit_cells(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means: unit centres with the largest cosine to their members."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        cell = nearest_cell(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centres)
    return centres


def leading_axes(x: np.ndarray, n: int = LEADING) -> np.ndarray:
    """At most ``n`` orthonormal columns that hold much of the rows' length."""
    start = np.random.default_rng(0).normal(size=(x.shape[1], min(n, x.shape[1])))
    return np.linalg.qr(x.T @ (x @ start) + 1e-9 * start)[0]


def screened(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Coordinates on the axes and the length of the rest: their products are not below those of the unit rows."""
    head = x @ axes
    rest = np.sqrt(np.maximum(0.0, 1 - np.square(head).sum(axis=1, keepdims=True)))
    return np.hstack([head, rest]).astype(np.float32)


def within(x: np.ndarray, own: np.ndarray, other: np.ndarray, chord: float) -> np.ndarray:
    """Which rows of the cell ``own`` lie within the chord of its bisector with ``other``."""
    apart = own - other
    return x @ apart <= chord * np.linalg.norm(apart) + 1e-9


def _usable() -> Column:
    """True for a row (id, v) that takes part; both parts of the result are split by it."""
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    fine = F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
    return F.coalesce(fine & F.forall("v", number) & F.exists("v", lambda v: v != 0), F.lit(False))


def as_bytes(x: np.ndarray) -> list[bytes]:
    """Rows as 4-byte numbers where these are the same numbers, else as 8-byte ones."""
    with np.errstate(over="ignore"):
        small = x.astype("<f4")
    return [v.tobytes() for v in (small if (small == x).all() else x.astype("<f8"))]


def pack(frame: pd.DataFrame) -> pd.DataFrame:
    """A block in a few rows, sorted by cell."""
    frame, size = frame.sort_values(["cell", "node"]), int(frame["size"].iloc[0])
    rows = []
    for part, at in enumerate(range(0, len(frame), PACKED_ROWS)):
        own = frame.iloc[at:at + PACKED_ROWS]
        wide = own["vec"].map(len) > 4 * size
        vecs = own["vec"]
        if wide.any():
            vecs = vecs.where(wide, vecs.map(lambda v: np.frombuffer(v, "<f4").astype("<f8").tobytes() if len(v) == 4 * size else v))
        column = lambda c, kind: own[c].to_numpy(kind).tobytes()
        rows.append((size, int(own["block"].iloc[0]), part, column("cell", "<i4"), column("node", "<i8"), column("weight", "<i8"), b"".join(vecs)))
    return pd.DataFrame(rows, columns=["size", "block", "part", "cells", "nodes", "weights", "vecs"])


class _Block:
    """A block as a task holds it: unit rows, their screens, and where each cell begins and ends."""

    def __init__(self, packed: pd.DataFrame, size: int, axes: np.ndarray):
        packed = packed.sort_values("part")
        joined = lambda c, kind: np.concatenate([np.frombuffer(v, kind) for v in packed[c]])
        cells, self.node, self.weight = joined("cells", "<i4"), joined("nodes", "<i8"), joined("weights", "<i8")
        self.x = np.concatenate([
            normalised(np.frombuffer(v, "<f4" if len(v) == n * size // 2 else "<f8").reshape(-1, size))
            for v, n in zip(packed["vecs"], packed["nodes"].map(len))
        ])
        self.screen = screened(self.x, axes)
        ids, starts = np.unique(cells, return_index=True)
        self.cells = list(zip(ids.tolist(), starts.tolist(), [*starts[1:].tolist(), len(cells)]))


def union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each group after the pairs are linked; ``label`` has it from before."""
    while True:
        u, v = label[a], label[b]
        apart = u != v
        if not apart.any():
            return label
        a, b, u, v = a[apart], b[apart], u[apart], v[apart]
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
        while ((deeper := label[label]) != label).any():
            label = deeper


def links_of_tile(left: _Block, right: _Block, rows: np.ndarray, cols: np.ndarray, threshold: float, above: bool) -> tuple[np.ndarray, np.ndarray]:
    """Linked rows and columns; ``above``: of the pairs of a block with itself those above the diagonal."""
    row, col = np.nonzero(left.screen[rows] @ right.screen[cols].T >= np.float32(threshold - SLACK))
    if above:
        kept = rows[row] < cols[col]
        row, col = row[kept], col[kept]
    if len(row) * 16 > len(rows) * len(cols):
        linked = (left.x[rows] @ right.x[cols].T)[row, col] >= threshold
    else:
        step = max(1, MOST_CELLS_AT_ONCE // left.x.shape[1])
        linked = np.concatenate([np.zeros(0, bool), *(
            np.einsum("ij,ij->i", left.x[rows[row[at:at + step]]], right.x[cols[col[at:at + step]]]) >= threshold for at in range(0, len(row), step)
        )])
    return rows[row[linked]], cols[col[linked]]


def cell_pairs(left: _Block, right: _Block, centres: np.ndarray, chord: float, margin: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Rows and columns to compare, and whether a cell meets itself; of two cells the earlier one's vectors visit the later one."""
    alone = left is right
    for a, start, end in left.cells:
        for b, first, last in right.cells:
            rows, cols = np.arange(start, end), np.arange(first, last)
            if alone and b < a:
                continue
            if a != b:
                rows = rows[within(left.x[start:end], centres[a], centres[b], chord * (margin if a < b else 1.0))]
                cols = cols[within(right.x[first:last], centres[b], centres[a], chord * (margin if b < a else 1.0))]
            yield rows, cols, alone and a == b


def compare(group: pd.DataFrame, threshold: float, centres: np.ndarray, axes: np.ndarray, margin: float = 1.0) -> pd.DataFrame:
    """Links between the two blocks of a task, or of a block with itself."""
    size, i, j = (int(group[c].iloc[0]) for c in ("size", "i", "j"))
    left = _Block(group[group["block"] == i], size, axes)
    right = left if i == j else _Block(group[group["block"] == j], size, axes)
    n, m = len(left.node), 0 if right is left else len(right.node)
    shift = n if m else 0
    chord = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    links, label, waiting, held = np.zeros(n + m, np.int64), np.arange(n + m), [], 0
    for rows, cols, above in cell_pairs(left, right, centres, chord, margin):
        for at in range(0, len(rows), TILE_ROWS):
            some = rows[at:at + TILE_ROWS]
            for to in range(0, len(cols), TILE_COLUMNS):
                others = cols[to:to + TILE_COLUMNS]
                if above and others[-1] <= some[0]:
                    continue
                a, b = links_of_tile(left, right, some, others, threshold, above)
                if len(a):
                    np.add.at(links, a, right.weight[b])
                    np.add.at(links, b + shift, left.weight[a])
                    waiting.append((a, b + shift))
                    held += len(a)
                if held > MOST_WAITING:
                    label, waiting, held = union(label, *map(np.concatenate, zip(*waiting))), [], 0
    if waiting:
        label = union(label, *map(np.concatenate, zip(*waiting)))
    names = np.concatenate([left.node, right.node]) if m else left.node
    return pd.DataFrame({"node": names, "links": links, "root": names[label]})[links > 0]


def _blocks(cells: list[tuple[int, int]], rows: int) -> list[tuple[int, int, int]]:
    """(cell, first block, parts) for (cell, its vectors) by number: small cells share a block, large ones are cut."""
    out, block, held = [], 0, 0
    for cell, n in sorted(cells):
        parts = max(1, -(-n // rows))
        if held and held + n > rows:
            block, held = block + 1, 0
        out.append((cell, block, parts))
        held += n
        if parts > 1:
            block, held = block + parts, 0
    return out


def near_duplicates(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD,
    sample: int = SAMPLE, cell_target: int = CELL_TARGET, margin: float = 1.0, block: int | None = None,
) -> DataFrame:
    """``key, n_links, component_id, kept`` for every row."""
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    usable = rows.where(_usable())
    distinct = usable.groupBy("v").agg(F.count("*").alias("weight"), F.min("id").alias("least"))
    nodes = materialise(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")
    n = nodes.count()

    centres: dict[int, np.ndarray] = {}
    axes: dict[int, np.ndarray] = {}
    if n:
        # Digests first, vectors of the smallest ones after: no task sends a sample of its own to the driver.
        keyed = nodes.select("v", F.xxhash64("least", "node").alias("h"))
        upto = max(r["h"] for r in keyed.select("h").orderBy("h").limit(sample).collect())
        drawn = keyed.where(F.col("h") <= upto).toPandas().sort_values("h").head(sample)["v"]
        for size, part in drawn.groupby(drawn.map(len)):
            k = min(MAX_CELLS, max(1, round(n * len(part) / len(drawn) / cell_target)), len(part))
            x = normalised(np.stack(list(part)))
            centres[size], axes[size] = fit_cells(x, k), leading_axes(x)

    def assign(frames):
        for frame in frames:
            for size, part in frame.groupby(frame["v"].map(len)):
                raw = np.stack(list(part["v"])).astype(np.float64)
                home = nearest_cell(normalised(raw), centres[size]) if size in centres else 0
                yield pd.DataFrame({"size": size, "cell": home, "node": part["node"].to_numpy(), "weight": part["weight"].to_numpy(), "vec": as_bytes(raw)})

    placed = materialise(nodes.select("node", "weight", "v").mapInPandas(
        assign, "size int, cell int, node bigint, weight bigint, vec binary"
    ), "cells")
    # One row per cell: at most MAX_CELLS for each length.
    cells: dict[int, list[tuple[int, int]]] = {}
    for row in placed.groupBy("size", "cell").count().collect():
        cells.setdefault(row["size"], []).append((row["cell"], row["count"]))
    places, pairs = [], 0
    for size, own in cells.items():
        rows_in = sum(count for _, count in own)
        cut = _blocks(own, block or min(max(LEAST_BLOCK, MOST_BLOCK * 64 // max(64, size)), max(LEAST_BLOCK, -(-rows_in // SOME_BLOCKS))))
        blocks = max(first + parts for _, first, parts in cut)
        places += [(size, cell, first, parts, blocks) for cell, first, parts in cut]
        pairs += blocks * (blocks + 1) // 2
    table = spark.createDataFrame(places, "size int, cell int, first int, parts int, blocks int")
    into = (F.col("first") + F.pmod(F.xxhash64("node"), F.col("parts"))).cast("int")
    dealt = placed.join(F.broadcast(table), ["size", "cell"]).select("size", "cell", into.alias("block"), "node", "weight", "vec")
    packed = materialise(dealt.groupBy("size", "block").applyInPandas(pack, PACKED), "blocks")
    every = packed.join(F.broadcast(table.select("size", "blocks").distinct()), "size")
    met = every.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "size", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "part", "cells", "nodes", "weights", "vecs"
    )

    def compared(group: pd.DataFrame) -> pd.DataFrame:
        size = int(group["size"].iloc[0])
        return compare(group, threshold, centres.get(size, np.zeros((1, size))), axes.get(size, np.eye(size)[:, :LEADING]), margin)

    # Two blocks are worth a task of their own, however few bytes they have.
    tasks = met.repartition(min(max(1, 2 * pairs), MOST_PARTITIONS), "size", "i", "j").groupBy("size", "i", "j")
    found = materialise(tasks.applyInPandas(compared, "node bigint, links bigint, root bigint"), "found")

    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found, "node", "root")
    named = nodes.select("node", "v", "weight", "least").join(linked, "node", "left").join(groups, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "component").select(
        "v", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links")
    )
    answers = usable.join(named, "v").select("id", "links", "component_id")
    alone = rows.where(~_usable()).select("id", F.lit(0).cast("bigint").alias("links"), F.col("id").alias("component_id"))
    return answers.unionByName(alone).select(
        F.col("id").alias(key), F.col("links").alias("n_links"), "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
