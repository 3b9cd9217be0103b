"""N-gram Jaccard join by prefix trees.

Sets share one global order of their shingles: rare ones by hash, then the frequent ones by count. A pair
above the threshold has its first common shingle inside both prefixes, the first ``n - ceil(t n) + 1``
shingles of each set, so lists of documents by prefix shingle hold every such pair.

1. Equal sets become one set. Shingles that repeat often are counted (a list bounded by the documents' mean
   length, not by their number) and put last in the order.
2. Each list's documents are compared with the list's smallest one; what links is one component. Groups of
   near copies end here, without pairs among themselves.
3. Lists that still hold several components are stored as a prefix tree: ordered prefixes, sorted, each path
   sharing the partial overlap of the one before. Documents traverse it; subtrees are left as soon as the shingles
   missed exceed what the sizes allow. Long lists are cut into blocks that meet pairwise.
4. Surviving pairs of different components are compared by their whole sets.

Shingles are compared by 64-bit hashes. Defined results: null texts and texts without words have the empty set and
link with nothing; fewer words than ``n`` are one shingle; rows with one doc_id are one document of several texts in
the components; a null doc_id keeps a null component; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from querysieve.llm.graph import components
from querysieve.llm.shingles import forget, sets_of
from querysieve.llm.workers import tidied
from querysieve.session import broadcast_if_small, materialise, ship

N, PERCENT = 5, 80
FREQUENT_SHARE = 1000  # a shingle in more than one of so many documents is frequent
MAX_FREQUENT = 200_000  # length of the ordering list; it has no influence on results
BUFFER = 1_000_000
BLOCK = 512
SIDE_ROWS = 3_000_000


def needed(size: int, percent: int = PERCENT) -> int:
    """Shingles a set must share with any set it links with."""
    return -(-percent * size // 100)


class Order:
    """The global order as numbers: a rare shingle's key is its hash, a frequent one's its rank behind all hashes."""

    LATE = np.uint64(1 << 63)

    def __init__(self, frequent: np.ndarray, percent: int):
        """``frequent``: hashes of the shingles to put last, in their order."""
        place = np.argsort(frequent, kind="stable")
        self.frequent, self.rank, self.percent = frequent[place], place.astype(np.uint64), percent

    def prefix(self, held: np.ndarray) -> np.ndarray:
        """Sorted keys of the prefix of a set."""
        length = len(held) - needed(len(held), self.percent) + 1 if len(held) else 0
        keys = held >> np.uint64(1)
        if len(self.frequent) and len(held):
            at = np.minimum(np.searchsorted(self.frequent, held), len(self.frequent) - 1)
            late = self.frequent[at] == held
            keys[late] = self.rank[at[late]] | self.LATE
        return np.sort(keys)[:length]

    def short_prefix(self, held: np.ndarray) -> np.ndarray:
        return self.short(self.prefix(held))

    def short(self, keys: np.ndarray) -> np.ndarray:
        """Keys of a prefix in 32 bits: the order stays, some different ones become equal."""
        late = keys >= self.LATE
        short = (keys >> np.uint64(32)).astype(np.uint32)
        short[late] = (keys[late] & np.uint64(0x7FFFFFFF)).astype(np.uint32) | np.uint32(1 << 31)
        return short


def common(one: int, two: int, percent: int) -> int:
    """Shingles that sets of these sizes share if they link."""
    return -(-percent * (one + two) // (100 + percent))


def plausible(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int, percent: int) -> bool:
    """False if prefixes alone show that the sets miss too many of each other's shingles."""
    both = common(n_a, n_b, percent)
    misses = lambda x, y: int(np.count_nonzero((x <= y[-1]) & ~np.isin(x, y)))
    return misses(a, b) <= n_a - both and misses(b, a) <= n_b - both


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _profiles(docs: DataFrame, n: int) -> DataFrame:
    """Per document its id, set size and set digest; beside them counts of shingles that repeat in a buffer."""

    def profile(batches):
        seen, held = [], 0

        def counts():
            values, times = np.unique(np.concatenate(seen), return_counts=True)
            values, times = values[times > 1], times[times > 1]
            none = pa.nulls(len(values), pa.int64())
            return pa.RecordBatch.from_arrays(
                [none, none, pa.nulls(len(values), pa.binary()), _signed(values), pa.array(times)], names=names
            )

        names = ["doc_id", "n", "digest", "shingle", "times"]
        for batch in batches:
            sizes, digests = [], []
            for values in sets_of(batch, 1, n):
                sizes.append(len(values))
                digests.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                seen.append(values)
                held += len(values)
                if held >= BUFFER:
                    yield counts()
                    seen, held = [], 0
            none = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), none, none], names=names
            )
        if seen:
            yield counts()

    return docs.mapInArrow(tidied(profile, forget), "doc_id bigint, n bigint, digest binary, shingle bigint, times bigint")


def _prefixes(docs: DataFrame, order, n: int) -> DataFrame:
    """``doc_id, n, held`` for every document: its set size and the keys of its prefix."""

    def emit(batches):
        for batch in batches:
            sizes, held = [], []
            for values in sets_of(batch, 1, n):
                sizes.append(len(values))
                held.append(order.value.prefix(values).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(held, pa.binary())], names=["doc_id", "n", "held"]
            )

    return docs.mapInArrow(tidied(emit, forget), "doc_id bigint, n bigint, held binary")


def _listed(prefixes: DataFrame) -> DataFrame:
    """``shingle, doc_id, n`` for every prefix shingle."""

    def emit(batches):
        for batch in batches:
            keys = [np.frombuffer(v.as_buffer(), np.int64) for v in batch.column(2)]
            if keys:
                each = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), batch.column(0).take(each), batch.column(1).take(each)],
                    names=["shingle", "doc_id", "n"],
                )

    return prefixes.mapInArrow(tidied(emit), "shingle bigint, doc_id bigint, n bigint")


def _meet(pairs: DataFrame, docs: DataFrame, make, fits, name: str) -> DataFrame:
    """The pairs (a, b) for which ``fits`` holds on what ``make`` gives (id, n, held) for the batches of ``docs``."""

    def check(batches):
        for batch in batches:
            sizes = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            good = [fits(x.as_buffer(), y.as_buffer(), *k) for x, y, k in zip(batch.column(4), batch.column(5), sizes)]
            good = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])

    asked = broadcast_if_small(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), max_rows=SIDE_ROWS)
    made = docs.join(asked, "doc_id", "left_semi").mapInArrow(tidied(make, forget), "id bigint, n bigint, held binary")
    made = materialise(made, name)
    side = lambda end: made.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}"), F.col("held").alias(f"held_{end}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "held_a", "held_b")
    return materialise(both.mapInArrow(check, "a bigint, b bigint").distinct(), "links")


def _verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets meet the threshold."""

    def fits(x, y, n_a, n_b):
        shared = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
        return 100 * shared >= percent * (n_a + n_b - shared)

    def make(batches):
        for batch in batches:
            sets = list(sets_of(batch, 1, n))
            sizes, held = pa.array(map(len, sets), pa.int64()), pa.array([v.tobytes() for v in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, held], names=["id", "n", "held"])

    return _meet(materialise(pairs, "pairs"), docs, make, fits, "sets")


def _plausible(pairs: DataFrame, prefixes: DataFrame, order, percent: int) -> DataFrame:
    """The pairs without those that their prefixes rule out; a tenth of the sets is moved for it."""

    def fits(x, y, n_a, n_b):
        return plausible(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), n_a, n_b, percent)

    def make(batches):
        for batch in batches:
            short = [order.value.short(np.frombuffer(v.as_buffer(), np.uint64)).tobytes() for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(short, pa.binary())], names=["id", "n", "held"]
            )

    return _meet(materialise(pairs, "pairs"), prefixes, make, fits, "prefixes")


def traverse(docs: list[tuple], others: list[tuple] | None, percent: int):
    """Pairs of different components that may meet the threshold if the list's key is their first common one.

    A document is ``(id, size, component, place, rest)``: the list's key stands at ``place`` of its ordered
    prefix and ``rest`` follows; the rests are the tree. ``others`` None: pairs among ``docs``. A pair that shares
    an earlier key is found in that key's list at the latest.
    """
    tree = [(rest, doc, size, component, place) for doc, size, component, place, rest in (docs if others is None else others)]
    tree.sort(key=lambda entry: entry[0])
    shared = [0] * len(tree)
    for k in range(1, len(tree)):
        a, b = tree[k - 1][0], tree[k][0]
        depth, most = 0, min(len(a), len(b))
        while depth < most and a[depth] == b[depth]:
            depth += 1
        shared[k] = depth
    largest = max((entry[2] for entry in tree), default=0)
    for doc, size, component, place, own in docs:
        after, last = set(own), own[-1] if own else -1
        most_misses = largest - common(size, largest, percent)
        missed: list[int] = []  # misses up to each depth of the path that is counted so far
        left = None  # the depth at which the last subtree was left
        for (rest, other, other_size, other_component, other_place), depth in zip(tree, shared):
            if left is not None:
                if depth >= left:
                    continue
                left = None
            del missed[depth:]
            if other_component == component or (others is None and other <= doc):
                continue
            both = common(size, other_size, percent)
            if min(size, other_size) < both or place > size - both:
                continue
            allowed = other_size - both - other_place
            misses = missed[-1] if missed else 0
            for value in rest[len(missed):]:
                if misses > allowed:
                    break
                # Beyond the last key of the prefix this document may hold anything.
                misses += value <= last and value not in after
                missed.append(misses)
                if misses > most_misses:
                    left = len(missed)
                    break
            if misses > allowed:
                continue
            # The same bound for the other side: own keys that the other's prefix would hold.
            end = rest[-1] if rest else -1
            if place + len({v for v in after if v <= end}.difference(rest)) <= size - both:
                yield (doc, other) if doc < other else (other, doc)


def _tree_pairs(entries: DataFrame, prefixes: DataFrame, order, percent: int, block: int) -> DataFrame:
    """Candidate pairs of the lists in ``entries`` (shingle, doc_id, component)."""
    asked = entries.groupBy("doc_id", "component").agg(F.collect_set("shingle").alias("wanted"))

    def lay(batches):
        names = ["shingle", "doc_id", "n", "component", "place", "rest"]
        for batch in batches:
            rows = []
            for doc, size, held, component, wanted in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), batch.column(4)
            ):
                prefix = np.frombuffer(held.as_buffer(), np.uint64)
                short = order.value.short(prefix).tobytes()
                wanted = wanted.values.to_numpy(zero_copy_only=False).view(np.uint64)
                wanted = wanted[np.isin(wanted, prefix)]
                for key, place in zip(wanted.view(np.int64).tolist(), np.searchsorted(prefix, wanted).tolist()):
                    rows.append((key, doc, size, component, place, short[4 * place + 4:]))
                    if len(rows) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)

    laid = prefixes.join(asked, "doc_id").select("doc_id", "n", "held", "component", "wanted").mapInArrow(
        tidied(lay), "shingle bigint, doc_id bigint, n bigint, component bigint, place bigint, rest binary"
    )
    long = broadcast_if_small(
        entries.groupBy("shingle").agg(F.ceil(F.count("*") / block).alias("blocks")).where(F.col("blocks") > 1)
    )
    dealt = laid.join(long, "shingle", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)).cast("int"))
    mine = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    task = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    upto = lambda start, stop: F.when(stop >= start, F.sequence(start, stop)).otherwise(F.array().cast("array<int>"))
    m = F.col("mine")
    tasks = F.concat(
        F.array(task(m, m, 0)),
        F.transform(upto(m + 1, F.col("blocks") - 1), lambda j: task(m, j, 0)),
        F.transform(upto(F.lit(0), m - 1), lambda i: task(i, m, 1)),
    )
    dealt = dealt.withColumn("mine", mine).withColumn("t", F.explode(tasks)).select(
        "shingle", "t.i", "t.j", "t.side", "doc_id", "n", "component", "place", "rest"
    )
    ordered = dealt.repartition("shingle", "i", "j").sortWithinPartitions("shingle", "i", "j")

    def walk(batches):
        def pairs(key, group):
            one, two = [r[1:] for r in group if r[0] == 0], [r[1:] for r in group if r[0] == 1]
            if key[1] == key[2]:
                return traverse(one, None, percent)
            return traverse(one, two, percent)

        key, group, found = None, [], []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(9)]
            for shingle, i, j, side, doc, size, component, place, rest in zip(*columns):
                if (shingle, i, j) != key:
                    if len(group) > 1:
                        found.extend(pairs(key, group))
                    key, group = (shingle, i, j), []
                group.append((side, doc, size, component, place, np.frombuffer(rest, np.uint32).tolist()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])
                found = []
        if len(group) > 1:
            found.extend(pairs(key, group))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    return ordered.mapInArrow(tidied(walk), "a bigint, b bigint").distinct()


def jaccard_groups(docs: DataFrame, n: int = N, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of (doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    profiles = materialise(_profiles(docs, n), "profiles")
    rows = profiles.where(F.col("digest").isNotNull()).select("doc_id", "n", "digest")

    bar = max(20, rows.count() // FREQUENT_SHARE)
    often = profiles.where(F.col("shingle").isNotNull()).groupBy("shingle").agg(F.sum("times").alias("times"))
    listed = often.where(F.col("times") >= bar).orderBy(F.desc("times"), "shingle").limit(MAX_FREQUENT).collect()
    frequent = np.array([r["shingle"] for r in reversed(listed)], np.int64).view(np.uint64)
    order = spark.sparkContext.broadcast(Order(frequent, percent))

    usable = rows.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    firsts = usable.groupBy("digest").agg(F.min("doc_id").alias("first"))
    # Later copies of a set, empty sets and rows without id take no part in the search.
    copies = usable.join(firsts, "digest").where(F.col("doc_id") > F.col("first")).select("doc_id")
    kept = usable.join(firsts, "digest").where(F.col("doc_id") == F.col("first")).select("doc_id")
    skip = broadcast_if_small(copies.join(kept, "doc_id", "left_anti").distinct(), max_rows=SIDE_ROWS)
    searched = docs.where(F.col("doc_id").isNotNull()).join(skip, "doc_id", "left_anti")

    prefixes = materialise(_prefixes(searched, order, n), "keys")
    listed = _listed(prefixes)
    shared = listed.groupBy("shingle").agg(F.count("*").alias("c")).where(F.col("c") > 1).select("shingle")
    entries = materialise(
        listed.join(shared, "shingle", "left_semi").distinct(), "entries"
    )
    heads = entries.groupBy("shingle").agg(F.min(F.struct("doc_id", "n")).alias("head"))
    fits = F.least("n", "head.n") * 100 >= F.greatest("n", "head.n") * percent
    stars = entries.join(heads, "shingle").where((F.col("doc_id") != F.col("head.doc_id")) & fits)
    stars = stars.select(F.col("head.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = _verified(_plausible(stars, prefixes, order, percent), searched, n, percent)

    found = components(links, "a", "b").withColumnsRenamed({"node": "doc_id"})
    coloured = entries.join(found, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    # Pairs with a list's smallest document are settled, so the lists go on without it.
    rest = coloured.join(heads.select("shingle", F.col("head.doc_id").alias("_head")), "shingle")
    coloured = materialise(rest.where(F.col("doc_id") != F.col("_head")).select("shingle", "doc_id", "component"), "coloured")
    mixed = coloured.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    mixed = mixed.where(F.col("lo") != F.col("hi")).select("shingle")
    open_lists = materialise(coloured.join(mixed, "shingle", "left_semi"), "lists")
    more = _verified(_tree_pairs(open_lists, prefixes, order, percent, block), searched, n, percent)

    groups = components(links.unionByName(more), "a", "b")
    heads = firsts.join(groups, F.col("first") == F.col("node"), "left").select(
        "digest", F.coalesce("component", "first").alias("found")
    )
    joined = rows.join(heads, "digest", "left")
    # Rows of one id with several texts meet in the smallest of their groups.
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("found")).alias("component_id")
    )


def one_of_each_group(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """``docs`` with the smallest doc_id of each group of near copies; columns as given.

    Rows without id stay; of rows equal in id and text one stays.
    """
    groups = materialise(jaccard_groups(docs.select("doc_id", "text"), n, percent), "groups")
    ids = groups.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.bool_or(F.col("doc_id") == F.col("component_id")).alias("first"), F.count("*").alias("rows")
    )
    gone = broadcast_if_small(ids.where(~F.col("first")).select("doc_id"), max_rows=SIDE_ROWS)
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    several = broadcast_if_small(ids.where(F.col("first") & (F.col("rows") > 1)).select("doc_id"))
    single = kept.join(several, "doc_id", "left_anti").select(*docs.columns)
    return single.unionByName(kept.join(several, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))
