"""Jaccard join of documents by their word shingles, through R-trees of count vectors.

* A document's shingles are hashed into ``GROUPS`` groups; the counts by group are its point.  Two sets share at most the
  sum of the smaller counts over all groups, and a set shares no more than that with any point of a box, taken with
  the box's upper corner.
* One tree over all points does not prune: counts of hundreds of shingles lie close together in every coordinate while the
  rule allows a difference of a ninth of both sizes.  So points meet only where they can be linked at all: sets at the
  threshold share one of their first ``n - ceil(0.8 n) + 1`` shingles in any fixed order, and their sizes lie in
  neighbouring bands.  Each shared first shingle and band is a bucket with a tree of its own.
* The order puts frequent shingles last, so that a line of every third document makes no bucket of its own.  It is the
  same for all documents, and any order is lossless.
* A tree is packed by halving its points at the median of the widest coordinate.  It is joined with itself from the
  root down, pairs of nodes of one level at a time; surviving pairs of points are confirmed on full sets.

Links serve to find components: documents with equal sets are one node, each node first meets the bucket's first node that
it shares most buckets with, and only buckets that still hold several components are joined.  Trees hold at most
``BLOCK`` points of a bucket; larger buckets become pairs of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgrain.llm import base, repeats
from mailgrain.llm.neardup import _merge as merged_labels
from mailgrain.llm.neardup import _shared_buckets, confirmed, shingle_sets

SHINGLE, PERCENT = 5, 80
GROUPS = 256
LEAF, FANOUT = 8, 8
BLOCK = 1024
HOT = 1 << 16  # frequent shingles that go last in the order
SEEN = 3  # documents of one batch that make a shingle worth counting
SIGNED = "key long, doc_id long, n long, s1 long, s2 long, counts binary, shingle long, seen long"


def needed(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Shared shingles that two sets of these sizes must have."""
    return -(-percent * (na + nb) // (100 + percent))


def packed(counts: np.ndarray) -> bytes:
    """Counts of one document, 1, 2 or 4 bytes each."""
    return counts.astype("<u1" if counts.max() < 1 << 8 else "<u2" if counts.max() < 1 << 16 else "<u4").tobytes()


def unpacked(values: list[bytes]) -> np.ndarray:
    widths = np.asarray([len(v) // GROUPS for v in values])
    out = np.empty((len(values), GROUPS), np.int32)
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        out[own] = np.frombuffer(b"".join([values[i] for i in own.tolist()]), f"<u{width}").reshape(-1, GROUPS)
    return out


# ---------------------------------------------------------------- one pass over the texts: points, frequent shingles


def _points(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_shingles = []
            for rows in base.text_slices(batch):
                shingles, bounds = shingle_sets(rows.column("text"), size)
                n = np.diff(bounds)
                docs = len(n)
                own = np.flatnonzero(n)
                sums = [np.zeros(docs, np.uint64) for _ in range(2)]
                counts: list = [None] * docs
                if len(own):
                    sums[0][own] = np.add.reduceat(shingles, bounds[:-1][own])
                    sums[1][own] = np.add.reduceat(base.mix(shingles + np.uint64(77)), bounds[:-1][own])
                    table = np.bincount(
                        np.repeat(np.arange(docs), n) * GROUPS + (shingles % np.uint64(GROUPS)).astype(np.int64),
                        minlength=docs * GROUPS).reshape(docs, GROUPS)
                    for doc in own.tolist():
                        counts[doc] = packed(table[doc])
                    all_shingles.append(shingles)
                blank = pa.nulls(docs, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("key"), rows.column("doc_id"), pa.array(n), pa.array(base.signed(sums[0])), pa.array(base.signed(sums[1])),
                     pa.array(counts, pa.binary()), blank, blank], ["key", "doc_id", "n", "s1", "s2", "counts", "shingle", "seen"])
            if all_shingles:
                values, seen = np.unique(np.concatenate(all_shingles), return_counts=True)
                often = seen >= SEEN
                blank = pa.nulls(int(often.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [blank, blank, blank, blank, blank, pa.nulls(len(blank), pa.binary()), pa.array(base.signed(values[often])),
                     pa.array(seen[often])], ["key", "doc_id", "n", "s1", "s2", "counts", "shingle", "seen"])

    return run


# ---------------------------------------------------------------- buckets


def prefixes(shingles: np.ndarray, bounds: np.ndarray, hot: np.ndarray, rank: np.ndarray, percent: int):
    """First shingles of each document in the common order: (document, shingle, whether it is frequent).

    ``hot`` is sorted, ``rank`` its order.
    """
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    frequent = np.zeros(len(shingles), bool)
    if len(hot) and len(shingles):
        at = np.minimum(np.searchsorted(hot, shingles), len(hot) - 1)
        frequent = hot[at] == shingles
        order = np.lexsort((np.where(frequent, np.uint64(0xFFFFFFFFFFFFFFFF) - rank[at], shingles), doc))
        shingles, frequent = shingles[order], frequent[order]
    first = np.where(n > 0, n + (-percent * n // 100) + 1, 0)
    keep = np.arange(len(doc)) - bounds[:-1][doc] < first[doc]
    return doc[keep], shingles[keep], frequent[keep]


def _prefix_rows(size: int, percent: int, hot_shingles):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, rank = hot_shingles.value
        for batch in batches:
            met: set[tuple[int, int]] = set()
            for rows in base.text_slices(batch):
                shingles, bounds = shingle_sets(rows.column("text"), size)
                n = np.diff(bounds)
                own = np.flatnonzero(n)
                if not len(own):
                    continue
                # of equal sets in a batch one stands for all
                sums = np.add.reduceat(base.mix(shingles + np.uint64(77)), bounds[:-1][own])
                fresh = np.zeros(len(n), bool)
                for i, name in zip(own.tolist(), zip(sums.tolist(), n[own].tolist())):
                    fresh[i] = name not in met
                    met.add(name)
                doc, first, frequent = prefixes(shingles, bounds, hot, rank, percent)
                fresh = fresh[doc]
                doc, first, frequent = doc[fresh], first[fresh], frequent[fresh]
                yield base.batch_of(bucket=base.signed(first), key=np.asarray(rows.column("key"))[doc], frequent=pa.array(frequent))

    return run


def prefix_rows(keyed: DataFrame, signed: DataFrame, size: int, percent: int) -> DataFrame:
    """Stored (bucket, key, frequent) of the first shingles of all documents, frequent shingles last."""
    context = keyed.sparkSession.sparkContext
    frequent = signed.where("shingle is not null").groupBy("shingle").agg(F.sum("seen").alias("seen"))
    rows = frequent.orderBy(F.desc("seen"), "shingle").limit(HOT).select("shingle").toArrow()  # HOT rows at most
    hot = rows.column("shingle").to_numpy().view(np.uint64) if rows.num_rows else np.zeros(0, np.uint64)
    order = np.argsort(hot)
    shared = context.broadcast((hot[order], order.astype(np.uint64)))
    return base.store(keyed.select("key", "text").mapInArrow(_prefix_rows(size, percent, shared), "bucket long, key long, frequent boolean"), "prefixes")


def shared_buckets(rows: DataFrame, moved: DataFrame) -> DataFrame:
    """Stored (bucket, key, first) of buckets that several documents share, as nodes.

    Rows of frequent shingles are the few that other shingles leave room for; their smallest keys are found map-side and
    joined back, so that a hot bucket need not meet in one task.  All others are sorted by bucket once.
    """
    cold = rows.where("not frequent").select("bucket", "key").repartition("bucket").sortWithinPartitions("bucket", "key").mapInArrow(
        _shared_buckets, "bucket long, key long, first long")
    hot = rows.where("frequent").select("bucket", "key")
    heads = base.store(hot.groupBy("bucket").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last").select(
        "bucket", "first"), "heads")
    found = base.store(cold.unionByName(hot.join(heads, "bucket")), "shared")
    first_node = moved.select(F.col("key").alias("first"), F.col("node").alias("first_node"))
    nodes = found.join(moved, "key", "left").join(first_node, "first", "left").select(
        "bucket", F.coalesce("node", "key").alias("key"), F.coalesce("first_node", "first").alias("first"))
    buckets = base.store(nodes, "buckets")
    base.drop_stored(found)
    return buckets


# ---------------------------------------------------------------- trees


class Tree:
    """R-tree over count vectors: leaves of up to ``LEAF`` points, ``FANOUT`` children a node."""

    def __init__(self, points: np.ndarray, n: np.ndarray):
        leaves, stack = [], [np.arange(len(n))]
        while stack:
            own = stack.pop()
            if len(own) <= LEAF:
                leaves.append(own)
                continue
            part = points[own]
            widest = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            order = np.argsort(part[:, widest], kind="stable")
            half = len(own) // 2
            stack += [own[order[:half]], own[order[half:]]]
        self.order = np.concatenate(leaves)
        self.points, self.n = points[self.order], n[self.order]
        self.bounds = np.r_[0, np.cumsum([len(x) for x in leaves])]
        starts = self.bounds[:-1]
        #: from the leaves up: upper corner, smallest and largest size
        self.levels = [(np.maximum.reduceat(self.points, starts), np.minimum.reduceat(self.n, starts), np.maximum.reduceat(self.n, starts))]
        while len(self.levels[-1][1]) > 1:
            high, least, most = self.levels[-1]
            starts = np.arange(0, len(least), FANOUT)
            self.levels.append((np.maximum.reduceat(high, starts), np.minimum.reduceat(least, starts), np.maximum.reduceat(most, starts)))

    def leaf_pairs(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of leaves a <= b whose boxes allow a link, from the root down."""
        a = b = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            high, least, most = self.levels[level]
            if level < len(self.levels) - 1:
                step = np.arange(FANOUT)
                x = np.repeat(a[:, None] * FANOUT + step, FANOUT, axis=1).ravel()
                y = np.tile(b[:, None] * FANOUT + step, FANOUT).ravel()
                inside = (x < len(least)) & (y < len(least)) & (x <= y)
                a, b = x[inside], y[inside]
            fit = (100 * most[a] >= percent * least[b]) & (100 * most[b] >= percent * least[a])
            a, b = a[fit], b[fit]
            shared = np.concatenate([
                np.minimum(high[a[i: i + 4096]], high[b[i: i + 4096]]).sum(axis=1) for i in range(0, len(a), 4096)] or [np.zeros(0)])
            fit = shared >= needed(least[a], least[b], percent)
            a, b = a[fit], b[fit]
        return a, b

    def pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of points that the bound of their own counts allows, with that bound."""
        a, b = self.leaf_pairs(percent)
        sizes = np.diff(self.bounds)
        for at in range(0, len(a), 128):
            x, y = a[at: at + 128], b[at: at + 128]
            both = sizes[x] * sizes[y]
            inner = np.arange(int(both.sum())) - np.repeat(np.cumsum(both) - both, both)
            width = np.repeat(sizes[y], both)
            i = np.repeat(self.bounds[x], both) + inner // width
            j = np.repeat(self.bounds[y], both) + inner % width
            fit = (i < j) & (100 * np.minimum(self.n[i], self.n[j]) >= percent * np.maximum(self.n[i], self.n[j]))
            i, j = i[fit], j[fit]
            shared = np.minimum(self.points[i], self.points[j]).sum(axis=1)
            fit = shared >= needed(self.n[i], self.n[j], percent)
            yield self.order[i[fit]], self.order[j[fit]], shared[fit]


def _nearest(i: np.ndarray, j: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of all pairs with a point the one with the largest share, for each point."""
    both, other = np.r_[i, j], np.r_[j, i]
    order = np.lexsort((-np.tile(share, 2), both))
    one = np.r_[True, both[order][1:] != both[order][:-1]][: len(both)]
    return both[order][one], other[order][one]


def _tree_pairs(percent: int, nearest: bool):
    """Rows sorted by group to candidate pairs of different components.

    A group of at most ``LEAF`` points is a tree of one leaf: such groups of a batch are compared all at once.  Of
    larger ones ``nearest`` keeps the best pair of each point (of each run of leaf pairs).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows of the group that may go on

        def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            grp, key, comp, n, side, half = (rows.column(c).to_numpy() for c in ("grp", "key", "comp", "n", "side", "half"))
            split = rows.column("split").to_numpy()
            counts = rows.column("counts")
            opens = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1]])
            sizes = np.diff(np.r_[opens, len(grp)])

            def allowed(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                return (comp[i] != comp[j]) & (side[i] + side[j] < 2) & (~split[i] | (half[i] != half[j]))

            small = (sizes > 1) & (sizes <= LEAF)
            both = sizes[small] ** 2
            inner = np.arange(int(both.sum())) - np.repeat(np.cumsum(both) - both, both)
            width, start = np.repeat(sizes[small], both), np.repeat(opens[small], both)
            i, j = start + inner // width, start + inner % width
            fit = (i < j) & allowed(i, j) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            i, j = i[fit], j[fit]
            if len(i):
                met, place = np.unique(np.r_[i, j], return_inverse=True)
                points = unpacked(counts.take(pa.array(met)).to_pylist())
                x, y = place[: len(i)], place[len(i):]
                shared = np.concatenate([
                    np.minimum(points[x[at: at + 8192]], points[y[at: at + 8192]]).sum(axis=1) for at in range(0, len(x), 8192)])
                fit = shared >= needed(n[i], n[j], percent)
                i, j = i[fit], j[fit]
                yield base.batch_of(a=np.minimum(key[i], key[j]), b=np.maximum(key[i], key[j]))
            for at, size in zip(opens[sizes > LEAF].tolist(), sizes[sizes > LEAF].tolist()):
                tree = Tree(unpacked(counts.slice(at, size).to_pylist()), n[at: at + size])
                for i, j, shared in tree.pairs(percent):
                    i, j = i + at, j + at
                    fit = allowed(i, j)
                    i, j, shared = i[fit], j[fit], shared[fit]
                    if nearest and len(i):
                        i, j = _nearest(i, j, shared / (n[i] + n[j]))
                    if len(i):
                        yield base.batch_of(a=np.minimum(key[i], key[j]), b=np.maximum(key[i], key[j]))

        for batch in batches:
            if not batch.num_rows:
                continue
            grp = batch.column("grp").to_numpy()
            last = int(np.searchsorted(grp, grp[-1]))  # the last group waits for the next batch
            if last or (held and held[-1].column("grp")[0].as_py() != grp[0]):
                yield from compare(pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks())
                held = []
            held.append(batch.slice(last))
        if held:
            yield from compare(pa.Table.from_batches(held).combine_chunks())

    return run


def tree_candidates(
    buckets: DataFrame, own: DataFrame, labels: DataFrame, percent: int, nearest: bool, block: int, least: int = 2,
) -> DataFrame:
    """Pairs (a, b) of different components in buckets that hold several; ``nearest`` see :func:`_tree_pairs`.

    Groups of fewer than ``least`` points are left out.
    """
    rows = buckets.select("bucket", "key").join(labels.select(F.col("v").alias("key"), "root"), "key", "left").select(
        "bucket", "key", F.coalesce("root", "key").alias("comp"))
    mixed = base.store(rows.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select(
        "bucket"), "mixed")
    # a size band holds sizes within a little more than the rule allows: linked sizes lie in one band or in two neighbours
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(101 / percent)))
    sized = rows.join(mixed, "bucket").distinct().join(own.select("key", "n"), "key").withColumn("band", band)
    sides = F.explode(F.array(F.struct(F.col("band"), F.lit(0).alias("side")), F.struct((F.col("band") - 1).alias("band"), F.lit(1).alias("side"))))
    placed = base.store(sized.select("bucket", "key", "comp", sides.alias("at")).select("bucket", "key", "comp", "at.*"), "placed")
    groups = placed.groupBy("bucket", "band").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("side").alias("least"), F.count("*").alias("size"))
    groups = groups.where((F.col("size") >= least) & F.expr("low < high and least = 0")).select("bucket", "band", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    half = F.pmod(F.xxhash64("key"), F.col("blocks").cast("long")).cast("int")
    wide = placed.join(groups, ["bucket", "band"]).withColumn("own", half).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    grouped = wide.select(
        F.xxhash64("bucket", "band", low, high).alias("grp"), "key", "comp", "side", (F.col("own") > F.col("other")).cast("int").alias("half"),
        (low < high).alias("split"))
    full = grouped.join(own.select("key", "n", "counts"), "key")
    return full.repartition("grp").sortWithinPartitions("grp", "key").mapInArrow(_tree_pairs(percent, nearest), "a long, b long").distinct()


def within_bound(pairs: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """Pairs that sizes and counts allow."""
    left = own.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("counts").alias("ca"))
    right = own.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("counts").alias("cb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                na, nb = np.asarray(batch.column("na")), np.asarray(batch.column("nb"))
                fit = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
                shared = np.minimum(*(unpacked(batch.column(c).to_pylist()) for c in ("ca", "cb"))).sum(axis=1)
                fit &= shared >= needed(na, nb, percent)
                yield base.batch_of(a=np.asarray(batch.column("a"))[fit], b=np.asarray(batch.column("b"))[fit])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ca", "cb").mapInArrow(run, "a long, b long")


# ---------------------------------------------------------------- join


def jaccard_join(
    docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK, nearest_rounds: int = 1,
) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, the smallest doc_id reachable by links of the join.

    Words are runs without ASCII white space, A-Z lower-cased; a text of fewer than ``shingle`` words is one shingle, a
    null or blank text has none and is linked with nothing.  Two documents link if 100 times their shared shingles are
    at least ``percent`` times all their shingles; shingles are equal if their 64-bit hashes are.  Rows that repeat a
    doc_id or have none are documents of their own; ``component_id`` is the smallest doc_id that is not null (null if all
    are).  Further columns are ignored.
    """
    if not 0 < percent <= 100 or shingle < 1:
        raise ValueError("percent must be in 1..100 and shingle positive")
    base.ship_code(docs.sparkSession)
    keyed, unique = repeats.keyed_documents(docs)
    signed = base.store(keyed.mapInArrow(_points(shingle), SIGNED), "points")
    full = signed.where("n > 0")
    same = base.store(full.groupBy("n", "s1", "s2").agg(F.min("key").alias("node"), F.count("*").alias("copies")).where(
        "copies > 1").select("n", "s1", "s2", "node"), "same")
    moved = base.store(full.select("key", "n", "s1", "s2").join(same, ["n", "s1", "s2"]).where("key <> node").select("key", "node"), "moved")
    own = base.store(full.select("key", "n", "counts").join(moved, "key", "left_anti"), "own")
    rows = prefix_rows(keyed, signed, shingle, percent)
    buckets = shared_buckets(rows, moved)
    base.drop_stored(rows)
    base.free_shuffles(docs.sparkSession)
    shared = buckets.where("key <> first").groupBy("key", "first").count()
    stars = shared.groupBy("key").agg(F.max(F.struct("count", (-F.col("first")).alias("first"))).alias("most")).select(
        (-F.col("most.first")).alias("a"), F.col("key").alias("b"))
    stars = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    labels = merged_labels(None, confirmed(within_bound(stars, own, percent), keyed, shingle, percent))
    for step in range(nearest_rounds + 1):
        # small groups are compared in full by the first step, so only larger ones can be left after it
        pairs = base.store(tree_candidates(
            buckets, own, labels, percent, step < nearest_rounds, block, 2 if step == 0 else LEAF + 1), "candidates")
        if pairs.isEmpty():
            break
        labels = merged_labels(labels, confirmed(pairs, keyed, shingle, percent))
    base.drop_stored(buckets)
    rooted = signed.where("key is not null").select("key", "doc_id", F.col("n").alias("n_shingles")).join(moved, "key", "left").select(
        "key", "doc_id", "n_shingles", F.coalesce("node", "key").alias("node"))
    rooted = rooted.join(labels.select(F.col("v").alias("node"), "root"), "node", "left").select(
        "key", "doc_id", "n_shingles", F.coalesce("root", "node").alias("root"))
    if unique:
        return rooted.select("doc_id", "n_shingles", F.col("root").alias("component_id"))
    rooted = base.store(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(least, "root").select("doc_id", "n_shingles", "component_id")
