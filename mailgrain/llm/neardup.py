"""Near-duplicate documents: MinHash bands, odd sketches, and a check on the full shingle sets.

* Documents with equal shingle sets are one node (their smallest key).
* 128 MinHash samples in 32 bands of 4 give buckets: two sets at a similarity of 0.8 miss all bands with probability
  5e-8.
* An odd sketch is a bitmap of parities; the XOR of two sketches is the sketch of what they do not share, so its
  population count estimates the difference, and never exceeds it.  The samples are folded into 256 bits, which sets
  aside pairs six standard deviations below the threshold, and the set itself into 2,048 bits, whose count is a lower
  bound of the difference and therefore loses nothing.
* What is left is confirmed on the full sets.

Links serve to find components, so not every pair of a group is looked at.  First each member of a bucket meets the
bucket's smallest member.  Buckets that are one component then are done; in the others each document meets its nearest
candidate of another component, and at last all candidates of other components do.  A bucket larger than a block is
split into pairs of blocks, each a group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgrain.llm import base, repeats
from mailgrain.llm.components import components

SHINGLE, PERCENT = 4, 80
SAMPLES, ROWS = 128, 4
BANDS = SAMPLES // ROWS
SAMPLE_BITS, SET_BITS = 256, 2048
BLOCK = 1024
_SEEDS = base.mix(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a chunk's documents, in document order and sorted within, and their bounds."""
    words = base.Words(column, lower=True, alphabet=base.NOT_SPACE)
    rolling = base.Rolling(words.hash)
    first, count = words.first[:-1], words.count
    n = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), n)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + first[doc]
    shingles = rolling.of(start, start + np.minimum(count, size)[doc])
    order = np.lexsort((shingles, doc))
    shingles, doc = shingles[order], doc[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (shingles[1:] != shingles[:-1]) | (doc[1:] != doc[:-1])
    shingles, doc = shingles[fresh], doc[fresh]
    return shingles, np.searchsorted(doc, np.arange(len(n) + 1))


def largest_miss(percent: int, samples: int = SAMPLES, bits: int = SAMPLE_BITS) -> int:
    """Population count of two sample sketches that sets at the threshold stay below by six and four deviations."""
    j = percent / 100
    missed = min(samples, samples * (1 - j) + 6 * np.sqrt(samples * j * (1 - j)))
    flips = bits / 2 * (1 - np.exp(-4 * missed / bits))
    return int(np.ceil(flips + 4 * np.sqrt(bits) / 2))


def sketches(shingles: np.ndarray, bounds: np.ndarray):
    """Band hashes, sample sketches and set sketches of documents that all have shingles."""
    docs = len(bounds) - 1
    samples = np.empty((docs, SAMPLES), np.uint64)
    for i in range(SAMPLES):
        samples[:, i] = np.minimum.reduceat((shingles ^ _SEEDS[2 * i]) * (_SEEDS[2 * i + 1] | np.uint64(1)), bounds[:-1])
    bands = samples[:, ::ROWS].copy()
    for k in range(1, ROWS):
        bands = base.mix(bands * np.uint64(0x9E3779B97F4A7C15) + samples[:, k::ROWS])
    bands = base.mix(bands + np.arange(BANDS, dtype=np.uint64))
    folded = np.zeros((docs, SAMPLE_BITS // 64), np.uint64)
    rows = np.arange(docs)
    for i in range(SAMPLES):
        place = (base.mix(samples[:, i] + np.uint64(i)) % np.uint64(SAMPLE_BITS)).astype(np.int64)
        folded[rows, place >> 6] ^= np.uint64(1) << (place & 63).astype(np.uint64)
    owner = np.repeat(rows, np.diff(bounds))
    flips = np.bincount(owner * SET_BITS + (shingles % np.uint64(SET_BITS)).astype(np.int64), minlength=docs * SET_BITS) & 1
    parity = np.packbits(flips.astype(np.uint8)).reshape(docs, SET_BITS // 8)
    return bands, folded, parity


def _signer(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in base.text_slices(batch):
                shingles, bounds = shingle_sets(rows.column("text"), size)
                counts = np.diff(bounds)
                own = np.flatnonzero(counts)
                sums = [np.zeros(len(counts), np.uint64) for _ in range(2)]
                blank: list = [None] * len(counts)
                bands, folded, parity = list(blank), list(blank), list(blank)
                if len(own):
                    starts = bounds[:-1][own]
                    sums[0][own] = np.add.reduceat(shingles, starts)
                    sums[1][own] = np.add.reduceat(base.mix(shingles + np.uint64(77)), starts)
                    found = sketches(shingles, np.r_[starts, len(shingles)])
                    for i, doc in enumerate(own.tolist()):
                        bands[doc], folded[doc], parity[doc] = (x[i].tobytes() for x in found)
                yield base.batch_of(
                    key=rows.column("key"), doc_id=rows.column("doc_id"), n=pa.array(counts), s1=base.signed(sums[0]),
                    s2=base.signed(sums[1]), bands=pa.array(bands, pa.binary()), folded=pa.array(folded, pa.binary()),
                    parity=pa.array(parity, pa.binary()))

    return run


SIGNED = "key long, doc_id long, n long, s1 long, s2 long, bands binary, folded binary, parity binary"


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            hashes = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
            yield base.batch_of(bucket=hashes, key=np.repeat(np.asarray(batch.column("key")), BANDS))


def _shared_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, key): those of buckets with several members, with the bucket's smallest key."""
    held = None  # first row of the newest bucket while it is its only one
    last = least = None
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, key = np.asarray(batch.column("bucket")), np.asarray(batch.column("key"))
        opens = np.ones(len(bucket), bool)
        opens[1:] = bucket[1:] != bucket[:-1]
        opens[0] = last is None or bucket[0] != last
        number = np.cumsum(opens) - 1
        opened = np.flatnonzero(opens)
        first = np.where(number >= 0, key[opened[np.maximum(number, 0)]] if len(opened) else 0, least if least is not None else 0)
        followed = np.zeros(len(bucket), bool)
        followed[:-1] = ~opens[1:]
        keep = ~opens | followed
        extra = [held] if held is not None and not opens[0] else []
        held = (bucket[-1], key[-1]) if opens[-1] else (None if not opens[0] or len(opened) else held)
        last, least = bucket[-1], first[-1]
        a = np.asarray([e[0] for e in extra], np.int64)
        b = np.asarray([e[1] for e in extra], np.int64)
        yield base.batch_of(
            bucket=np.concatenate([a, bucket[keep]]), key=np.concatenate([b, key[keep]]), first=np.concatenate([b, first[keep]]))


def _candidates(percent: int, nearest: bool):
    """Pairs of different components within groups of rows sorted by group; ``nearest`` keeps one for each row."""
    zmax = largest_miss(percent)

    def pairs(rows: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        key, comp, n = (np.asarray([r[i] for r in rows], np.int64) for i in (1, 2, 3))
        side = np.asarray([r[7] for r in rows], np.int8)
        bucket = np.asarray(rows[0][8], np.int64)
        bands = np.frombuffer(b"".join([r[4] for r in rows]), np.int64).reshape(-1, BANDS)
        folded = np.frombuffer(b"".join([r[5] for r in rows]), np.uint64).reshape(len(rows), -1)
        parity = np.frombuffer(b"".join([r[6] for r in rows]), np.uint64).reshape(len(rows), -1)
        level = int(np.flatnonzero(bands[0] == bucket)[0])
        split = bool(side.any())
        step = max(1, (1 << 18) // max(1, len(rows)))
        for at in range(0, len(rows), step):
            x = slice(at, at + step)
            far = np.bitwise_count(folded[x, None] ^ folded[None]).sum(axis=2, dtype=np.int32)
            ok = (far <= zmax) & (comp[x, None] != comp[None]) & (key[x, None] < key[None])
            ok &= 100 * np.minimum(n[x, None], n[None]) >= percent * np.maximum(n[x, None], n[None])
            if split:
                ok &= side[x, None] != side[None]
            a, b = np.nonzero(ok)
            a += at
            for part in range(0, len(a), 1 << 15):
                i, j = a[part: part + (1 << 15)], b[part: part + (1 << 15)]
                if level:
                    fresh = ~(bands[i, :level] == bands[j, :level]).any(axis=1)
                    i, j = i[fresh], j[fresh]
                miss = np.bitwise_count(parity[i] ^ parity[j]).sum(axis=1, dtype=np.int64)
                fit = (100 + percent) * miss <= (100 - percent) * (n[i] + n[j])
                i, j, miss = i[fit], j[fit], miss[fit]
                if nearest and len(i):
                    both, other, miss = np.r_[i, j], np.r_[j, i], np.r_[miss, miss]
                    order = np.lexsort((miss, both))
                    one = np.r_[True, both[order][1:] != both[order][:-1]]
                    i, j = both[order][one], other[order][one]
                if len(i):
                    yield key[i], key[j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        names = ("grp", "key", "comp", "n", "bands", "folded", "parity", "side", "bucket")

        def found() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                for a, b in pairs(rows):
                    yield base.batch_of(a=np.minimum(a, b), b=np.maximum(a, b))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                if rows and row[0] != rows[-1][0]:
                    yield from found()
                    rows = []
                rows.append(row)
        yield from found()

    return run


def bucket_candidates(buckets: DataFrame, signed: DataFrame, labels: DataFrame, percent: int, nearest: bool, block: int) -> DataFrame:
    """Pairs (a, b) of different components in the buckets that have several, by sketches alone."""
    comp = F.coalesce("root", "key").alias("comp")
    rows = buckets.select("bucket", "key").join(labels.select(F.col("v").alias("key"), "root"), "key", "left").select("bucket", "key", comp)
    mixed = base.store(rows.groupBy("bucket").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size")).where("low < high").select("bucket", "size"), "mixed")
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("key"), blocks.cast("long")).cast("int")
    # one group for each pair of blocks of a bucket: within a block, or between two
    wide = rows.join(mixed, "bucket").withColumn("blocks", blocks).withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    grouped = wide.select(
        F.xxhash64("bucket", low, high).alias("grp"), "bucket", "key", "comp",
        F.when(F.col("other") == F.col("own"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("byte").alias("side"))
    full = grouped.join(signed.select("key", "n", "bands", "folded", "parity"), "key")
    return full.repartition("grp").sortWithinPartitions("grp", "bucket", "side", "key").mapInArrow(
        _candidates(percent, nearest), "a long, b long").distinct()


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in base.text_slices(batch):
                shingles, bounds = shingle_sets(rows.column("text"), size)
                yield base.batch_of(
                    key=rows.column("key"), shingles=pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), base.signed(shingles)))

    return run


def within_bound(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """Pairs that the set sketches do not rule out."""
    left = signed.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("parity").alias("pa"), F.col("folded").alias("fa"))
    right = signed.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("pb"), F.col("folded").alias("fb"))
    zmax = largest_miss(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            count = lambda x, y: np.bitwise_count(
                np.frombuffer(b"".join(batch.column(x).to_pylist()), np.uint64)
                ^ np.frombuffer(b"".join(batch.column(y).to_pylist()), np.uint64)).reshape(batch.num_rows, -1).sum(axis=1, dtype=np.int64)
            na, nb = np.asarray(batch.column("na")), np.asarray(batch.column("nb"))
            fit = (count("fa", "fb") <= zmax) & ((100 + percent) * count("pa", "pb") <= (100 - percent) * (na + nb))
            fit &= 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
            yield base.batch_of(a=np.asarray(batch.column("a"))[fit], b=np.asarray(batch.column("b"))[fit])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "pa", "pb", "fa", "fb")
    return joined.mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, keyed: DataFrame, size: int, percent: int) -> DataFrame:
    """Stored pairs whose full shingle sets reach the similarity."""
    pairs = base.store(pairs, "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    sets = base.store(keyed.select("key", "text").join(ends, "key").mapInArrow(_sets(size), "key long, shingles array<long>"), "sets")
    a = sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    rule = (100 + percent) * common >= percent * (F.size("sa") + F.size("sb"))
    links = base.store(pairs.join(a, "a").join(b, "b").where(rule).select("a", "b"), "confirmed")
    base.drop_stored(sets)
    base.drop_stored(pairs)
    return links


def _merge(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (v, root) after more links between vertices."""
    if labels is None:
        return base.store(components(links), "labels")
    a = labels.select(F.col("v").alias("a"), F.col("root").alias("ra"))
    b = labels.select(F.col("v").alias("b"), F.col("root").alias("rb"))
    roots = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    more = components(roots.where("a <> b"))
    moved = labels.join(more.select(F.col("v").alias("root"), F.col("root").alias("above")), "root", "left").select(
        "v", F.coalesce("above", "root").alias("root"))
    return base.store(moved.unionByName(more.join(labels.select("v"), "v", "left_anti")), "labels")


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK, nearest_rounds: int = 2,
    keep_rows: bool = False,
) -> DataFrame:
    """Per document: n_shingles, component_id (smallest doc_id in reach) and kept (one document of each component).

    Words are runs without ASCII white space, A-Z lower-cased; a text of fewer than ``shingle`` words is one shingle;
    a text without words is linked with nothing.  Rows with the same doc_id are separate documents in the order of
    their texts; only the first of a component is kept.  Rows without doc_id can be kept; ``component_id`` is the
    smallest doc_id that is not null.  ``keep_rows`` adds ``text`` and the other columns as ``_row``.
    """
    base.ship_code(docs.sparkSession)
    keyed, unique = repeats.keyed_documents(docs, keep_rows)
    signed = base.store(keyed.mapInArrow(_signer(shingle), SIGNED), "signed")
    same = base.store(signed.where("n > 0").groupBy("n", "s1", "s2").agg(
        F.min("key").alias("node"), F.count("*").alias("copies")).where("copies > 1").select("n", "s1", "s2", "node"), "same")
    nodes = base.store(signed.select("key", "doc_id", "n", "s1", "s2").join(same, ["n", "s1", "s2"], "left").select(
        "key", "doc_id", "n", F.coalesce("node", "key").alias("node")), "nodes")
    alone = signed.where("n > 0").join(nodes.where("key <> node").select("key"), "key", "left_anti")
    own = base.store(alone.select("key", "n", "bands", "folded", "parity"), "own")
    buckets = base.store(
        own.select("key", "bands").mapInArrow(_band_rows, "bucket long, key long").repartition("bucket")
        .sortWithinPartitions("bucket", "key").mapInArrow(_shared_buckets, "bucket long, key long, first long"), "buckets")
    stars = buckets.where("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b")).distinct()
    labels = _merge(None, confirmed(within_bound(stars, own, percent), keyed, shingle, percent))
    for step in range(nearest_rounds + 1):
        pairs = base.store(bucket_candidates(buckets, own, labels, percent, step < nearest_rounds, block), "candidates")
        if pairs.isEmpty():
            break
        labels = _merge(labels, confirmed(pairs, keyed, shingle, percent))
    rooted = nodes.join(labels.select(F.col("v").alias("node"), "root"), "node", "left").select(
        "key", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "node").alias("root"))
    found = rooted.select("key", "doc_id", "n_shingles", F.col("root").alias("component_id"), (F.col("root") == F.col("key")).alias("kept"))
    if not unique:
        rooted = base.store(rooted, "rooted")
        least = base.store(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
        found = rooted.join(least, "root").select(
            "key", "doc_id", "n_shingles", "component_id", (F.col("root") == F.col("key")).alias("kept"))
    if keep_rows:
        found = found.join(keyed.select("key", "text", "_row"), "key")
    return found.drop("key")
