"""Ranked lexical search: MaxScore whose bounds come from pairs of terms.

Documents are indexed once, in blocks of postings that stay in the task that read them.  A set of queries then runs
against all blocks:

1. document frequencies of the queries' terms give their weights;
2. each query's terms are paired by falling weight.  Every block gets an intersection list for each pair, with its joint
   maximum impact; the k-th largest joint impact of any list in any block is a first threshold, as k documents reach it;
3. a pair is one *unit* of a query.  No document of a block gains more from a unit than the larger of its joint
   maximum and its two term maxima, which is less than their sum unless one document holds both.  Blocks whose
   units together stay below the threshold are skipped.  Of the others, the smallest units that together stay below
   it drive nothing; units whose single terms still do not suffice are driven by their intersection list alone; all
   others by their postings.  Documents met so are scored from the greatest unit down and dropped as soon as what is left
   cannot lift them to the threshold.

All bounds are compared with ``<``, so ties at the threshold are kept.  Terms are equal if their 64-bit hashes are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailgrain.llm import base

BLOCK_BYTES = 2 << 20
QUERY_TERMS = 1 << 18  # (query, term) pairs of one set of queries
TOP = 10
LIST = "term binary, df binary, doc binary, tf binary"
INDEX = f"ids array<long>, n binary, documents long, words long, {LIST}"
LISTS = "ids array<long>, places binary, doc binary, part binary, pair binary, size binary, both binary, joint binary, kth binary"


def narrow(values: np.ndarray) -> bytes:
    """Non-negative integers in the smallest of 1, 2, 4 or 8 bytes each, the width first."""
    top = int(values.max()) if len(values) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _row(schema: str, **values) -> pa.RecordBatch:
    return base.batch_of(**{k: pa.array([v], pa.list_(pa.int64()) if k == "ids" else None) for k, v in values.items()})


# ---------------------------------------------------------------- index


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in base.text_slices(batch, "_text", BLOCK_BYTES):
            words = base.Words(rows.column("_text"), lower=True, alphabet=base.ALNUM)
            full = np.flatnonzero(words.count)
            if not len(full):
                continue
            number = np.zeros(len(words.count), np.int64)
            number[full] = np.arange(len(full))
            terms, place = np.unique(words.hash, return_inverse=True)
            keys, tf = np.unique(place * len(full) + number[words.doc()], return_counts=True)
            ids = rows.column("doc_id").to_pylist()
            yield _row(
                INDEX, ids=[ids[i] for i in full.tolist()], n=narrow(words.count[full]), documents=len(full), words=len(words.start),
                term=terms.tobytes(), df=narrow(np.bincount(keys // len(full), minlength=len(terms))), doc=narrow(keys % len(full)),
                tf=narrow(tf))


def build_index(docs: DataFrame) -> DataFrame:
    """Stored blocks of postings of ``docs`` (doc_id, text); texts without terms are in no block."""
    base.ship_code(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text"))
    return base.store(rows.mapInArrow(_index, INDEX), "postings")


# ---------------------------------------------------------------- queries


@dataclass
class QuerySet:
    """Queries over a sorted vocabulary: units (a, b) by query, b = -1 for a single term, and the list of pairs."""

    query: np.ndarray  # query of each unit
    a: np.ndarray
    b: np.ndarray
    pair: np.ndarray  # number of the unit's pair, -1 for a single term
    pairs: np.ndarray  # (a, b) of each pair
    vocabulary: np.ndarray
    weight: np.ndarray
    queries: int
    documents: int
    words: int
    top: int


def paired_units(query: np.ndarray, term: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Units (query, a, b) of the queries' terms: neighbours by falling weight, the last alone if their number is odd."""
    order = np.lexsort((term, -weight[term], query))
    query, term = query[order], term[order]
    opens = np.flatnonzero(np.r_[True, query[1:] != query[:-1]][: len(query)])
    rank = np.arange(len(query)) - np.repeat(opens, np.diff(np.r_[opens, len(query)]))
    first = np.flatnonzero(rank % 2 == 0)
    after = np.minimum(first + 1, max(len(query) - 1, 0))
    second = np.where((after > first) & (query[after] == query[first]), term[after], -1)
    return query[first], term[first], second


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in base.text_slices(batch, "_text"):
            words = base.Words(rows.column("_text"), lower=True, alphabet=base.ALNUM)
            pairs = np.unique(np.stack([words.doc().astype(np.uint64), words.hash]), axis=1)
            yield base.batch_of(
                query=np.asarray(rows.column("query"))[pairs[0].astype(np.int64)], term=base.signed(np.ascontiguousarray(pairs[1])))


def _document_frequencies(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary.value), np.int64)
        for batch in batches:
            for term, df in zip(batch.column("term").to_pylist(), batch.column("df").to_pylist()):
                at, found = _places(vocabulary.value, np.frombuffer(term, np.uint64))
                total[found] += wide(df)[at[found]]
        own = np.flatnonzero(total)
        if len(own):
            yield base.batch_of(v=own, df=total[own])

    return run


def _places(wanted: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of the sorted ``wanted`` stands in the sorted ``terms``, and whether it does."""
    at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
    return at, terms[at] == wanted


def query_set(index: DataFrame, query: np.ndarray, term: np.ndarray, top: int) -> QuerySet | None:
    """Weights and pairs of queries given as (query, term) pairs; None if no document holds any of the terms."""
    spark = index.sparkSession
    total = index.agg(F.sum("documents").alias("documents"), F.sum("words").alias("words")).first()
    vocabulary, place = np.unique(term, return_inverse=True)
    shared = spark.sparkContext.broadcast(vocabulary)
    counts = index.select("term", "df").mapInArrow(_document_frequencies(shared), "v long, df long").groupBy("v").agg(F.sum("df").alias("df"))
    df = np.zeros(len(vocabulary), np.int64)
    for row in counts.toLocalIterator():  # at most one row for each term of the set
        df[row["v"]] = row["df"]
    shared.unpersist()
    if not df.any():
        return None
    weight = np.asarray([math.floor(1000 * math.log((2 * total["documents"] + 2) / (2 * x + 1))) if x else 0 for x in df.tolist()], np.int64)
    known = (df > 0)[place]
    _, numbers = np.unique(query, return_inverse=True)
    owner, a, b = paired_units(numbers[known], place[known], weight)
    low, high = np.minimum(a, b), np.maximum(a, b)
    double = b >= 0
    pairs, which = np.unique(np.stack([low[double], high[double]], axis=1), axis=0, return_inverse=True)
    pair = np.full(len(a), -1)
    pair[double] = which.ravel()
    return QuerySet(owner, a, b, pair, pairs, vocabulary, weight, int(numbers.max()) + 1, total["documents"], total["words"], top)


# ---------------------------------------------------------------- lists of a query set


def length_part(n: np.ndarray, documents: int, words: int) -> np.ndarray:
    """The documents' m; whole numbers of any size where 64 bits do not suffice."""
    if int(n.max()) * documents >= (1 << 62) // 90:
        return np.asarray([10 + (90 * x * documents) // words for x in n.tolist()], np.int64)
    return 10 + (90 * n * documents) // words


def intersections(offsets: np.ndarray, doc: np.ndarray, part: np.ndarray, size: int, pairs: np.ndarray):
    """Intersection of the postings of every pair: pair of each entry, document, place of both postings."""
    counts = np.diff(offsets)
    a, b = pairs[:, 0], pairs[:, 1]
    swap = counts[a] > counts[b]
    short, long = np.where(swap, b, a), np.where(swap, a, b)
    key = np.repeat(np.arange(len(counts)), counts) * size + doc
    own = np.where(counts[long] > 0, counts[short], 0)
    out = []
    ends = np.cumsum(own)
    at = 0
    while at < len(pairs):  # at most a million entries at a time
        stop = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20), side="right")), at + 1)
        n = own[at:stop]
        which = np.repeat(np.arange(at, stop), n)
        x = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + offsets[short[which]]
        want = long[which] * size + doc[x]
        y = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
        hit = key[y] == want if len(key) else np.zeros(len(want), bool)
        out.append(np.stack([which[hit], doc[x[hit]], x[hit], y[hit]]))
        at = stop
    return np.concatenate(out, axis=1) if out else np.zeros((4, 0), np.int64)


def _term_and_pair_lists(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: QuerySet = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                df, doc, tf, n = (wide(row[c]) for c in ("df", "doc", "tf", "n"))
                starts = np.cumsum(df) - df
                at, found = _places(q.vocabulary, np.frombuffer(row["term"], np.uint64))
                counts = np.where(found, df[at], 0)
                offsets = np.r_[0, np.cumsum(counts)]
                if not offsets[-1]:
                    continue
                own = np.repeat(starts[at] - offsets[:-1], counts) + np.arange(offsets[-1])
                doc, tf = doc[own], tf[own]
                part = (1_000_000_000 * tf) // (1000 * tf + 8 * length_part(n, q.documents, q.words)[doc])
                impact = part * np.repeat(q.weight, counts)
                pair, both, x, y = intersections(offsets, doc, part, len(n), q.pairs)
                joint = impact[x] + impact[y]
                sizes = np.bincount(pair, minlength=len(q.pairs))
                kept = np.flatnonzero(sizes)
                cuts = np.cumsum(sizes[kept]) - sizes[kept]
                order = np.lexsort((-joint, pair))
                kth = np.where(sizes[kept] >= q.top, joint[order][np.minimum(cuts + q.top - 1, max(len(joint) - 1, 0))] if len(joint) else 0, 0)
                yield _row(
                    LISTS, ids=row["ids"], places=narrow(counts), doc=narrow(doc), part=narrow(part), pair=narrow(kept),
                    size=narrow(sizes[kept]), both=narrow(both), joint=narrow(joint[order][cuts] if len(kept) else kept), kth=narrow(kth))

    return run


def _best_kth(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(len(shared.value.pairs), np.int64)
        for batch in batches:
            for pair, kth in zip(batch.column("pair").to_pylist(), batch.column("kth").to_pylist()):
                np.maximum.at(best, wide(pair), wide(kth))
        own = np.flatnonzero(best)
        if len(own):
            yield base.batch_of(pair=own, kth=best[own])

    return run


# ---------------------------------------------------------------- evaluation


class Block:
    """Postings and pair lists of one block, with the bounds of all units of a query set."""

    def __init__(self, row: dict, q: QuerySet):
        self.q, self.ids = q, row["ids"]
        counts = wide(row["places"])
        self.offsets = np.r_[0, np.cumsum(counts)]
        self.doc = wide(row["doc"])
        self.impact = wide(row["part"]) * np.repeat(q.weight, counts)
        most = np.zeros(len(q.weight), np.int64)
        filled = np.flatnonzero(counts)
        most[filled] = np.maximum.reduceat(self.impact, self.offsets[filled])
        joint = np.zeros(len(q.pairs) + 1, np.int64)  # the last for units of one term
        pair, size = wide(row["pair"]), wide(row["size"])
        joint[pair] = wide(row["joint"])
        self.both = wide(row["both"])
        self.list_end = np.zeros(len(q.pairs) + 1, np.int64)
        self.list_start = np.zeros(len(q.pairs) + 1, np.int64)
        self.list_end[pair] = np.cumsum(size)
        self.list_start[pair] = np.cumsum(size) - size
        second = np.where(q.b >= 0, most[q.b], 0)
        self.single = np.maximum(most[q.a], second)  # of a document with one of the two terms
        self.bound = np.maximum(self.single, joint[q.pair])
        self.ceiling = np.bincount(q.query, weights=self.bound, minlength=q.queries)  # below 2**53

    def term(self, v: int, docs: np.ndarray) -> np.ndarray:
        """Impacts of a term in the sorted ``docs``."""
        own = self.doc[self.offsets[v]: self.offsets[v + 1]]
        if not len(own):
            return np.zeros(len(docs), np.int64)
        at = np.minimum(np.searchsorted(own, docs), len(own) - 1)
        return np.where(own[at] == docs, self.impact[self.offsets[v] + at], 0)

    def drivers(self, units: np.ndarray, below: np.ndarray, threshold: int) -> np.ndarray:
        """Documents that may reach the threshold; ``units`` by rising bound, ``below`` the sums of the bounds up to each."""
        at = int(np.searchsorted(below, threshold, side="left"))  # units before stay below it all together
        rest = int(below[at - 1]) if at else 0
        found = []
        for u in units[at:].tolist():
            pair = self.q.pair[u]
            if rest is not None and pair >= 0 and rest + self.single[u] < threshold:
                rest += int(self.single[u])
                found.append(self.both[self.list_start[pair]: self.list_end[pair]])
                continue
            rest = None
            for v in (self.q.a[u], self.q.b[u]):
                if v >= 0:
                    found.append(self.doc[self.offsets[v]: self.offsets[v + 1]])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def scores(self, units: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of the block that reach the threshold, and their scores."""
        units = units[np.argsort(self.bound[units], kind="stable")]
        below = np.cumsum(self.bound[units])
        docs = self.drivers(units, below, threshold)
        score = np.zeros(len(docs), np.int64)
        for k in range(len(units) - 1, -1, -1):
            if not len(docs):
                break
            for v in (self.q.a[units[k]], self.q.b[units[k]]):
                if v >= 0:
                    score = score + self.term(v, docs)
            alive = score + (below[k - 1] if k else 0) >= threshold
            docs, score = docs[alive], score[alive]
        return docs, score


def _search(shared, seeds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: QuerySet = shared.value
        threshold = np.maximum(seeds.value, 1)
        starts = np.searchsorted(q.query, np.arange(q.queries + 1))
        best: dict[int, list[tuple]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, q)
                for query in np.flatnonzero(block.ceiling >= threshold).tolist():
                    docs, score = block.scores(np.arange(starts[query], starts[query + 1]), int(threshold[query]))
                    if not len(docs):
                        continue
                    found = best.setdefault(query, [])
                    ids = block.ids
                    found.extend((-s, ids[d] is None, ids[d] or 0) for d, s in zip(docs.tolist(), score.tolist()))
                    if len(found) >= q.top:
                        found.sort()
                        del found[q.top:]
                        threshold[query] = max(threshold[query], -found[-1][0])
        rows = [(query, None if absent else doc, -score) for query, found in best.items() for score, absent, doc in found]
        if rows:
            query, doc, score = zip(*rows)
            yield base.batch_of(number=pa.array(query, pa.int64()), doc_id=pa.array(doc, pa.int64()), score=pa.array(score, pa.int64()))

    return run


def search_set(index: DataFrame, query: np.ndarray, term: np.ndarray, top: int) -> DataFrame | None:
    """Stored (query, doc_id, score): the ``top`` documents of each query in each task."""
    spark = index.sparkSession
    q = query_set(index, query, term, top)
    if q is None:
        return None
    shared = spark.sparkContext.broadcast(q)
    lists = base.store(index.mapInArrow(_term_and_pair_lists(shared), LISTS), "pair-lists")
    kth = np.zeros(len(q.pairs) + 1, np.int64)
    reached = lists.select("pair", "kth").mapInArrow(_best_kth(shared), "pair long, kth long").groupBy("pair").agg(F.max("kth").alias("kth"))
    for row in reached.toLocalIterator():  # at most one row for each pair of the set
        kth[row["pair"]] = row["kth"]
    seed = np.zeros(q.queries, np.int64)
    np.maximum.at(seed, q.query, kth[q.pair])
    seeds = spark.sparkContext.broadcast(seed)
    numbers = [int(x) for x in np.unique(query)]
    found = lists.mapInArrow(_search(shared, seeds), "number long, doc_id long, score long")
    names = spark.createDataFrame(list(enumerate(numbers)), "number long, query long")
    found = base.store(found.join(F.broadcast(names), "number").select("query", "doc_id", "score"), "found")
    base.drop_stored(lists)
    return found


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, query_terms: int = QUERY_TERMS) -> DataFrame:
    """The ``top`` documents of each row of ``items`` (item_id, text): item_id, rank, doc_id, score.

    Terms are runs of letters, digits and non-ASCII characters, A-Z lower-cased; a document's score sums the integer
    impacts of the item's distinct terms.  Documents with a score of 0 are never found; equal scores go by rising
    doc_id, null last.  Null and empty texts have no terms: such documents count for nothing, such items find nothing.
    Rows that repeat an item_id or a doc_id are items and documents of their own.  Queries run in sets of about
    ``query_terms`` terms (the longest item at least), each against the whole index.
    """
    spark = docs.sparkSession
    base.ship_code(spark)
    if top < 1:
        raise ValueError("top must be positive")
    rows = base.store(items.select("item_id", F.col("text").cast("string").alias("_text")).withColumn(
        "query", F.monotonically_increasing_id()), "queries")
    terms = base.store(rows.select("query", "_text").mapInArrow(_query_terms, "query long, term long"), "query-terms")
    sets = max(1, -(-terms.count() // query_terms))
    terms = terms.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(sets)))
    index = build_index(docs)
    results = []
    for part in range(sets):
        own = terms.where(F.col("part") == part).select("query", "term").toArrow()  # about query_terms rows
        if own.num_rows:
            query, term = (np.ascontiguousarray(own.column(c).to_numpy()) for c in ("query", "term"))
            found = search_set(index, query, term.view(np.uint64), top)
            if found is not None:
                results.append(found)
    base.drop_stored(index)
    if not results:
        return rows.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(rows.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
