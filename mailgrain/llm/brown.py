"""Brown class-based bigram model: exchange clustering of words, class transitions and word emissions.

    log10 P(text) = sum over tokens of log10 P(class | class before) + log10 P(word | class)

* Counts are taken over all training texts; the table of word counts grows with the input and is joined to the texts,
  never broadcast.
* Every word of at least ``OWN_COUNT`` tokens moves by itself in the exchange clustering; rarer words keep the class of
  their ending.  First come the words of at least ``CLUSTER_SHARE`` of all tokens (so at most 1 / CLUSTER_SHARE words),
  while all others form items by their ending; then those others leave their endings one by one.  In each round every
  task weighs, for its words, all moves against the class bigram matrix of the round before, and half of the words may
  move.  A round that lowers the likelihood is not used; the search ends when neither half gains, or after its rounds.
* Texts are kept as blocks of token numbers with the block's rare words by code.  The classes and counts of rare words
  are joined to the blocks by word; what stands around each word goes to the task of the word.
* Transitions are discounted and backed off to class frequencies; emissions are discounted within the class, and the
  discount is the probability of the class's unknown word.
* Words of at least ``KNOWN_SHARE`` of all tokens carry their counts in a broadcast table (at most 1 / KNOWN_SHARE
  rows); the counts of rarer words are joined.  No rare word can be a hot key, as its share is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgrain.llm import base

CLUSTER_SHARE = 1e-4
KNOWN_SHARE = 2e-6
OWN_COUNT = 5
ENDINGS = 1024
CLASSES = 64
ROUNDS = 6
OWN_ROUNDS = 2
DISCOUNT = 0.5
#: entries gathered in a task before equal ones are added up, and before they are handed on
GATHER = 1_000_000
END = np.int64(-1)


class Gathered:
    """Counts by 64-bit code, added up in bounded memory."""

    def __init__(self):
        self.codes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def add(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        codes, counts = np.unique(codes, return_counts=True)
        self.codes.append(codes), self.counts.append(counts)
        self.held += len(codes)
        if self.held > GATHER:
            self._fold()
            if self.held > GATHER // 2:
                yield from self.drain()

    def _fold(self) -> None:
        codes, at = np.unique(np.concatenate(self.codes), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate(self.counts), minlength=len(codes)).astype(np.int64)
        self.codes, self.counts, self.held = [codes], [counts], len(codes)

    def drain(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.held:
            self._fold()
            yield self.codes[0], self.counts[0]
            self.codes, self.counts, self.held = [], [], 0


def text_tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word codes (with -1 for each end), ending of each, document of each, and places of the ends."""
    words = base.Words(column, lower=True, alphabet=base.NOT_SPACE)
    ending = words.rolling.of(np.maximum(words.start, words.end - 3), words.end) % np.uint64(ENDINGS)
    at = words.first[1:]
    code = np.insert(base.signed(words.hash), at, END)
    doc = np.insert(words.doc(), at, np.arange(len(words.count)))
    return code, np.insert(ending.astype(np.int64), at, 0), doc, at + np.arange(len(at))


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def word_counts(training: DataFrame) -> DataFrame:
    """(word, ending, n) over all training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = Gathered()
        endings: list[np.ndarray] = []

        def rows(found):
            # the ending is a part of the code's row, found again from the chunks' pairs
            codes, counts = found
            known, at = np.unique(np.concatenate([e[0] for e in endings]), return_index=True)
            ending = np.concatenate([e[1] for e in endings])[at]
            endings[:] = [np.stack([known, ending])]
            return base.batch_of(word=codes, ending=ending[np.searchsorted(known, codes)].astype(np.int16), n=counts)

        for batch in batches:
            for piece in base.text_slices(batch):
                code, ending, _, _ = text_tokens(piece.column("text"))
                fresh, at = np.unique(code, return_index=True)
                endings.append(np.stack([fresh, ending[at]]))
                for found in gathered.add(code):
                    yield rows(found)
                    endings.clear()
        for found in gathered.drain():
            yield rows(found)

    return training.select("text").mapInArrow(run, "word long, ending short, n long").groupBy("word", "ending").agg(F.sum("n").alias("n"))


class Lexicon:
    """Items and broadcast counts: ``words`` sorted codes, their counts, their item or -1 where the ending decides."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, cluster_share: float, endings: np.ndarray | None = None):
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        self.endings = np.zeros(len(words), np.int64) if endings is None else endings[order]
        own = (self.counts >= cluster_share * total) & (self.words != END)
        self.item = np.full(len(words), -1, np.int64)
        self.item[own] = 1 + ENDINGS + np.arange(own.sum())
        self.item[self.words == END] = 0
        self.items = 1 + ENDINGS + int(own.sum())

    def look_up(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each code in ``words`` and whether it is there."""
        if not len(self.words):
            return np.zeros(len(code), np.int64), np.zeros(len(code), bool)
        at = np.minimum(np.searchsorted(self.words, code), len(self.words) - 1)
        return at, self.words[at] == code

    def first_items(self) -> np.ndarray:
        """The item of each of ``words``: its own, or that of its ending."""
        return np.where(self.item >= 0, self.item, 1 + self.endings)


def _previous(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Value before each token; texts begin after an end (0)."""
    before = np.zeros(len(values), values.dtype)
    before[1:] = values[:-1]
    before[ends[:-1] + 1] = 0
    return before


STREAM = "block long, doc_id array<long>, train binary, ends binary, unit binary, rare array<long>, ending array<short>"


def _list(values: pa.Array) -> pa.Array:
    """One row that holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def token_blocks(docs: DataFrame, lexicon) -> DataFrame:
    """Blocks of texts as token numbers: places in the lexicon, or -1 - j for the j-th of the block's rare words.

    ``docs`` has doc_id, text and train.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Lexicon = lexicon.value
        block = TaskContext.get().partitionId() << 40
        for batch in batches:
            for piece in base.text_slices(batch):
                code, ending, _, ends = text_tokens(piece.column("text"))
                at, known = own.look_up(code)
                rare, first, number = np.unique(code[~known], return_index=True, return_inverse=True)
                unit = np.where(known, at, 0)
                unit[~known] = -1 - number
                train = np.asarray(piece.column("train")).astype(bool)
                yield base.batch_of(
                    block=pa.array([block], pa.int64()), doc_id=_list(piece.column("doc_id")), train=pa.array([train.tobytes()], pa.binary()),
                    ends=pa.array([ends.astype(np.int64).tobytes()], pa.binary()), unit=pa.array([pa.compress(unit.astype(np.int32).tobytes(), "zstd", asbytes=True)], pa.binary()),
                    rare=_list(pa.array(rare.astype(np.int64))), ending=_list(pa.array(ending[~known][first].astype(np.int16))))
                block += 1

    return docs.select("doc_id", "text", "train").mapInArrow(run, STREAM)


class TextBlocks:
    """Stored blocks, and the places of their rare words: (word, block, j) by word, so neither moves for a join."""

    def __init__(self, blocks: DataFrame):
        self.rows = base.store_by(blocks, "blocks", "block")
        self.places = base.store_by(self.rows.select("block", F.posexplode("rare").alias("j", "word")), "rare-places", "word")


def with_rare(blocks: TextBlocks, table: DataFrame | None) -> DataFrame:
    """Blocks with ``found``: number, count and class (null if by ending) of those rare words that ``table`` (word, n, cls) has."""
    if table is None:
        return blocks.rows.withColumn("found", F.lit(None).cast("array<struct<j:int,n:bigint,cls:smallint>>"))
    found = blocks.places.join(table.select("word", "n", "cls").hint("merge"), "word").groupBy("block").agg(
        F.collect_list(F.struct("j", "n", "cls")).alias("found"))
    return blocks.rows.join(found.hint("merge"), "block", "left")


class Block:
    """A row of :func:`with_rare`: units, ends, and endings, counts and classes of its rare words (-1: by ending)."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        read = lambda name, kind: np.frombuffer(batch.column(name)[i].as_py(), kind)
        self.doc_ids = batch.column("doc_id")[i].values
        self.train, self.ends = read("train", bool), read("ends", np.int64)
        self.unit = np.frombuffer(pa.decompress(batch.column("unit")[i].as_buffer(), 4 * int(self.ends[-1] + 1), "zstd", asbytes=True), np.int32)
        self.rare = np.asarray(batch.column("rare")[i].values).astype(np.int64)
        self.ending = np.asarray(batch.column("ending")[i].values).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.ends)), np.diff(np.r_[-1, self.ends]))
        self.n, self.cls = np.zeros(len(self.rare), np.int64), np.full(len(self.rare), -1, np.int64)
        found = batch.column("found")[i].values if "found" in batch.schema.names else None
        if found is not None and len(found):
            j, n, cls = found.flatten()
            j = np.asarray(j)
            self.n[j] = np.asarray(n)
            self.cls[j] = np.asarray(cls.fill_null(-1))

    def of(self, known: np.ndarray, rare: np.ndarray) -> np.ndarray:
        """For each token the value of its lexicon word or of its rare word."""
        return np.concatenate([known, rare[::-1]])[self.unit]

    def classes(self, known_class: np.ndarray, ending_class: np.ndarray) -> np.ndarray:
        return self.of(known_class, np.where(self.cls >= 0, self.cls, ending_class[self.ending]))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block(batch, i)


def item_bigrams(blocks: DataFrame, lexicon) -> DataFrame:
    """(a, b, n): how often item b follows item a in the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Lexicon = lexicon.value
        first = own.first_items()
        gathered = Gathered()
        rows = lambda found: base.batch_of(a=found[0] // own.items, b=found[0] % own.items, n=found[1])
        for block in _blocks(batches):
            item = block.of(first, 1 + block.ending)
            yield from map(rows, gathered.add((_previous(item, block.ends) * own.items + item)[block.train[block.doc]]))
        yield from map(rows, gathered.drain())

    return blocks.mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def likelihood(matrix: np.ndarray) -> float:
    """Class bigram log-likelihood up to what no clustering changes."""
    return float(_xlogx(matrix).sum() - _xlogx(matrix.sum(axis=0)).sum() - _xlogx(matrix.sum(axis=1)).sum())


def best_class(matrix: np.ndarray, now: int, left: np.ndarray, right: np.ndarray, own: float) -> int:
    """The class (not 0, which is the end's) where an item adds most; ``left``/``right`` its counts after/before classes."""
    left, right = left.copy(), right.copy()
    left[now] -= own
    right[now] -= own
    m = matrix.copy()
    m[now, :] -= right
    m[:, now] -= left
    m[now, now] -= own
    gain = (_xlogx(m + right) - _xlogx(m)).sum(axis=1) + (_xlogx(m.T + left) - _xlogx(m.T)).sum(axis=1)
    corner = np.diagonal(m)
    gain += _xlogx(corner + left + right + own) + _xlogx(corner) - _xlogx(corner + right) - _xlogx(corner + left)
    # wherever the item goes, the classes before and after it keep their counts with it
    rows, columns = m.sum(axis=1) + left, m.sum(axis=0) + right
    gain -= _xlogx(rows + right.sum() + own) - _xlogx(rows)
    gain -= _xlogx(columns + left.sum() + own) - _xlogx(columns)
    gain[0] = -np.inf
    best = int(np.argmax(gain))
    return best if gain[best] > gain[now] + 1e-9 else now


def _moves(state, turn: int, classes: int):
    """Rows (item, cells) to (item, class): each item's best class, for the half of the items whose turn it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, matrix = state.value
        for batch in batches:
            items, best = batch.column("item").to_pylist(), []
            for item, cells in zip(items, batch.column("cells").to_pylist()):
                if item == 0 or (item + turn) % 2:
                    best.append(int(now[item]))
                    continue
                left, right, own = np.zeros(classes), np.zeros(classes), 0.0
                for cell in cells:
                    if cell["side"] == 2:
                        own = cell["n"]
                    else:
                        (left if cell["side"] else right)[cell["class"]] = cell["n"]
                best.append(best_class(matrix, int(now[item]), left, right, own))
            yield base.batch_of(item=pa.array(items, pa.int64()), best=pa.array(best, pa.int64()))

    return run


def exchange_classes(bigrams: DataFrame, items: int, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Class of each item and the class bigram matrix.  ``items`` is bounded by the shares, so both are small."""
    spark = bigrams.sparkSession
    sizes = np.zeros(items)
    for row in bigrams.groupBy("b").agg(F.sum("n").alias("n")).collect():  # one row for each item
        sizes[row["b"]] = row["n"]
    now = np.zeros(items, np.int64)
    now[1 + np.argsort(-sizes[1:], kind="stable")] = 1 + np.arange(items - 1) % (classes - 1)
    both = base.store(
        bigrams.select(F.col("a").alias("item"), F.col("b").alias("other"), F.lit(0).alias("side"), "n")
        .unionByName(bigrams.select(F.col("b").alias("item"), F.col("a").alias("other"), F.lit(1).alias("side"), "n"))
        .unionByName(bigrams.where("a = b").select(F.col("a").alias("item"), F.col("b").alias("other"), F.lit(2).alias("side"), "n")), "items")

    def named(values: np.ndarray) -> DataFrame:
        return spark.createDataFrame(pa.table({"other": np.arange(items), "class": values}))

    def matrix_of(values: np.ndarray) -> np.ndarray:
        table = named(values)
        cells = bigrams.join(F.broadcast(table.select(F.col("other").alias("a"), F.col("class").alias("ca"))), "a").join(
            F.broadcast(table.select(F.col("other").alias("b"), F.col("class").alias("cb"))), "b").groupBy("ca", "cb").agg(F.sum("n").alias("n"))
        out = np.zeros((classes, classes))
        for row in cells.collect():
            out[row["ca"], row["cb"]] = row["n"]
        return out

    matrix = matrix_of(now)
    without_gain = 0
    for turn in range(rounds):
        state = spark.sparkContext.broadcast((now, matrix))
        cells = both.join(F.broadcast(named(now)), "other").groupBy("item", "side", "class").agg(F.sum("n").alias("n"))
        grouped = cells.groupBy("item").agg(F.collect_list(F.struct("side", "class", "n")).alias("cells"))  # at most 2 * classes + 1
        moved = now.copy()
        for row in grouped.mapInArrow(_moves(state, turn, classes), "item long, best long").collect():  # one row for each item
            moved[row["item"]] = row["best"]
        after = matrix_of(moved)
        if likelihood(after) > likelihood(matrix):
            now, matrix, without_gain = moved, after, 0
        elif (without_gain := without_gain + 1) == 2:  # neither half gains
            break
    base.drop_stored(both)
    return now, matrix


def best_classes(matrix: np.ndarray, now: np.ndarray, left: np.ndarray, right: np.ndarray, own: np.ndarray) -> np.ndarray:
    """:func:`best_class` for many words at once, of whose rows in ``left`` and ``right`` few cells are set."""
    many = np.arange(len(now))
    left, right = left.astype(float), right.astype(float)
    left[many, now] -= own
    right[many, now] -= own
    gain = np.zeros(left.shape)
    for m, side, other in ((matrix, right, left), (matrix.T, left, right)):
        word, k = np.nonzero(side)
        x = side[word, k]
        cells = m[:, k].T.copy()
        at = np.arange(len(word))
        cells[at, now[word]] -= x
        mine = np.flatnonzero(k == now[word])
        cells[mine] -= other[word[mine]]
        cells[mine, k[mine]] -= own[word[mine]]
        cells = _xlogx(cells + x[:, None]) - _xlogx(cells)
        if len(word):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            gain[word[first]] += np.add.reduceat(cells, first, axis=0)
    corner = np.repeat(np.diagonal(matrix)[None], len(now), axis=0)
    corner[many, now] -= left[many, now] + right[many, now] + own
    gain += _xlogx(corner + left + right + own[:, None]) + _xlogx(corner) - _xlogx(corner + right) - _xlogx(corner + left)
    for side, sums in ((right, matrix.sum(axis=1)), (left, matrix.sum(axis=0))):
        size = (side.sum(axis=1) + own)[:, None]
        cells = np.repeat(sums[None], len(now), axis=0)
        cells[many, now] -= size[:, 0]
        gain -= _xlogx(cells + size) - _xlogx(cells)
    gain[:, 0] = -np.inf
    best = np.argmax(gain, axis=1)
    return np.where(gain[many, best] > gain[many, now] + 1e-9, best, now)


def class_matrix(blocks: DataFrame, state, classes: int) -> np.ndarray:
    """The class bigram matrix of the training texts of :func:`with_rare`'s rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(classes * classes, np.int64)
        for block in _blocks(batches):
            cls = block.classes(*state.value)
            pairs = (_previous(cls, block.ends) * classes + cls)[block.train[block.doc]]
            out += np.bincount(pairs, minlength=len(out))
        cell = np.flatnonzero(out)
        yield base.batch_of(cell=cell, n=out[cell])

    matrix = np.zeros(classes * classes)
    for row in blocks.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # classes ** 2 rows
        matrix[row["cell"]] = row["n"]
    return matrix.reshape(classes, classes)


def word_contexts(blocks: DataFrame, lexicon, state, turn: int, classes: int) -> DataFrame:
    """(word, known, now, contexts): what stands around the words without an item whose turn it is.

    A context is (class before * classes + class after) * 2, plus 1 where the word follows itself.
    """

    def rows(held: list[np.ndarray]) -> pa.RecordBatch:
        word, known, now, context = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(word, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(word[order]) != 0])
        data = context[order].astype(np.int32)
        offsets = pa.array(np.r_[first, len(word)] * 4, pa.int32())
        binary = pa.Array.from_buffers(pa.binary(), len(first), [None, offsets.buffers()[1], pa.py_buffer(data.tobytes())])
        at = order[first]
        return base.batch_of(word=word[at], known=known[at], now=now[at].astype(np.int16), contexts=binary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Lexicon = lexicon.value
        held, size = [], 0
        for block in _blocks(batches):
            cls = block.classes(*state.value)
            word = block.of(own.words, block.rare)
            before = _previous(cls, block.ends)
            after = np.r_[cls[1:], 0]
            same = np.r_[False, word[1:] == word[:-1]]
            moves = block.train[block.doc] & ((word & 1) == turn % 2) & block.of(own.item < 0, np.ones(len(block.rare), bool))
            moves[block.ends] = False
            at = np.flatnonzero(moves)
            if len(at):
                held.append((word[at], block.unit[at] >= 0, cls[at], (before[at] * classes + after[at]) * 2 + same[at]))
                size += len(at)
            if size > 2 * GATHER:
                yield rows(held)
                held, size = [], 0
        if held:
            yield rows(held)

    return blocks.mapInArrow(run, "word long, known boolean, now short, contexts binary")


def _word_moves(state, classes: int):
    """Rows of :func:`word_contexts` in order of their words to (word, known, cls), for words of at least OWN_COUNT tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = state.value

        def moved(word, known, now, left, right, own):
            often = left.sum(axis=1) >= OWN_COUNT
            best = best_classes(matrix, now[often], left[often], right[often], own[often])
            return base.batch_of(word=word[often], known=known[often], cls=best.astype(np.int16))

        open_ = None  # the last word, which may go on
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                word, known = np.asarray(batch.column("word")), np.asarray(batch.column("known"))
                now = np.asarray(batch.column("now")).astype(np.int64)
                data, offsets = base.byte_arrays(batch.column("contexts"))
                context = np.frombuffer(data.tobytes(), np.int32).astype(np.int64)
                first = np.r_[True, np.diff(word) != 0]
                number = np.repeat(np.cumsum(first) - 1, np.diff(offsets) // 4)
                n = int(first.sum())
                counts = lambda k: np.bincount(number * classes + k, minlength=n * classes).reshape(n, classes).astype(float)
                left, right = counts(context // 2 // classes), counts(context // 2 % classes)
                own = np.bincount(number, weights=context % 2, minlength=n)
                state_ = [word[first], known[first], now[first], left, right, own]
                if open_ is not None:
                    if open_[0][0] == state_[0][0]:
                        for k in (3, 4, 5):
                            state_[k][0] += open_[k][0]
                    else:
                        state_ = [np.concatenate(x) for x in zip(open_, state_)]
                yield moved(*(x[:-1] for x in state_))
                open_ = [x[-1:].copy() for x in state_]
        if open_ is not None:
            yield moved(*open_)

    return run


def exchange_words(blocks: TextBlocks, lexicon: Lexicon, shared, item_class: np.ndarray, matrix: np.ndarray, rounds: int):
    """Move the words without an item of their own: (class of each lexicon word, (word, cls) of rare words or None, matrix)."""
    spark, classes = blocks.rows.sparkSession, len(matrix)
    ending_class = item_class[1: 1 + ENDINGS]
    known_class = item_class[lexicon.first_items()]
    halves: list[DataFrame | None] = [None, None]

    def rare_classes(parts: list[DataFrame | None]) -> DataFrame | None:
        there = [p.where("not known").select("word", F.lit(0).cast("long").alias("n"), "cls") for p in parts if p is not None]
        return there[0].unionByName(there[1]) if len(there) == 2 else there[0] if there else None

    without_gain = 0
    for turn in range(rounds):
        state = spark.sparkContext.broadcast((known_class, ending_class))
        moves = base.store(
            word_contexts(with_rare(blocks, rare_classes(halves)), shared, state, turn, classes).repartition("word").sortWithinPartitions("word")
            .mapInArrow(_word_moves(spark.sparkContext.broadcast(matrix), classes), "word long, known boolean, cls short"), "moves")
        base.free_shuffles(spark)
        trial, parts = known_class.copy(), list(halves)
        got = moves.where("known").select("word", "cls").toArrow()  # lexicon words at most
        trial[np.searchsorted(lexicon.words, np.asarray(got["word"]))] = np.asarray(got["cls"])
        parts[turn % 2] = moves
        after = class_matrix(with_rare(blocks, rare_classes(parts)), spark.sparkContext.broadcast((trial, ending_class)), classes)
        base.free_shuffles(spark)
        if likelihood(after) > likelihood(matrix):
            if halves[turn % 2] is not None:
                base.drop_stored(halves[turn % 2])
            known_class, halves, matrix, without_gain = trial, parts, after, 0
        else:
            base.drop_stored(moves)
            if (without_gain := without_gain + 1) == 2:
                break
    own = rare_classes(halves)
    return known_class, None if own is None else own.select("word", "cls"), matrix


class ClassModel:
    """Log10 probabilities of transitions and emissions."""

    def __init__(self, lexicon: Lexicon, item_class: np.ndarray, matrix: np.ndarray, stats: dict[int, tuple], total: int, types: int):
        classes = len(matrix)
        self.lexicon, self.total, self.types = lexicon, total, types
        self.item_class = item_class
        self.ending_class = item_class[1: 1 + ENDINGS]
        self.known_class = item_class[lexicon.first_items()]
        n = np.zeros(classes)
        kinds = np.zeros(classes)
        for c, (tokens, words) in stats.items():
            n[c], kinds[c] = tokens, words
        share = (n + 1) / (n + 1).sum()
        before = matrix.sum(axis=1, keepdims=True)
        kept = np.maximum(matrix - DISCOUNT, 0)
        spare = before - kept.sum(axis=1, keepdims=True)
        self.transition = np.log10(np.where(before > 0, (kept + spare * share) / np.maximum(before, 1), share))
        # the end token's class has one word and no unknown one
        self.emission_total = np.log10(np.maximum(n, 1))
        self.unknown = np.where(kinds > 0, np.log10(np.maximum(DISCOUNT * kinds, 1e-300)) - self.emission_total, -np.log10(total + types + 1.0))
        self.base_total = float(np.log10(total + types + 1.0))

    def emission(self, count: np.ndarray, cls: np.ndarray) -> np.ndarray:
        seen = np.where(cls == 0, count, count - DISCOUNT)
        return np.where(count > 0, np.log10(np.maximum(seen, 0.1)) - self.emission_total[cls], self.unknown[cls])


def train(docs: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS, cluster_share: float = CLUSTER_SHARE,
          known_share: float = KNOWN_SHARE, own_rounds: int = OWN_ROUNDS):
    """(model, blocks of all texts, rare words) from doc_id, text and train; without training texts a model that knows nothing.

    The rare words have their count and their class, null if that is the class of their ending.
    """
    spark = docs.sparkSession
    counts = base.store(word_counts(docs.where("train")), "word-counts")
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, types = int(sums["n"] or 0), int(sums["v"])
    often = (F.col("n") >= known_share * total) | (F.col("word") == int(END))
    # at most 1 / known_share rows, and the end token however few texts there are
    known = counts.where(often).select("word", "n", "ending").toArrow()
    lexicon = Lexicon(*(np.asarray(known[c]).astype(np.int64) for c in ("word", "n")), total, cluster_share, np.asarray(known["ending"]).astype(np.int64))
    shared = spark.sparkContext.broadcast(lexicon)
    blocks = TextBlocks(token_blocks(docs, shared))
    bigrams = base.store(item_bigrams(blocks.rows, shared), "bigrams")
    item_class, matrix = exchange_classes(bigrams, lexicon.items, classes, rounds)
    base.drop_stored(bigrams)
    base.free_shuffles(spark)
    known_class, own, matrix = exchange_words(blocks, lexicon, shared, item_class, matrix, own_rounds)
    rare = counts.where(~often)
    rare = rare.withColumn("cls", F.lit(None).cast("short")) if own is None else rare.join(own, "word", "left")
    rare = base.store(rare.select("word", "ending", "n", "cls"), "rare-words")
    base.drop_stored(counts)
    stats: dict[int, list] = {}

    def note(cls: int, tokens: int, words: int) -> None:
        have = stats.setdefault(cls, [0, 0])
        have[0] += tokens
        have[1] += words

    for cls, n in zip(known_class.tolist(), lexicon.counts.tolist()):
        note(cls, n, 1)
    # at most ENDINGS + classes rows
    for row in rare.groupBy("cls", F.when(F.col("cls").isNull(), F.col("ending")).alias("ending")).agg(
            F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        note(int(item_class[1 + row["ending"]]) if row["cls"] is None else row["cls"], row["n"], row["v"])
    model = ClassModel(lexicon, item_class, matrix, {c: tuple(x) for c, x in stats.items()}, total, types)
    model.known_class = known_class
    return model, blocks, rare


def _scorer(shared):
    """Blocks with their rare words to one row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: ClassModel = shared.value
        for block in _blocks(batches):
            cls = block.classes(model.known_class, model.ending_class)
            count = block.of(model.lexicon.counts, block.n)
            score = model.transition[_previous(cls, block.ends), cls] + model.emission(count, cls)
            total = lambda x: np.bincount(block.doc, weights=x, minlength=len(block.ends))
            yield base.batch_of(
                doc_id=block.doc_ids, n_tokens=np.diff(np.r_[-1, block.ends]), n_known=total(count > 0).astype(np.int64),
                base_score=total(np.log10(count + 1.0) - model.base_total), score=total(score))

    return run


def score_texts(blocks: TextBlocks, model: ClassModel, rare: DataFrame) -> DataFrame:
    """Per text of ``blocks``: n_tokens, n_known, base_score and score; a null text is empty and has its end only."""
    return with_rare(blocks, rare).mapInArrow(
        _scorer(blocks.rows.sparkSession.sparkContext.broadcast(model)),
        "doc_id long, n_tokens long, n_known long, base_score double, score double")


def class_scores(docs: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """Train on the rows that are not held out and score all rows; a null doc_id is never held out."""
    base.ship_code(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (~held_out()).alias("train"))
    model, blocks, rare = train(rows, classes, rounds)
    return score_texts(blocks, model, rare).select(
        "doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"),
        "base_score", "score", (F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))).alias("perplexity"))
