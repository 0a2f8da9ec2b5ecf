"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton is built over the normalised words of all items.  Documents stream past it word by word; at each word
it knows the longest suffix that is a stretch of some item.  Where that length reaches the window (13 words, or a
whole shorter item) the window's words are hit.  A document is contaminated from a share of hit words on, and spans
beyond a limit of length or coverage can be cut out of the texts.

Items are cut into pieces that overlap by all but one word of a window, so an automaton of a bounded number of words
holds every window.  Automata are built in tasks, turned into flat arrays, and only those are broadcast.

Before streaming, words are looked up by hash, and only stretches whose every short gram occurs in an item reach the
automaton; nothing that could match is left out.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgrain.llm import base

WINDOW = 13
COVERAGE = 20  # contaminated from one hit word in so many
#: words of items in one automaton, which has at most twice as many states; building takes about 400 bytes a word in a task
SHARD_WORDS = 200_000
#: words of items that are broadcast together, about 60 bytes each; more items are handled in several passes of one stage
PASS_WORDS = 1_000_000
FOUND = "n_words long, hit_spans array<struct<start:int,end:int>>, items array<string>"


class SuffixAutomaton:
    """All stretches of the added sequences, while they are added: transitions as dictionaries, in one task only."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def _new(self, length: int, link: int, following: dict) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, state: int, symbol, target: int) -> int:
        """State for exactly the stretches that end ``state`` plus ``symbol``, taken out of ``target`` if longer ones share it."""
        if self.length[target] == self.length[state] + 1:
            return target
        clone = self._new(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = clone
        while state != -1 and self.next[state].get(symbol) == target:
            self.next[state][symbol] = clone
            state = self.link[state]
        return clone

    def extend(self, last: int, symbol) -> int:
        """State after ``symbol``; sequences start from state 0 and may share all they have in common."""
        if symbol in self.next[last]:
            return self._split(last, symbol, self.next[last][symbol])
        state = self._new(self.length[last] + 1, 0, {})
        while last != -1 and symbol not in self.next[last]:
            self.next[last][symbol] = state
            last = self.link[last]
        if last != -1:
            self.link[state] = self._split(last, symbol, self.next[last][symbol])
        return state

    def add(self, sequence) -> None:
        last = 0
        for symbol in sequence:
            last = self.extend(last, symbol)

    def step(self, state: int, matched: int, symbol) -> tuple[int, int]:
        """State and length of the longest suffix known after one more symbol."""
        while state and symbol not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        if symbol in self.next[state]:
            return self.next[state][symbol], matched + 1
        return 0, 0

    def holder(self, state: int, length: int) -> int:
        """The state on the suffix path of ``state`` that stands for its last ``length`` symbols."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state


class FlatAutomaton:
    """A finished automaton of pieces of items as flat arrays, small enough to broadcast.

    Words are numbered in the order of their hashes (``codes``).  Transitions of a state lie together, sorted by word
    (``first``, ``symbol``, ``target``); the root has one for each word, so it needs no search.  ``held_*`` lists the
    items whose window of full length a state stands for; ``short_*`` the shorter items (length and name), and
    ``up_short`` the nearest state on the suffix path that has any.
    """

    ARRAYS = ("codes", "first", "symbol", "target", "link", "length", "held_first", "held_name",
              "short_first", "short_length", "short_name", "up_short", "grams")

    def __init__(self, names: list[str], **arrays: np.ndarray):
        self.names = names
        for name in self.ARRAYS:
            setattr(self, name, arrays[name])

    @classmethod
    def build(cls, items: list[tuple[str | None, np.ndarray]], window: int, gram: int) -> "FlatAutomaton":
        """From (name, word hashes); a null name marks words and is not listed."""
        hashes = [words for _, words in items]
        codes, numbers = np.unique(np.concatenate(hashes), return_inverse=True)
        pieces = np.split(numbers.astype(np.int32), np.cumsum([len(w) for w in hashes])[:-1])
        automaton = SuffixAutomaton()
        for own in pieces:
            automaton.add(own.tolist())
        n = len(automaton.length)
        names = sorted({name for name, _ in items if name is not None})
        number = {name: k for k, name in enumerate(names)}
        held, short = set(), set()
        for (name, _), own in zip(items, pieces):
            state = matched = 0
            label = number.get(name, -1)
            for word in own.tolist():
                state, matched = automaton.step(state, matched, word)
                if matched >= window and label >= 0:
                    held.add((automaton.holder(state, window), label))
            if len(own) < window:
                short.add((automaton.holder(state, len(own)), len(own), label))
        fan = np.fromiter(map(len, automaton.next), np.int64, n)
        owner = np.repeat(np.arange(n), fan)
        symbol = np.fromiter((s for x in automaton.next for s in x), np.int32, len(owner))
        target = np.fromiter((t for x in automaton.next for t in x.values()), np.int32, len(owner))
        order = np.lexsort((symbol, owner))
        held_rows = np.asarray(sorted(held), np.int64).reshape(-1, 2)
        short_rows = np.asarray(sorted(short), np.int64).reshape(-1, 3)
        link, length = np.asarray(automaton.link, np.int32), np.asarray(automaton.length, np.int32)
        up = np.full(n, -1, np.int32)
        if len(short_rows):
            up[short_rows[:, 0]] = short_rows[:, 0]
            for state in np.argsort(length, kind="stable")[1:].tolist():
                if up[state] < 0:
                    up[state] = up[link[state]]
        states = np.arange(n + 1)
        grams = np.unique(np.concatenate([base.Rolling(w).grams(gram) for w in hashes]))
        return cls(
            names, codes=codes, first=np.r_[0, np.cumsum(fan)].astype(np.int32), symbol=symbol[order], target=target[order],
            link=link, length=length, held_first=np.searchsorted(held_rows[:, 0], states).astype(np.int32),
            held_name=held_rows[:, 1].astype(np.int32), short_first=np.searchsorted(short_rows[:, 0], states).astype(np.int32),
            short_length=short_rows[:, 1].astype(np.int32), short_name=short_rows[:, 2].astype(np.int32), up_short=up, grams=grams)

    def nbytes(self) -> int:
        return sum(getattr(self, name).nbytes for name in self.ARRAYS)

    def numbers(self, hashes: np.ndarray) -> list[int]:
        """Numbers of words, -1 for a word of no item."""
        at = np.minimum(np.searchsorted(self.codes, hashes), len(self.codes) - 1)
        return np.where(self.codes[at] == hashes, at, -1).tolist()

    def walk(self, numbers: list[int]) -> Iterator[tuple[int, int]]:
        """After each word: the state and the length of the longest stretch of an item that ends there."""
        first, symbol, target, link, length = (memoryview(x) for x in (self.first, self.symbol, self.target, self.link, self.length))
        state = matched = 0
        for word in numbers:
            if word < 0:
                state = matched = 0
                yield 0, 0
                continue
            while state:
                end = first[state + 1]
                at = bisect_left(symbol, word, first[state], end)
                if at < end and symbol[at] == word:
                    break
                state = link[state]
                matched = length[state]
            state = target[at] if state else target[word]
            matched += 1
            yield state, matched

    def scan(self, hashes: np.ndarray, offset: int, window: int, marks: np.ndarray) -> set[str]:
        """Stream a stretch of words that begins at ``offset``: mark hit words, return the names of the items."""
        link, length, up_short = memoryview(self.link), memoryview(self.length), memoryview(self.up_short)
        holders, found = set(), set()
        for i, (state, matched) in enumerate(self.walk(self.numbers(hashes)), offset + 1):
            if matched >= window:
                marks[i - window: i] = True
                at = state
                while length[link[at]] >= window:
                    at = link[at]
                holders.add(at)
            at = up_short[state]
            while at > 0:
                for k in range(self.short_first[at], self.short_first[at + 1]):
                    if self.short_length[k] <= matched:
                        marks[i - self.short_length[k]: i] = True
                        found.add(int(self.short_name[k]))
                at = up_short[link[at]]
        for at in holders:
            found.update(self.held_name[self.held_first[at]: self.held_first[at + 1]].tolist())
        return {self.names[k] for k in found if k >= 0}


class ItemIndex:
    """The automata of one pass over the documents and the hashes that gate the stream."""

    def __init__(self, automata: list[FlatAutomaton], window: int, least: int, gram: int):
        self.automata, self.window, self.least, self.gram = automata, window, least, gram
        self.grams = np.unique(np.concatenate([a.grams for a in automata])) if automata else np.zeros(0, np.uint64)
        self.gate = np.zeros(1 << 20, bool)
        self.gate[(self.grams & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def scan(self, words: np.ndarray, offset: int, marks: np.ndarray, found: set) -> None:
        for automaton in self.automata:
            found |= automaton.scan(words, offset, self.window, marks)

    def candidates(self, hashes: np.ndarray) -> np.ndarray:
        """Positions whose gram of words occurs in some item."""
        grams = base.Rolling(hashes).grams(self.gram)
        maybe = np.flatnonzero(self.gate[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(maybe) or not len(self.grams):
            return maybe[:0]
        at = np.minimum(np.searchsorted(self.grams, grams[maybe]), len(self.grams) - 1)
        return maybe[self.grams[at] == grams[maybe]]


def _stretches(places: np.ndarray) -> list[tuple[int, int]]:
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1)
    return list(zip(places[np.r_[0, cut + 1]].tolist(), (places[np.r_[cut, len(places) - 1]] + 1).tolist()))


def _scanner(shared, keep: list[str], again: bool):
    """Adds word counts, spans and items to the columns ``keep``; ``again`` unites them with those of an earlier pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = shared.value
        for batch in batches:
            for piece in base.text_slices(batch):
                words = base.Words(piece.column("text"), lower=True, alphabet=base.ALNUM)
                spans: list[list] = piece.column("hit_spans").to_pylist() if again else [[] for _ in words.count]
                items: list[list] = piece.column("items").to_pylist() if again else [[] for _ in words.count]
                places = index.candidates(words.hash)
                owners = np.searchsorted(words.first, places, side="right") - 1
                for doc in np.unique(owners).tolist():
                    first, last = int(words.first[doc]), int(words.first[doc + 1])
                    marks, found = np.zeros(last - first, bool), set(items[doc])
                    for span in spans[doc]:
                        marks[span["start"]: span["end"]] = True
                    for a, b in _stretches(places[owners == doc] - first):
                        if b - a >= index.least - index.gram + 1:
                            end = min(b + index.gram - 1, last - first)
                            index.scan(words.hash[first + a: first + end], a, marks, found)
                    if marks.any():
                        spans[doc] = [{"start": s, "end": e} for s, e in _stretches(np.flatnonzero(marks))]
                        items[doc] = sorted(x for x in found if x is not None)
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield base.batch_of(
                    **{c: piece.column(c) for c in keep}, n_words=pa.array(words.count.astype(np.int64)),
                    hit_spans=pa.array(spans, kind), items=pa.array(items, pa.list_(pa.string())),
                )

    return run


def _item_pieces(window: int, piece_words: int):
    """Hashes of the words of items, long items in pieces that share all but one word of a window with the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in base.text_slices(batch):
                words = base.Words(rows.column("text"), lower=True, alphabet=base.ALNUM)
                out = []
                for k, name in enumerate(rows.column("item_id").to_pylist()):
                    own = words.hash[words.first[k]: words.first[k + 1]]
                    for at in range(0, max(len(own) - window + 1, min(len(own), 1)), piece_words - window + 1):
                        piece = own[at: at + piece_words]
                        out.append((name, len(piece), piece.tobytes()))
                if out:
                    names, sizes, hashes = zip(*out)
                    yield base.batch_of(
                        item_id=pa.array(names, pa.string()), n_words=pa.array(sizes, pa.int64()), words=pa.array(hashes, pa.binary()))

    return run


def _automata(window: int, gram: int, shard_words: int):
    """One row for each automaton of at most about ``shard_words`` words (at most twice as many states)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), 0, 0
        items: list[tuple[str | None, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal number, held
            row = base.batch_of(
                shard=pa.array([(part << 32) + number], pa.int64()), n_words=pa.array([held], pa.int64()),
                automaton=pa.array([pickle.dumps(FlatAutomaton.build(items, window, gram), protocol=5)], pa.binary()))
            items.clear()
            number, held = number + 1, 0
            return row

        for batch in batches:
            for name, n, words in zip(*(batch.column(c).to_pylist() for c in ("item_id", "n_words", "words"))):
                if items and held + n > shard_words:
                    yield flush()
                items.append((name, np.frombuffer(words, np.uint64)))
                held += n
        if items:
            yield flush()

    return run


def item_indexes(benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, pass_words: int = PASS_WORDS) -> Iterator[ItemIndex]:
    """Automata of all items, built in tasks, in as many passes as their words need; at least one, perhaps empty, index."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    piece_words = max(2 * window, shard_words // 8)
    pieces = base.store(items.mapInArrow(_item_pieces(window, piece_words), "item_id string, n_words long, words binary"), "items")
    sums = pieces.agg(F.sum("n_words").alias("total"), F.min(F.least("n_words", F.lit(window))).alias("least")).first()
    least = sums["least"] or window
    gram = min(least, 4)
    parts = max(1, -(-(sums["total"] or 0) // shard_words))
    built = base.store(pieces.repartition(parts).mapInArrow(
        _automata(window, gram, shard_words), "shard long, n_words long, automaton binary"), "automata")
    passes: list[list[int]] = [[]]
    held = 0
    for row in built.select("shard", "n_words").orderBy("shard").collect():  # one row for each ``shard_words`` words
        if passes[-1] and held + row["n_words"] > pass_words:
            passes.append([])
            held = 0
        passes[-1].append(row["shard"])
        held += row["n_words"]
    for shards in passes:
        blobs = built.where(F.col("shard").isin(shards)).select("automaton").collect() if shards else []  # <= ``pass_words`` words
        yield ItemIndex([pickle.loads(r["automaton"]) for r in blobs], window, least, gram)
    base.drop_stored(pieces)
    base.drop_stored(built)


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep_rows: bool = False, keep_text: bool = False,
    shard_words: int = SHARD_WORDS, pass_words: int = PASS_WORDS,
) -> DataFrame:
    """Words of each document that lie in a benchmark window: spans of word numbers and the items hit.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; null texts have no words.  Repeated items count once
    for each item_id; a null item_id marks words but is not listed.  An automaton never holds more than about
    ``shard_words`` words and a pass no more than ``pass_words``; the documents stream past one pass's automata after the
    other's, in one stage.  ``keep_rows`` adds the whole input row as ``_row``, ``keep_text`` the text.
    """
    spark = docs.sparkSession
    base.ship_code(spark)
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if keep_rows else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *whole)
    again = False
    for index in item_indexes(benchmark, window, shard_words, pass_words):
        keep = ["doc_id", *(["_row"] if keep_rows else []), "text"]
        scan = _scanner(spark.sparkContext.broadcast(index), keep, again)
        rows = rows.mapInArrow(scan, base.schema_of(rows, keep, FOUND))
        again = True
    return rows if keep_text else rows.drop("text")


def with_verdict(hits: DataFrame, coverage: int = COVERAGE) -> DataFrame:
    """Hit words and the verdict: contaminated if ``coverage`` times the hit words reach the document's words."""
    n_hit = F.expr("aggregate(hit_spans, 0L, (total, x) -> total + x.end - x.start)")
    return hits.withColumn("n_hit", n_hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.lit(coverage) * F.col("n_hit") >= F.col("n_words")))


def _cut(keep: list[str]):
    """Cuts ``removed_spans`` (word numbers) out of the texts, from the first byte of a span to the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in base.text_slices(batch):
                texts, gone = piece.column("text"), piece.column("removed_spans").to_pylist()
                words = base.Words(texts, lower=True, alphabet=base.ALNUM)
                raw, offsets = base.byte_arrays(texts)
                out = texts.to_pylist()
                for doc, spans in enumerate(gone):
                    if spans:
                        first, at, kept = int(words.first[doc]), int(offsets[doc]), []
                        for span in spans:
                            kept.append(raw[at: int(words.start[first + span["start"]])])
                            at = int(words.end[first + span["end"] - 1])
                        out[doc] = np.concatenate([*kept, raw[at: int(offsets[doc + 1])]]).tobytes().decode()
                yield base.batch_of(**{c: piece.column(c) for c in keep}, kept_text=pa.array(out, pa.string()))

    return run


def remove_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, span_words: int = WINDOW, coverage: int = COVERAGE, keep_rows: bool = False, **sizes,
) -> DataFrame:
    """Texts without benchmark spans that exceed a limit of length or coverage.

    A span is a maximal run of hit words.  It goes if it has at least ``span_words`` words, or if one in ``coverage``
    words of its document is hit: then all spans of the document go.  Spans are judged on the input, not on what is left.
    Whole words go, with what stands between them; everything outside of spans stays as it is, a text that is all
    benchmark becomes empty, a null text stays null.  Rows that repeat a doc_id are documents of their own; an empty
    benchmark removes nothing; extra columns with any name are in ``_row`` if ``keep_rows`` is set.

    Returns doc_id, n_words, n_hit, n_removed, contaminated, hit_spans, removed_spans, items, kept_text.
    """
    hits = with_verdict(benchmark_hits(docs, benchmark, window, keep_rows, keep_text=True, **sizes), coverage)
    gone = F.filter("hit_spans", lambda x: F.col("contaminated") | (x.end - x.start >= span_words))
    n_removed = F.expr("aggregate(removed_spans, 0L, (total, x) -> total + x.end - x.start)")
    chosen = hits.withColumn("removed_spans", gone).withColumn("n_removed", n_removed)
    keep = [c for c in chosen.columns if c != "text"]
    return chosen.mapInArrow(_cut(keep), base.schema_of(chosen, keep, "kept_text string"))
