"""Toxicity by a weighted finite-state grammar over clauses.

Words are mapped to a small alphabet: insult, threat, target, negation, reporting verb, other, and the end of a clause.
Small transducers rewrite that alphabet one after the other: negation turns an insult or threat within its reach into a
negated one, reported speech into a reported one, and the last machine gathers what a clause holds.  Their composition is
one table; a sentence is run through it, and each clause ends in a kind, such as a direct insult at a target or a negated
threat.  Commas, colons, brackets and quotation marks end a clause but not reported speech, which lasts to the end of the
sentence: what is quoted after a reporting verb is reported.

Insults are learned from labelled rows as whole words and word beginnings (forms of one stem), each with its log-odds as
weight.  Threats are a list of verbs with a weight of their own, or the learned one if that is larger.  A document's
features are the weights of its clauses, insults and threats apart, by kind; the weight of each kind is learned by a
logistic model, which turns them into a score.  Isolated words never score: what counts is the kind of their clause.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgrain.llm import base

#: labelled rows that the lexicon and the logistic model are fitted on, those of the smallest hash of doc_id
MAX_LABELLED = 50_000
THRESHOLD = 0.7
LEAST_EVIDENCE = 15.0
LEAST_WEIGHT = 2.0
#: weight of a verb of the list of threats: as much as the least of the learned words
THREAT_WEIGHT = LEAST_WEIGHT
STEMS = (4, 5, 6, 7)  # bytes of word beginnings

# Word lists of our own, in the four languages of the corpus.
TARGETS = "you your yours u she he they him them du dich dir ihr euch sie er tu te toi vous il elle ils eux tú usted ustedes él ella ellos".split()
NEGATIONS = "not no never none nor neither isn't don't nicht kein keine nie niemals ne pas jamais aucun ni nunca jamás ningún".split()
REPORTS = "said says say told wrote writes claimed quoted sagte sagt schrieb behauptet dit disait écrit affirme dijo dice escribió".split()
THREATS = "kill hurt destroy beat shoot burn attack töten schlagen vernichten tuer frapper détruire matar golpear destruir".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, CLAUSE_END = range(7)
FLAGS = ("insult", "threat", "target", "negated", "reported")

# ---------------------------------------------------------------- transducers

#: a symbol is (class, negated, reported); a transducer is (start, step) with step(state, symbol) -> (state, symbol)


def negation(reach: int = 3):
    """Marks insults and threats up to ``reach`` words after a negation."""

    def step(state, symbol):
        cls, _, reported = symbol
        if cls in (NEGATION, CLAUSE_END):
            return reach if cls == NEGATION else 0, symbol
        return max(state - 1, 0), (cls, state > 0 and cls in (INSULT, THREAT), reported)

    return 0, step


def reported_speech():
    """Marks what follows a reporting verb in the sentence."""

    def step(state, symbol):
        cls, negated, _ = symbol
        return int(state or cls == REPORT), (cls, negated, bool(state) and cls in (INSULT, THREAT))

    return 0, step


def clause_kind():
    """Gathers (insult, threat, target, negated, reported); a direct match outweighs a negated or reported one."""

    def step(state, symbol):
        insult, threat, target, negated, reported, direct = state
        cls, is_negated, is_reported = symbol
        if cls == CLAUSE_END:
            return (False,) * 6, symbol
        if cls in (INSULT, THREAT):
            insult, threat = insult or cls == INSULT, threat or cls == THREAT
            negated, reported = negated or is_negated, reported or is_reported
            direct = direct or not (is_negated or is_reported)
        return (insult, threat, target or cls == TARGET, negated, reported, direct), symbol

    return (False,) * 6, step


def compose(first, second):
    """The transducer that feeds the output of ``first`` to ``second``."""
    (start_a, step_a), (start_b, step_b) = first, second

    def step(state, symbol):
        a, out = step_a(state[0], symbol)
        b, out = step_b(state[1], out)
        return (a, b), out

    return (start_a, start_b), step


def compiled():
    """The composed grammar as a table: state and word class to state, and the kind of clause that ends in a state."""
    start, step = compose(compose(negation(), reported_speech()), clause_kind())
    number, table, kinds, todo = {start: 0}, [], [], [start]
    while len(table) < len(todo):
        state = todo[len(table)]
        row = []
        for cls in range(7):
            after, _ = step(state, (cls, False, False))
            if after not in number:
                number[after] = len(todo)
                todo.append(after)
            row.append(number[after])
        table.append(row)
        insult, threat, target, negated, reported, direct = state[1]
        negated, reported = negated and not direct, reported and not direct
        kinds.append(insult + 2 * threat + 4 * target + 8 * negated + 16 * reported)
    return table, kinds


# ---------------------------------------------------------------- words to features


def _hashes(words: list[str]) -> np.ndarray:
    found = base.Words(pa.array([w.lower() for w in words]), lower=True, alphabet=base.NOT_SPACE)
    return found.hash


_SEEDS = {cls: np.unique(_hashes(words)) for cls, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS))}
_THREATS = np.unique(_hashes(THREATS))
_SENTENCE = np.zeros(256, bool)
_SENTENCE[list(b".!?;\n\r")] = True
_BREAK = _SENTENCE.copy()
_BREAK[list(b":,()\"")] = True


def _stretches(words: base.Words, breaks: np.ndarray) -> np.ndarray:
    """First words of the stretches between ``breaks`` (and documents), and the number of words."""
    marks = np.cumsum(breaks[words.data])[words.start]
    doc = words.doc()
    new = np.ones(len(marks), bool)
    new[1:] = (marks[1:] != marks[:-1]) | (doc[1:] != doc[:-1])
    return np.r_[np.flatnonzero(new), len(marks)]


def entries(words: base.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, entry codes): the word itself, then its beginnings."""
    yield np.arange(len(words.hash)), words.hash
    for size in STEMS:
        longer = np.flatnonzero(words.end - words.start > size)
        # the end of a beginning may fall inside a character; as a code that is as good as any
        yield longer, base.mix(words.rolling.of(words.start[longer], words.start[longer] + size) + np.uint64(size))


class Lexicon:
    """Codes with weights and classes, and a gate that few other codes pass."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.weights = codes[order], weights[order]
        self.gate = np.zeros(1 << 20, bool)
        self.gate[(self.codes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def weigh(self, words: base.Words) -> np.ndarray:
        """Largest weight of the entries of each word, 0 without any."""
        out = np.zeros(len(words.hash))
        if len(self.codes):
            for number, code in entries(words):
                maybe = np.flatnonzero(self.gate[(code & np.uint64((1 << 20) - 1)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.codes, code[maybe]), len(self.codes) - 1)
                hit = self.codes[at] == code[maybe]
                np.maximum.at(out, number[maybe[hit]], self.weights[at[hit]])
        return out


#: sums of the weights of insults and of threats in clauses that are direct, direct at a target, negated, reported; then direct
#: clauses, distinct words of direct clauses, all words
N_FEATURES = 11


def features(column: pa.Array, lexicon: Lexicon, grammar) -> np.ndarray:
    table, kinds = grammar
    words = base.Words(column, lower=True, alphabet=base.NOT_SPACE & (~_BREAK | (np.arange(256) >= 128)))
    out = np.zeros((len(words.count), N_FEATURES))
    out[:, 10] = np.log1p(words.count)
    weight = lexicon.weigh(words)
    threat = np.isin(words.hash, _THREATS)
    weight[threat] = np.maximum(weight[threat], THREAT_WEIGHT)
    matched = np.flatnonzero(weight > 0)
    if not len(matched):
        return out
    cls = np.zeros(len(words.hash), np.int8)
    for value, codes in _SEEDS.items():
        cls[np.isin(words.hash, codes)] = value
    cls[weight > 0] = INSULT
    cls[threat] = THREAT
    doc = words.doc()
    sentences, clauses = _stretches(words, _SENTENCE), _stretches(words, _BREAK)
    direct = np.zeros(len(weight), bool)
    for at in np.unique(np.searchsorted(sentences, matched, side="right") - 1).tolist():
        first, last = np.searchsorted(clauses, sentences[at: at + 2]).tolist()
        state, row = 0, out[doc[sentences[at]]]
        for a, b in zip(clauses[first:last].tolist(), clauses[first + 1: last + 1].tolist()):
            own = cls[a:b]
            for symbol in own.tolist():
                state = table[state][symbol]
            kind = kinds[state]
            if kind & 3:
                column_of = 3 if kind & 16 else 2 if kind & 8 else 1 if kind & 4 else 0
                row[column_of] += weight[a:b][own == INSULT].sum()
                row[4 + column_of] += weight[a:b][own == THREAT].sum()
                row[8] += column_of < 2
                direct[a:b] = column_of < 2
            state = table[state][CLAUSE_END]
    rows = np.flatnonzero((weight > 0) & direct)
    order = rows[np.lexsort((words.hash[rows], doc[rows]))]
    once = np.ones(len(order), bool)
    once[1:] = (words.hash[order[1:]] != words.hash[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
    out[:, 9] = np.bincount(doc[order[once]], minlength=len(out))
    out[:, :10] = np.log1p(out[:, :10])
    return out


# ---------------------------------------------------------------- learning


def trained_on(doc_id: str = "doc_id"):
    """Rows whose labels may be learned."""
    return ~held_out(doc_id)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def labelled_texts(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """Stored (text, toxic) of at most ``most`` training rows.  A document labelled twice counts as its larger label, a doc_id
    that repeats is learned once, with the smallest of its texts."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).where(trained_on())
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    once = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return base.store(once.select("text", "toxic"), "labelled")  # at most ``most`` rows, as those broadcast


def _entry_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in base.text_slices(batch, limit=base.CHUNK_BYTES // 4):
            words = base.Words(rows.column("text"), lower=True, alphabet=base.NOT_SPACE & (~_BREAK | (np.arange(256) >= 128)))
            toxic, doc = np.asarray(rows.column("toxic")), words.doc()
            found = [(doc[number], code) for number, code in entries(words)]
            own, code = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((own, code))
            own, code = own[order], code[order]
            once = np.ones(len(code), bool)  # a document counts once for each entry
            once[1:] = (code[1:] != code[:-1]) | (own[1:] != own[:-1])
            own, code = own[once], code[once]
            codes, at = np.unique(code, return_inverse=True)
            t = np.bincount(at[toxic[own] == 1], minlength=len(codes))
            yield base.batch_of(code=base.signed(codes), t=t, c=np.bincount(at, minlength=len(codes)) - t)


def learn_lexicon(labelled: DataFrame) -> Lexicon:
    """All words and beginnings that mark toxic texts, by the G statistic of their document counts.

    Only the labelled rows bound their number: an entry needs enough of those to reach the least evidence.
    """
    sums = labelled.agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).first()
    toxic, clean = sums["t"] or 0, sums["c"] or 0
    t, c = F.col("t").cast("double"), F.col("c").cast("double")
    weight = F.log((t + 0.5) / (toxic + 1)) - F.log((c + 0.5) / (clean + 1))
    share = (t + c) * toxic / max(1, toxic + clean)
    evidence = 2 * (t * F.log(t / share) + F.when(c > 0, c * F.log(c / (t + c - share))).otherwise(0.0))
    found = labelled.mapInArrow(_entry_counts, "code long, t long, c long").groupBy("code").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    best = found.where("t >= 3").select("code", weight.alias("weight"), evidence.alias("evidence")).where(
        (F.col("weight") >= LEAST_WEIGHT) & (F.col("evidence") >= LEAST_EVIDENCE)).toArrow()
    return Lexicon(np.asarray(best["code"]).astype(np.int64).view(np.uint64), np.asarray(best["weight"]).astype(float))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last coefficient is the constant."""
    x = np.c_[x, np.ones(len(x))]
    beta = np.zeros(x.shape[1])
    penalty = np.full(len(beta), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


class ToxicityModel:
    def __init__(self, lexicon: Lexicon, beta: np.ndarray):
        self.lexicon, self.beta, self.grammar = lexicon, beta, compiled()

    def score(self, column: pa.Array) -> np.ndarray:
        z = features(column, self.lexicon, self.grammar) @ self.beta[:-1] + self.beta[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> ToxicityModel:
    """Fit on at most ``most`` labelled rows; without any, the score is 0.5 of every text but no text is rejected."""
    base.ship_code(docs.sparkSession)
    labelled = labelled_texts(docs, labels, most)
    lexicon = learn_lexicon(labelled)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, compiled()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in base.text_slices(batch):
                x = features(rows.column("text"), *shared.value)
                yield base.batch_of(toxic=rows.column("toxic"), x=pa.array(list(x), pa.list_(pa.float64())))

    table = labelled.mapInArrow(run, "toxic int, x array<double>").toArrow()  # at most ``most`` rows of N_FEATURES numbers
    x = np.asarray(table["x"].combine_chunks().flatten()).reshape(-1, N_FEATURES) if len(table) else np.zeros((0, N_FEATURES))
    beta = fit_logistic(x, np.asarray(table["toxic"]).astype(float)) if len(table) else np.zeros(N_FEATURES + 1)
    base.drop_stored(labelled)
    return ToxicityModel(lexicon, beta)


def toxicity_scores(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; null texts score as empty ones.  Columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in base.text_slices(batch):
                score = shared.value.score(rows.column("text"))
                columns = [rows.column(c) for c in keep] + [pa.array(score), pa.array((score >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "score", "predicted"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", score double, predicted int"
    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)
