"""Plain versions of the contracts, one document after the other."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def base_scores(docs):
    tokens = {i: SPACED.findall(lower(t)) + [None] for i, t in docs}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = collections.Counter(w for i, own in tokens.items() if not out[i] for w in own)
    total, kinds = sum(counts.values()), len(counts)
    return {
        i: (out[i], len(own), sum(counts[w] > 0 for w in own), total,
            sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in own))
        for i, own in tokens.items()}


def shingles(text, size=4):
    words = SPACED.findall(lower(text))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i: i + size]) for i in range(len(words) - size + 1)}


def near_duplicates(docs, percent=80):
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def contamination(docs, items, window=13):
    grams = collections.defaultdict(set)
    for name, text in items:
        words = ALNUM.findall(lower(text))
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            grams[tuple(words[i: i + n])].add(str(name))
    out = {}
    for i, text in docs:
        words = ALNUM.findall(lower(text))
        hit, found = [False] * len(words), set()
        for n in {len(g) for g in grams}:
            for at in range(len(words) - n + 1):
                names = grams.get(tuple(words[at: at + n]))
                if names:
                    found |= names
                    hit[at: at + n] = [True] * n
        n_hit = sum(hit)
        out[i] = (len(words), n_hit, len(found), sha(",".join(sorted(found))), n_hit > 0 and 20 * n_hit >= len(words))
    return out


def cut_contamination(docs, items, window=13, span_words=13, coverage=20):
    grams = set()
    for _, text in items:
        words = ALNUM.findall(lower(text))
        n = min(window, len(words))
        grams |= {tuple(words[i: i + n]) for i in range(len(words) - n + 1 if n else 0)}
    out = {}
    for i, text in docs:
        found = list(ALNUM.finditer(lower(text)))
        words, hit = [m[0] for m in found], [False] * len(found)
        for n in {len(g) for g in grams}:
            for at in range(len(words) - n + 1):
                if tuple(words[at: at + n]) in grams:
                    hit[at: at + n] = [True] * n
        kept, at, removed = "", 0, 0
        for is_hit, own in itertools.groupby(range(len(words)), hit.__getitem__):
            own = list(own)
            if is_hit and (len(own) >= span_words or coverage * sum(hit) >= len(words)):
                kept += text[at: found[own[0]].start()]
                at, removed = found[own[-1]].end(), removed + len(own)
        out[i] = (removed, text and kept + text[at:])
    return out


def passages(docs, window=50):
    words = {i: SPACED.findall(t or "") for i, t in docs}
    first, out = {}, {}
    for i in sorted(words):
        for at in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][at: at + window]), i)
    for i, own in words.items():
        gone = [False] * len(own)
        for at in range(len(own) - window + 1):
            if first[tuple(own[at: at + window])] < i:
                gone[at: at + window] = [True] * window
        out[i] = (len(own), sum(gone), sha(" ".join(w for w, g in zip(own, gone) if not g)))
    return out


def byte_repeats(docs, window=100):
    seen, out = set(), {}
    for i, text in sorted(docs):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - window + 1):
            own = data[at: at + window]
            if own in seen:
                gone[at: at + window] = True
            seen.add(own)
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[i] = (len(data), int(gone.sum()), runs, sha(bytes(np.frombuffer(data, np.uint8)[~gone])))
    return out


def token_ids(docs, path, end):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [end] for i, t in docs}


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def conversations(rows):
    grouped = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        grouped[conv].append((turn, role or "", text or ""))
    out = {}
    for conv, turns in grouped.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    return out


def planted_tail(doc_id, words):
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def word_runs(words, least=6, times=4):
    """(start, length, period) of all runs, every period tried."""
    found, n = [], len(words)
    for q in range(1, n // times + 1):
        at = 0
        while at + q < n:
            if words[at] != words[at + q]:
                at += 1
                continue
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end - at + q
            own = words[at: at + length]
            smallest = next(p for p in range(1, q + 1) if own[p:] == own[:-p])
            if length >= max(least, times * q) and smallest == q:
                found.append((at, length, q))
            at = end + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def run_digests(docs):
    out = {}
    for i, text in docs:
        words = planted_tail(i, SPACED.findall(text or ""))
        found = word_runs(words)
        gone = [False] * len(words)
        for start, length, q in found:
            gone[start + q: start + length] = [True] * (length - q)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        out[i] = (len(found), *best, None if best[0] is None else 1000 * best[1] // best[2],
                  sha("".join("%d,%d,%d\n" % r for r in found)), sha(" ".join(w for w, g in zip(words, gone) if not g)))
    return out


def ranking(docs, items, top=10):
    """[(item_id, rank, doc_id, score)], every document scored for every item."""
    terms = [(i, collections.Counter(ALNUM.findall(lower(t)))) for i, t in docs]
    terms = [(i, own, sum(own.values())) for i, own in terms if own]
    count, words = len(terms), sum(n for _, _, n in terms)
    df = collections.Counter(t for _, own, _ in terms for t in own)
    out = []
    for item, text in items:
        found = []
        for i, own, n in terms:
            m = 10 + (90 * n * count) // words
            score = sum(
                math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10 ** 9 * own[t] // (1000 * own[t] + 8 * m))
                for t in set(ALNUM.findall(lower(text))) if t in own)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:top], 1)]
    return out


def clause_features(text, weights, threats, targets, negations, reports, threat_weight, reach=3):
    """Sums of clause weights by kind (insults, then threats), direct clauses, distinct words of those, all words."""
    sums, clauses, distinct, count = [0.0] * 8, 0, set(), 0
    for sentence in re.split(r"[.!?;\n\r]", lower(text)):
        reported_from_here = False
        for clause in re.split(r"[:,()\"]", sentence):
            last_negation, kinds, insult, threat, own, aimed = -99, set(), 0.0, 0.0, set(), False
            for at, word in enumerate(SPACED.findall(clause)):
                count += 1
                if word in threats or word in weights:
                    own.add(word)
                    kinds.add("reported" if reported_from_here else "negated" if at - last_negation <= reach else "direct")
                    weight = max(weights.get(word, 0.0), threat_weight if word in threats else 0.0)
                    insult, threat = insult + weight * (word not in threats), threat + weight * (word in threats)
                elif word in negations:
                    last_negation = at
                elif word in reports:
                    reported_from_here = True
                aimed = aimed or word in targets
            if own:
                if "direct" in kinds:
                    place, clauses, distinct = int(aimed), clauses + 1, distinct | own
                else:
                    place = 3 if "reported" in kinds else 2
                sums[place] += insult
                sums[4 + place] += threat
    return [*sums, clauses, len(distinct), count]
