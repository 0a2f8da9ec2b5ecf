"""Token ids of public tokenizer files, with bounded caches in each Python worker.

Both kinds of BPE used here encode every pre-token on its own, so a text's ids are the ids of its pieces in a row, and
a single space between two characters that are not white space always starts a piece.  Texts are therefore cut into
units at such spaces; units are looked up by hash for a whole chunk at a time.  A unit that is not in the table is cut
into pieces, and only pieces not seen before reach the tokenizer.  Texts with characters outside printable Latin, or
with what may be a special token, go to the tokenizer whole, with the same ids.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa

from mailgrain.llm import base

#: pieces and ids of units kept for each tokenizer and worker; the rest is encoded again, with the same ids
CACHE_PIECES = 150_000
SLOTS = 1 << 20
STORED_IDS = 5_000_000
#: pieces that reach the tokenizer as one text, and the digit between them
JOINED, MARK = 64, "0"

# The pre-token patterns written in the two tokenizer files, for printable Latin texts.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
BYTE_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+"
WORD_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+"

_CONTROL = (np.arange(256) < 32) | (np.arange(256) == 127) | (np.arange(256) >= 0xCA)
_CONTROL[[9, 10, 13]] = False
#: second bytes of two-byte characters from U+0080 on that the patterns above do not class: controls, no-break space, numerals
_ODD_C2 = np.zeros(256, bool)
_ODD_C2[[*range(0x80, 0xA1), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = True


def needs_tokenizer(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts go to the tokenizer whole."""
    odd = _CONTROL[data]
    if len(data) > 1:
        a, b = data[:-1], data[1:]
        odd[:-1] |= ((a == 0xC2) & _ODD_C2[b]) | ((a == 0xC4) & (b == 0xB0)) | ((a == 0x3C) & (b == 0x7C))
    places = np.flatnonzero(odd)
    return np.searchsorted(places, offsets[1:]) > np.searchsorted(places, offsets[:-1])


class PieceEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit arrays."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.lower = self.tokenizer.normalizer is not None  # lower-cases and drops white space
        self.split = re.compile(WORD_PIECES if self.lower else BYTE_PIECES).findall
        mark = self._encode([MARK])[0] if self.lower else b""
        #: id of the digit that ends each piece of a call; None if it is not one id, or white space counts
        self.mark = int(np.frombuffer(mark, "<u4")[0]) if len(mark) == 4 else None
        self.pieces: dict[str, bytes] = {}
        # direct-mapped table of units: hash, first id and number of ids
        self.keys = np.zeros(SLOTS, np.uint64)
        self.first = np.zeros(SLOTS, np.int32)
        self.count = np.zeros(SLOTS, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(x.ids, dtype="<u4").tobytes() for x in found]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of single pieces, many in one call where white space is dropped.

        White space and a digit, which is a piece of its own, stand after each; pieces with that digit go one by one.
        """
        if self.mark is None:
            return self._encode(pieces)
        found: dict[str, bytes] = {}
        alone = [p for p in pieces if MARK in p]
        plain = [p for p in pieces if MARK not in p]
        parts = [plain[at: at + JOINED] for at in range(0, len(plain), JOINED)]
        for part, raw in zip(parts, self._encode([f" {MARK} ".join([*part, ""]) for part in parts])):
            ends = np.flatnonzero(np.frombuffer(raw, "<u4") == self.mark)
            if len(ends) != len(part):
                alone += part
                continue
            starts = np.concatenate([[0], ends[:-1] + 1])
            found.update(zip(part, [raw[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist())]))
        found.update(zip(alone, self._encode(alone) if alone else []))
        return [found[p] for p in pieces]

    def _by_pieces(self, strings: list[str]) -> list[bytes]:
        cut = list(map(self.split, strings))
        known = self.pieces
        missing = list(set(chain.from_iterable(cut)).difference(known))
        if len(known) + len(missing) > CACHE_PIECES:
            self.pieces = known = {}  # start afresh; frequent pieces are soon back
            missing = list(set(chain.from_iterable(cut)))
        if missing:
            known.update(zip(missing, self._encode_pieces(missing)))
        get = known.get
        return [b"".join(map(get, own)) for own in cut]

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the units of all texts in a row."""
        if self.lower:
            inside = base.NOT_SPACE[data]
            edges = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
            starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
            # a text may end without white space before the next one
            cuts = offsets[1:-1]
            cuts = cuts[(cuts > 0) & (cuts < len(data))]
            cuts = np.unique(cuts[inside[cuts] & inside[cuts - 1]])
            return np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
        blank = ~base.NOT_SPACE[data]
        cut = np.zeros(len(data), bool)
        cut[1:-1] = (data[1:-1] == 32) & ~blank[:-2] & ~blank[2:]
        # not at the first or last byte of a text: there a space has no neighbour of its own
        cut[offsets[1:-1][offsets[1:-1] < len(data)]] = False
        cut[offsets[1:] - 1] = False
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(cut)
        return starts, np.r_[starts[1:], len(data)]

    def _look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids in a flat array with the first place and the number of ids of each unit."""
        keys = base.Rolling(base.BYTE_CODE[data]).of(starts, ends)
        slot = (keys & np.uint64(SLOTS - 1)).astype(np.int64)
        hit = self.keys[slot] == keys
        first, count = self.first[slot].astype(np.int64), self.count[slot].astype(np.int64)
        lost = np.flatnonzero(~hit)
        if not len(lost):
            return self.ids, first, count
        fresh, at, back = np.unique(keys[lost], return_index=True, return_inverse=True)
        raw = data.tobytes()
        coded = self._by_pieces([raw[a:b].decode() for a, b in zip(starts[lost[at]].tolist(), ends[lost[at]].tolist())])
        sizes = np.asarray([len(c) // 4 for c in coded])
        new = np.frombuffer(b"".join(coded), "<u4")
        if self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(self.ids), 2 * len(new)), np.uint32)])
        self.ids[self.used: self.used + len(new)] = new
        places = self.used + np.cumsum(sizes) - sizes
        first[lost], count[lost] = places[back], sizes[back]
        ids = self.ids
        if self.used + len(new) <= STORED_IDS:
            own = (fresh & np.uint64(SLOTS - 1)).astype(np.int64)
            free = np.flatnonzero(self.keys[own] == 0)
            free = free[np.unique(own[free], return_index=True)[1]]
            self.keys[own[free]], self.first[own[free]], self.count[own[free]] = fresh[free], places[free], sizes[free]
            self.used += len(new)
        return ids, first, count

    def column(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text of an Arrow column; null counts as empty."""
        data, offsets = base.byte_arrays(column)
        odd = needs_tokenizer(data, offsets)
        whole = np.flatnonzero(odd).tolist()
        if self.lower or whole:
            texts = [t or "" for t in column.to_pylist()]
            plain = ["" if o else (t.lower() if self.lower else t) for t, o in zip(texts, odd.tolist())]
            data, offsets = base.byte_arrays(pa.array(plain, pa.string()))
        if not len(data):
            out = [np.zeros(0, "<u4")] * len(column)
        else:
            starts, ends = self._units(data, offsets)
            ids, first, count = self._look_up(data, starts, ends)
            total = np.concatenate([[0], np.cumsum(count)])
            flat = ids[np.arange(total[-1]) + np.repeat(first - total[:-1], count)]
            bounds = total[np.searchsorted(starts, offsets)]
            out = [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        for i, ids in zip(whole, self._encode([texts[i] for i in whole]) if whole else []):
            out[i] = np.frombuffer(ids, "<u4")
        return out


def encoder(path: str) -> PieceEncoder:
    """One encoder in each worker, until it serves another operator."""
    return base.held(path, lambda: PieceEncoder(path))
