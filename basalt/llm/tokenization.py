"""Token ids of whole texts by a tokenizer file, a distinct piece at a time.

The word tokenizer composes (NFC), lower-cases, drops white space and splits what is left into runs
of letters, single digits and runs of other characters before its merges; the ids of a text are
those of its pieces in order.  Each worker asks the library once per distinct piece and gathers ids
with numpy.  Words of ASCII and of Latin-1 letters are split into pieces by numpy; every other word
(apostrophes, ``<`` and ``|`` of special tokens, all other characters) goes whole to ``encode``.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd

from . import kernels as K

#: Distinct pieces that a worker keeps; the store starts anew beyond it.
MAX_PIECES = 400_000

_U64 = np.uint64
_LETTER, _DIGIT, _OTHER = 1, 2, 3
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT
#: Bytes that leave a word whole; those of Latin-1 letters are taken out where they follow 0xC3.
_WHOLE = np.zeros(256, dtype=bool)
_WHOLE[[*range(0x00, 0x20), 0x27, 0x3C, 0x7C, 0x7F, *range(0x80, 0x100)]] = True


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = {}, 0x100
    for b in range(256):
        if b in printable:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


def pieces(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes; starts, ends and wholeness of pieces; each document's first piece (+ the total).

    A whole piece is a word for ``encode``; its bytes in the lower-cased array are as they were
    wherever lower case could differ from the library's, since only ASCII and Latin-1 letters change.
    """
    starts, ends, _ = K.words(data, bounds, K.SPACE)
    if not len(starts):
        return data, starts, ends, np.zeros(0, dtype=bool), np.zeros(len(bounds), dtype=np.int64)
    whole = _WHOLE[data]
    lower = K.LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    second = data[lead + 1]
    latin = lead[(second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)]
    whole[latin] = False
    whole[latin + 1] = False
    upper = latin[data[latin + 1] <= 0x9E] + 1
    lower[upper] += 0x20
    many = np.zeros(len(data) + 1, dtype=np.int32)
    np.cumsum(whole, out=many[1:])
    is_whole = many[ends] > many[starts]
    kind = _CLASS[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    # no cut within whole words, between words or in white space
    depth = np.zeros(len(data) + 1, dtype=np.int8)
    simple = ~is_whole
    depth[starts[simple]] += 1
    depth[ends[simple]] -= 1
    cut &= np.cumsum(depth, dtype=np.int8).astype(bool)
    cut[starts] = True
    begin = np.flatnonzero(cut)
    closing = np.zeros(len(data) + 1, dtype=bool)
    closing[ends] = True
    inner = cut.copy()
    inner[starts] = False
    closing |= inner
    end = np.flatnonzero(closing)
    word = np.searchsorted(starts, begin, side="right") - 1
    return lower, begin, end, is_whole[word], np.searchsorted(begin, bounds)


class PieceEncoder:
    def __init__(self, path: str, specials_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = specials_as_text
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = str.maketrans(_byte_letters())
        self.clear()

    def clear(self) -> None:
        self.slots = 1 << 16
        self.keys = np.zeros(self.slots, dtype=_U64)
        self.place = np.zeros(self.slots, dtype=np.int64)
        self.count = self.used = 0
        self.flat = np.zeros(1 << 18, dtype=np.uint32)
        self.offset = np.zeros(1 << 16, dtype=np.int64)
        self.length = np.zeros(1 << 16, dtype=np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Where each piece's ids are listed; -1 where it isn't known."""
        mask = _U64(self.slots - 1)
        at = hashes & mask
        out = np.full(len(hashes), -1, dtype=np.int64)
        open_ = np.arange(len(hashes))
        while len(open_):
            kept = self.keys[at]
            hit = kept == hashes[open_]
            out[open_[hit]] = self.place[at[hit]]
            more = ~hit & (kept != 0)
            open_ = open_[more]
            at = (at[more] + _U64(1)) & mask
        return out

    def _insert(self, hashes: np.ndarray, places: np.ndarray) -> None:
        mask = self.slots - 1
        keys, place = self.keys, self.place
        for h, p in zip(hashes.tolist(), places.tolist(), strict=True):
            at = h & mask
            while keys[at]:
                at = (at + 1) & mask
            keys[at] = h
            place[at] = p

    def _learn(self, hashes: np.ndarray, texts: list[bytes], whole: list[bool]) -> None:
        tokenize, letters, encode = self.tokenize, self.letters, self.tokenizer.encode
        ids: list[int] = []
        lengths: list[int] = []
        for text, is_whole in zip(texts, whole, strict=True):
            n = len(ids)
            if is_whole:
                ids += encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
            else:
                ids += [t.id for t in tokenize(text.decode("latin-1").translate(letters))]
            lengths.append(len(ids) - n)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + len(texts) > len(self.offset):
            self.offset = np.concatenate([self.offset, np.zeros_like(self.offset)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        new = np.arange(self.count, self.count + len(texts))
        self.length[new] = lengths
        self.offset[new] = self.used + np.cumsum(lengths) - lengths
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.count += len(texts)
        if 2 * self.count > self.slots:
            held = self.keys[self.keys != 0], self.place[self.keys != 0]
            while 2 * self.count > self.slots:
                self.slots *= 4
            self.keys, self.place = np.zeros(self.slots, dtype=_U64), np.zeros(self.slots, dtype=np.int64)
            self._insert(*held)
        self._insert(hashes, new)

    def encode_block(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block's documents in order, and where each document's ids begin (+ the total)."""
        if self.count > MAX_PIECES or self.used > 16 * MAX_PIECES:
            self.clear()
        lower, begin, end, whole, first = pieces(data, bounds)
        if not len(begin):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(bounds), dtype=np.int64)
        hashes = K.hash_words(lower, begin, end) | _U64(1)
        if whole.any():  # a whole word is told by its own bytes
            hashes[whole] = K.hash_words(data, begin[whole], end[whole]) & ~_U64(1) | _U64(2)
        place = self._find(hashes)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            back, distinct = pd.factorize(hashes[missing])
            sample = np.empty(len(distinct), dtype=np.int64)
            sample[back[::-1]] = missing[::-1]
            raw, low = data.tobytes(), lower.tobytes()
            spans = zip(begin[sample].tolist(), end[sample].tolist(), whole[sample].tolist(), strict=True)
            texts = [raw[a:b] if w else low[a:b] for a, b, w in spans]
            at = self.count
            self._learn(distinct, texts, whole[sample].tolist())
            place[missing] = at + back
        length = self.length[place]
        upto = np.zeros(len(length) + 1, dtype=np.int64)
        np.cumsum(length, out=upto[1:])
        ids = self.flat[np.repeat(self.offset[place] - upto[:-1], length) + np.arange(upto[-1])]
        return ids, upto[first]


_encoders: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, specials_as_text: bool = False) -> PieceEncoder:
    """This worker's encoder; later tasks find its pieces again."""
    if (path, specials_as_text) not in _encoders:
        _encoders[path, specials_as_text] = PieceEncoder(path, specials_as_text)
    return _encoders[path, specials_as_text]
