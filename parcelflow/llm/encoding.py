"""Token ids of texts with a public tokenizer, by distinct pieces of words.

The vocabulary splits texts at white space before anything else, so a text's ids are those
of its words one after the other. Each Python worker keeps the ids of the pieces it has seen
(CACHE_WORDS at most; then it starts anew), so a piece is encoded about once a worker.

A piece is a word; where the tokenizer's own description says that it lower-cases and splits
letters from other characters (NORMALIZER, PRE_TOKENIZER), a run of ASCII marks that ends a word
behind a letter is a piece of its own, letters A-Z and those of Latin-1 are lower-cased before
pieces are told apart, and pieces of such letters alone go straight to the tokenizer's model.
Pieces are told apart by their bytes, so no two ever share ids by chance.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from parcelflow.llm.words import Words, padded, same_bytes

CACHE_WORDS = 1_000_000
#: Bytes of text encoded at once.
SLICE = 4 << 20
VOCABULARY = "word_bpe_49k.json"
END_ID = 2
#: The steps before the model for which words may be cut into pieces (fixed values of the vocabulary's file).
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_MARKS = np.zeros(256, dtype=bool)
_MARKS[[ord(c) for c in "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"]] = True  # neither ' (contractions) nor < | > (special tokens)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LATIN = 0xC3
_LATIN_LETTER = np.zeros(256, dtype=bool)
_LATIN_LETTER[0x80:0xC0] = True
_LATIN_LETTER[[0x97, 0xB7]] = False
_OTHER = np.zeros(256, dtype=bool)
_OTHER[0xC2:] = True
_OTHER[_LATIN], _OTHER[ord("<")] = False, True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MOST_MARKS = 8
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")


def _byte_chars() -> dict[int, int]:
    """The character that stands for each byte which isn't one itself, in ascending order from U+0100 on."""
    itself = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: 0x100 + k for k, b in enumerate(x for x in range(256) if x not in itself)}


_CHARS = _byte_chars()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(w: Words) -> Words:
    """w with the marks behind a word's last letter as words of their own, and simple letters lower-cased."""
    buf, start, end = w.buf, w.start, w.end
    cut = end.copy()
    at = np.arange(len(end))
    for _ in range(_MOST_MARKS):
        at = at[cut[at] - 1 > start[at]]
        at = at[_MARKS[buf[cut[at] - 1]]]
        cut[at] -= 1
    last = buf[cut - 1]
    letter = _LETTER[last]
    two = np.flatnonzero(cut - start > 1)
    letter[two] |= _LATIN_LETTER[last[two]] & (buf[cut[two] - 2] == _LATIN)
    split = (cut < end) & letter
    tail = np.flatnonzero(split)
    out = Words.__new__(Words)
    lower = _LOWER[buf]
    latin = np.flatnonzero(buf[:-1] == _LATIN) + 1 if len(buf) else np.zeros(0, np.int64)
    up = latin[(buf[latin] <= 0x9E) & (buf[latin] != 0x97)]
    lower[up] += 0x20
    out.start = np.insert(start, tail + 1, cut[tail])
    out.end = np.insert(np.where(split, cut, end), tail + 1, end[tail])
    out.at = w.at + np.concatenate([[0], np.cumsum(split)])[w.at]
    odd = np.unique(np.searchsorted(out.start, np.flatnonzero(_OTHER[buf]), side="right") - 1)  # such a piece stays as it is
    size = (out.end - out.start)[odd]
    back = np.repeat(out.start[odd] - np.cumsum(size) + size, size) + np.arange(size.sum())
    lower[back] = buf[back]
    out.buf, out.base = lower, w.base
    return out


class _Store:
    """Growing arrays of values and their bounds."""

    def __init__(self, kind: type):
        self.values, self.bounds, self.n = np.zeros(1 << 16, dtype=kind), np.zeros(1 << 14, dtype=np.int64), 0

    def add(self, values: np.ndarray, lens: np.ndarray) -> None:
        end = int(self.bounds[self.n])
        while end + len(values) + 8 > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        while self.n + len(lens) + 1 > len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        self.values[end : end + len(values)] = values
        self.bounds[self.n + 1 : self.n + 1 + len(lens)] = end + np.cumsum(lens)
        self.n += len(lens)


class Encoder:
    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        self.by_letters = told["normalizer"] == NORMALIZER and told["pre_tokenizer"] == PRE_TOKENIZER and told["model"]["type"] == "BPE"
        self.clear()

    def clear(self) -> None:
        self.known, self.where = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.raw = _Store(np.uint16), _Store(np.uint8)

    def _ids(self, words: list[str]) -> list[list[int]]:
        one = self.tokenizer.model.tokenize
        out: list = [None] * len(words)
        rest = []
        for k, x in enumerate(words):
            if self.by_letters and _PLAIN.fullmatch(x):
                out[k] = [t.id for t in one(x if x.isascii() else x.encode().decode("latin-1").translate(_CHARS))]
            else:
                rest.append(k)
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([words[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out

    def _learn(self, w: Words, at: np.ndarray) -> None:
        """Adds pieces of w at these places."""
        for k in range(0, len(at), 20_000):
            raw = [w.text(i) for i in at[k : k + 20_000].tolist()]
            found = self._ids([x.decode() for x in raw])
            flat = [x for f in found for x in f]
            self.ids.add(np.array(flat, dtype=np.uint16), np.fromiter(map(len, found), dtype=np.int64, count=len(found)))
            self.raw.add(np.frombuffer(b"".join(raw), dtype=np.uint8), np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty) one after the other, as uint16, and their bounds by text."""
        w = Words(pc.fill_null(texts, ""))
        if self.by_letters and len(w):
            w = pieces(w)
        n, pad = w.end - w.start, padded(w.buf)
        codes, unique = pd.factorize(w.hashes())
        first = np.zeros(len(unique), dtype=np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        if self.ids.n + len(unique) > CACHE_WORDS:
            self.clear()
        at = np.minimum(np.searchsorted(self.known, unique), max(len(self.known) - 1, 0))
        hit = self.known[at] == unique if len(self.known) else np.zeros(len(unique), bool)
        place = np.where(hit, self.where[at], 0) if len(self.known) else np.zeros(len(unique), np.int64)
        seen = np.flatnonzero(hit)
        bounds = self.raw.bounds[place[seen]]
        wrong = seen[~same_bytes(pad, w.start[first[seen]], n[first[seen]], self.raw.values, bounds, self.raw.bounds[place[seen] + 1] - bounds)]
        new = np.concatenate([np.flatnonzero(~hit), wrong])  # wrong: another piece has this number
        place[new] = self.ids.n + np.arange(len(new))
        self._learn(w, first[new])
        fresh = np.flatnonzero(~hit)
        if len(fresh):
            fresh = fresh[np.argsort(unique[fresh])]
            to = np.searchsorted(self.known, unique[fresh])
            self.known, self.where = np.insert(self.known, to, unique[fresh]), np.insert(self.where, to, place[fresh])
        at = place[codes]
        alike = same_bytes(pad, w.start, n, pad, w.start[first[codes]], n[first[codes]])
        if not alike.all():  # pieces of one number with different bytes
            odd = np.flatnonzero(~alike)
            at[odd] = self.ids.n + np.arange(len(odd))
            self._learn(w, odd)
        lens = self.ids.bounds[at + 1] - self.ids.bounds[at]
        ends = np.concatenate([[0], np.cumsum(lens)])
        take = np.arange(ends[-1]) + np.repeat(self.ids.bounds[at] - ends[:-1], lens)
        return self.ids.values[take], ends[w.at]


def lengths(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Of batches with a text column: the other columns and n_tokens."""
    from parcelflow.llm.words import slices

    for batch in batches:
        for part in slices(batch, "text", SLICE):
            _, bounds = encoder(path).encode(part.column("text"))
            rest = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(np.diff(bounds))], [*rest, "n_tokens"])
