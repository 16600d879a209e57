"""Encoding kernel: exact byte-level BPE over whole texts, one call per distinct piece.

A byte-level pre-tokenizer never puts a word character before white space into one
pre-token, so a text may be cut before any white space that follows a visible character:
the ids of the pieces in a row are the ids of the text.  Pieces repeat a lot, so each batch
encodes only its distinct pieces and gathers the ids of the texts from them.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from callweave.llm.common import string_array, utf8

#: Texts of one call stay under this many bytes (a longer text stands alone).
BATCH_BYTES = 8 << 20
#: Distinct pieces whose ids a Python worker keeps for later batches.
KEPT_PIECES = 150_000
KEPT_PIECE_BYTES = 24
#: Pieces are joined up to this many bytes a text for the tokenizer.
CALL_BYTES = 4096


def _check(described: dict, path: str) -> None:
    """Cutting at blanks is exact for one kind of tokenizer only; any other is refused."""
    cuts = described.get("pre_tokenizer") or {}
    added = [t["content"] for t in described.get("added_tokens") or []]
    fits = (described.get("model") or {}).get("type") == "BPE" and described.get("normalizer") is None
    fits = fits and cuts.get("type") == "ByteLevel" and not cuts.get("add_prefix_space", True) and cuts.get("use_regex", True)
    blank = [t for t in added if any(c.isspace() for c in t) or not re.fullmatch(r"<\|\w+\|>", t)]
    odd = [t for t in described.get("added_tokens") or [] if t.get("lstrip") or t.get("rstrip") or t.get("single_word")]
    if not fits or blank or odd:
        raise ValueError(f"{path} is no plain byte-level BPE with special tokens of the form <|name|>")


def tokenizer(path: str):
    """The tokenizer of a file, without truncation and padding; one thread, as Spark has the cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        _check(json.load(file), path)
    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def safe_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions where a piece may start: each text's start, and blanks after a visible character.

    The character before the blank is printable ASCII or one of several bytes that is no white space: all are but
    those that start with C2, E1 9A, E2 80, E2 81 or E3 80, where Unicode has spaces; after these nothing is
    cut, which is exact as well.
    """
    flag = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        blank = np.flatnonzero((data[1:] == 0x20) | (data[1:] == 0x0A)) + 1
        before = data[blank - 1]
        second, third = data[np.maximum(blank - 2, 0)], data[np.maximum(blank - 3, 0)]
        visible = (before >= 0x21) & (before <= 0x7E)
        two = (second >= 0xC3) & (second <= 0xDF)
        spaced = ((third == 0xE1) & (second == 0x9A)) | ((third == 0xE2) & ((second == 0x80) | (second == 0x81))) | ((third == 0xE3) & (second == 0x80))
        three = (second >= 0x80) & (second <= 0xBF) & (((third >= 0xE0) & (third <= 0xEF)) & ~spaced | ((third >= 0x80) & (third <= 0xBF)))
        visible |= (before >= 0x80) & (before <= 0xBF) & (two | three)
        flag[blank[visible]] = True
    flag[offsets[:-1]] = True
    flag[len(data)] = False
    return np.flatnonzero(flag)


class PieceEncoder:
    """Encodes Arrow arrays of texts; keeps the ids of repeated short pieces between calls."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        #: Bytes that each id stands for: a byte-level token has one character for each byte.
        self.id_bytes = np.zeros(size, np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.id_bytes[i] = len(token)
        self.kept, self.kept_ids, self.kept_n = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter((i for x in got for i in x), np.uint32), np.fromiter(map(len, got), np.int64, len(got))

    def _joined(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that all start with a blank and end visibly: cutting is exact, and so is joining."""
        data, at = utf8(words)
        texts, lo = [], 0
        while lo < len(words):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CALL_BYTES, "right")) - 1)
            texts.append(data[at[lo] : at[hi]].tobytes().decode())
            lo = hi
        ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.concatenate([*ids, np.zeros(0, np.uint32)])
        last = np.searchsorted(np.cumsum(self.id_bytes[flat]), at[1:], "left") + 1
        return flat, np.diff(last, prepend=0)

    def _encode_new(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, at = utf8(words)
        full = at[1:] > at[:-1]
        begin, end = data[at[:-1][full]], data[at[1:][full] - 1]
        fits = np.zeros(len(words), bool)
        fits[full] = ((begin == 0x20) | (begin == 0x0A)) & (end > 0x20) & (end < 0x7F)
        a, an = self._joined(words.filter(pa.array(fits)))
        b, bn = self._alone(words.filter(pa.array(~fits)).to_pylist())
        n = np.zeros(len(words), np.int64)
        n[fits], n[~fits] = an, bn
        joined = np.repeat(fits, n)
        flat = np.zeros(len(joined), np.uint32)
        flat[joined], flat[~joined] = a, b
        return flat, n

    def _distinct(self, words: pa.Array, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of distinct words, and how many each has; ``seen``: how often each is in the batch."""
        known = pc.index_in(words, value_set=self.kept).fill_null(-1).to_numpy()
        new = known < 0
        ids, n_new = self._encode_new(words.filter(pa.array(new)))
        n = np.zeros(len(words), np.int64)
        n[new], n[~new] = n_new, self.kept_n[known[~new]]
        flat = np.zeros(int(n.sum()), np.uint32)
        from_new = np.repeat(new, n)
        flat[from_new] = ids
        flat[~from_new] = gather(self.kept_ids, self.kept_n, known[~new])
        if len(self.kept) < KEPT_PIECES:
            worth = new & (seen > 1) & (pc.binary_length(words).to_numpy() <= KEPT_PIECE_BYTES)
            self.kept = pa.concat_arrays([self.kept, words.filter(pa.array(worth))])
            self.kept_ids = np.concatenate([self.kept_ids, flat[np.repeat(worth, n)]])
            self.kept_n = np.concatenate([self.kept_n, n[worth]])
        return flat, n

    def pieces(self, texts: pa.Array):
        """For each piece the index of its distinct form; flat ids and lengths of those; each text's first piece."""
        data, offsets = utf8(texts)
        starts = safe_starts(data, offsets)
        coded = string_array(data, np.append(starts, len(data))).dictionary_encode()
        index = coded.indices.to_numpy()
        ids, lengths = self._distinct(coded.dictionary, np.bincount(index, minlength=len(coded.dictionary)))
        return index, ids, lengths, np.searchsorted(starts, offsets)

    def counts(self, texts: pa.Array) -> np.ndarray:
        index, _, lengths, first = self.pieces(texts)
        before = np.concatenate([[0], np.cumsum(lengths[index])])
        return np.diff(before[first])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and the offsets of the texts among them."""
        index, ids, lengths, first = self.pieces(texts)
        before = np.concatenate([[0], np.cumsum(lengths[index])])
        return gather(ids, lengths, index), before[first]


def gather(values: np.ndarray, lengths: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Runs ``index`` of the runs that lie one after another in ``values``."""
    if not len(index):
        return values[:0]
    n, source = lengths[index], np.cumsum(lengths) - lengths
    return values[np.repeat(source[index] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
