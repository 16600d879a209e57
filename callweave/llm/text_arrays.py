"""Words and lines of a batch of texts as arrays, for kernels that run inside Arrow functions.

Words are runs of bytes other than space and \\t..\\r; lines are split at \\n.  Byte positions count from the
batch's first byte.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

from callweave.llm.common import string_array, utf8

SYMBOLS = b"#*$%&|<>"


def table(*members: bytes) -> np.ndarray:
    """A byte table that holds True at the members."""
    flags = np.zeros(256, bool)
    for m in members:
        flags[list(m)] = True
    return flags


BLANK = table(b" \t\n\x0b\x0c\r")
SYMBOL = table(SYMBOLS)
UPPER = table(bytes(range(ord("A"), ord("Z") + 1)))
LOWER = table(bytes(range(ord("a"), ord("z") + 1)))
DIGIT = table(b"0123456789")
STOP = table(b".,;:!?'\"()-")


class TextArrays:
    def __init__(self, texts: pa.Array, lower: bool = False):
        self.data, self.offsets = utf8(texts)
        if lower:
            self.data = np.where(UPPER[self.data], self.data + 32, self.data).astype(np.uint8)
        self.n = len(self.offsets) - 1

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        return np.diff(self.running(flags)[self.offsets])

    @staticmethod
    def running(flags: np.ndarray) -> np.ndarray:
        """How many flags are set before each position."""
        out = np.zeros(len(flags) + 1, np.int32 if len(flags) < 1 << 31 else np.int64)
        np.cumsum(flags, out=out[1:])
        return out

    @functools.cached_property
    def visible(self) -> np.ndarray:
        return ~BLANK[self.data]

    @functools.cached_property
    def first_bytes(self) -> np.ndarray:
        """Where code points start."""
        return (self.data & 0xC0) != 0x80

    @functools.cached_property
    def upper(self) -> np.ndarray:
        """Upper-case letters of ASCII and of U+00C0..U+00DE, at their first byte."""
        flags = UPPER[self.data]
        if len(self.data) > 1:
            after = self.data[1:]
            flags[:-1] |= (self.data[:-1] == 0xC3) & (after >= 0x80) & (after <= 0x9E) & (after != 0x97)
        return flags

    @functools.cached_property
    def word_starts(self) -> np.ndarray:
        start = self.visible.copy()
        start[1:] &= ~self.visible[:-1]
        inner = self.offsets[:-1][self.offsets[:-1] < len(self.data)]
        start[inner] |= self.visible[inner]
        return np.flatnonzero(start)

    @functools.cached_property
    def words(self) -> pa.Array:
        before = self.running(self.visible)
        return string_array(self.data[self.visible], np.append(before[self.word_starts], before[-1]))

    @functools.cached_property
    def coded(self) -> pa.DictionaryArray:
        return self.words.dictionary_encode()

    @functools.cached_property
    def codes(self) -> np.ndarray:
        return self.coded.indices.to_numpy().astype(np.int64)

    @functools.cached_property
    def word_at(self) -> np.ndarray:
        """Each text's first word, and the number of words."""
        return np.searchsorted(self.word_starts, self.offsets)

    @functools.cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_at)

    @functools.cached_property
    def word_text(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    @functools.cached_property
    def line_ends(self) -> np.ndarray:
        """Byte ends of all lines; a text's last line ends with the text."""
        ends = np.sort(np.concatenate([self.offsets[1:] * 2, np.flatnonzero(self.data == 10) * 2 + 1]))
        self.last_line = (ends & 1) == 0
        return ends >> 1

    @functools.cached_property
    def n_lines(self) -> np.ndarray:
        return self.per_text(self.data == 10) + 1

    @functools.cached_property
    def line_text(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_lines)

    def per_line(self, flags: np.ndarray) -> np.ndarray:
        """Flags in each line (the \\n counts to the line that it ends)."""
        ends = np.minimum(self.line_ends + np.where(self.last_line, 0, 1), len(flags))
        return np.diff(self.running(flags)[ends], prepend=0)

    @functools.cached_property
    def line_codes(self) -> np.ndarray:
        """A number for each line; equal lines of the batch have equal numbers."""
        inside = self.data != 10
        at = np.concatenate([[0], self.running(inside)[self.line_ends]])
        return string_array(self.data[inside], at).dictionary_encode().indices.to_numpy().astype(np.int64)

    @functools.cached_property
    def repeated_line(self) -> np.ndarray:
        """Lines with a word that equal an earlier line of their text."""
        full = np.flatnonzero(self.per_line(self.visible) > 0)
        key = self.line_text[full] * (int(self.line_codes.max(initial=0)) + 1) + self.line_codes[full]
        _, first = np.unique(key, return_index=True)
        flags = np.zeros(len(self.line_ends), bool)
        flags[full] = True
        flags[full[first]] = False
        return flags

    def repeated_words(self, size: int) -> np.ndarray:
        """Words inside a window of ``size`` words that is found twice or more in its text."""
        covered = np.zeros(len(self.codes) + 1, np.int64)
        at = np.arange(len(self.codes) - size + 1) if len(self.codes) >= size else np.zeros(0, np.int64)
        at = at[self.word_text[at] == self.word_text[at + size - 1]]
        if len(at):
            mixed = mix(self.codes)
            key = mix(self.word_text[at])
            for j in range(size):
                key = key * np.uint64(0x9E3779B97F4A7C15) + mixed[at + j]
            order = np.argsort(key, kind="stable")
            near = np.flatnonzero(key[order[1:]] == key[order[:-1]])
            a, b = at[order[near]], at[order[near + 1]]
            same = self.word_text[a] == self.word_text[b]
            for j in range(size):
                same &= self.codes[a + j] == self.codes[b + j]
            twice = np.unique(np.concatenate([a[same], b[same]]))
            covered[twice] += 1
            covered[: len(self.codes)][(twice + size)[twice + size < len(self.codes)]] -= 1
        return np.cumsum(covered[:-1]) > 0


def mix(values: np.ndarray) -> np.ndarray:
    """64-bit hashes of integers (the finaliser of splitmix64)."""
    x = values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
