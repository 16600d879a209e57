"""BPE encoding and decoding by tree concatenation.

Texts up to ``leaf_chars`` are encoded in byte-balanced batches.  A longer text is halved
until its leaves are that short, wherever the halves fall; the leaves are spread over the
cluster and encoded in parallel.  Then neighbours are joined level by level: around each join a
window is re-encoded that grows until both sides agree with it, so that the ids are exactly
those of the whole text.

A side agrees when the window starts (ends) where the pre-tokenizer always cuts, or, inside an
unbroken run of letters, when the window and the side share tokens with equal spans: a sequence of
BPE tokens is the encoding of its pre-token if every two neighbours encode to themselves, and so
two encodings may be spliced at a shared token.  At the latest the window is the whole text.

Edge cases: a null text is the empty text (no ids, empty decoding); null and repeated ids and
repeated rows give one output row each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.bpe import PieceEncoder
from callweave.llm.common import parallelism, slices, tidy

LEAF_CHARS = 32_768
WINDOW_CHARS = 64
BATCH_BYTES = 2 << 20
#: Tokens that a window and a side must share inside a run of letters.
SHARED_TOKENS = 2

TYPES = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
ARROW = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def always_cut(before: str, after: str) -> bool:
    """Whether the pre-tokenizer cuts between two characters in any text.

    True for white space after something visible, and for punctuation after a letter; ``|`` is left
    out as it follows a letter inside special tokens.
    """
    if after in " \n":
        return not before.isspace()
    return before.isalpha() and after != "|" and not (after.isalpha() or after.isnumeric() or after.isspace())


def _bytes(text: str) -> int:
    return len(text.encode())


class Joiner:
    """Joins encodings of neighbouring texts."""

    def __init__(self, encoder: PieceEncoder, window_chars: int = WINDOW_CHARS):
        self.encoder, self.window_chars = encoder, window_chars

    def encode(self, text: str) -> np.ndarray:
        return self.encoder.encode(pa.array([text]))[0]

    def join(self, left: tuple[str, np.ndarray], right: tuple[str, np.ndarray]) -> tuple[str, np.ndarray]:
        (a, a_ids), (b, b_ids) = left, right
        if not a or not b:
            return a + b, np.concatenate([a_ids, b_ids])
        size = self.window_chars
        while size < max(len(a), len(b)):
            if (ids := self._cut_window(a, a_ids, b, b_ids, size)) is None:
                ids = self._run_window(a, a_ids, b, b_ids, size)
            if ids is not None:
                return a + b, ids
            size *= 2
        return a + b, self.encode(a + b)

    def _cut_window(self, a, a_ids, b, b_ids, size):
        """The window between a certain cut on either side; None if there is none within ``size``."""
        start = next((i for i in range(max(1, len(a) - size), len(a)) if always_cut(a[i - 1], a[i])), None)
        stop = next((i for i in range(min(len(b) - 1, size), 0, -1) if always_cut(b[i - 1], b[i])), None)
        if start is None or stop is None:
            return None
        keep = self._tokens_from_end(a_ids, _bytes(a[start:]))
        skip = self._tokens_from_start(b_ids, _bytes(b[:stop]))
        if keep is None or skip is None:
            return None
        return np.concatenate([a_ids[:keep], self.encode(a[start:] + b[:stop]), b_ids[skip:]])

    def _run_window(self, a, a_ids, b, b_ids, size):
        """The window inside a run of letters around the join, if it shares tokens with either side."""
        tail, head = a[-size:], b[:size]
        if not (tail.isalpha() and head.isalpha() and a[-size - 3 : -size].isalpha()):
            return None
        n_tail, n_head = _bytes(tail), _bytes(head)
        window = self.encode(tail + head)
        ends = np.cumsum(self.encoder.id_bytes[window])
        spans = {(int(e - n), int(e)): k for k, (e, n) in enumerate(zip(ends, self.encoder.id_bytes[window], strict=True))}
        a_back = np.cumsum(self.encoder.id_bytes[a_ids[::-1]])
        a_tail = int(np.searchsorted(a_back, n_tail, "right"))  # tokens wholly within the tail
        b_head = int(np.searchsorted(np.cumsum(self.encoder.id_bytes[b_ids]), n_head, "right"))
        if not a_tail or not b_head:
            return None
        own = [(n_tail - int(a_back[k]), n_tail - int(a_back[k] - self.encoder.id_bytes[a_ids[-1 - k]]), len(a_ids) - 1 - k) for k in range(a_tail)]
        shared_a = [(spans[s, e], k) for s, e, k in own if (s, e) in spans and window[spans[s, e]] == a_ids[k]]
        b_ends = n_tail + np.cumsum(self.encoder.id_bytes[b_ids[:b_head]])
        other = [(int(b_ends[k] - self.encoder.id_bytes[b_ids[k]]), int(b_ends[k]), k) for k in range(b_head)]
        shared_b = [(spans[s, e], k) for s, e, k in other if (s, e) in spans and window[spans[s, e]] == b_ids[k]]
        if len(shared_a) < SHARED_TOKENS or len(shared_b) < SHARED_TOKENS:
            return None
        (w0, a0), (w1, b1) = shared_a[0], shared_b[0]
        return np.concatenate([a_ids[:a0], window[w0:w1], b_ids[b1:]]) if w0 <= w1 else None

    def _tokens_from_end(self, ids, n_bytes):
        back = np.cumsum(self.encoder.id_bytes[ids[::-1][: n_bytes]])
        k = int(np.searchsorted(back, n_bytes))
        return len(ids) - k - 1 if k < len(back) and back[k] == n_bytes else None

    def _tokens_from_start(self, ids, n_bytes):
        ends = np.cumsum(self.encoder.id_bytes[ids[:n_bytes]])
        k = int(np.searchsorted(ends, n_bytes))
        return k + 1 if k < len(ends) and ends[k] == n_bytes else None

    def tree(self, leaves: Sequence[tuple[str, np.ndarray]]) -> tuple[str, np.ndarray]:
        """All leaves as one, by levels of neighbours."""
        while len(leaves) > 1:
            leaves = [self.join(*leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        return leaves[0]


def halves(text: str, leaf_chars: int) -> list[str]:
    """The text halved until no part is longer than ``leaf_chars``."""
    if len(text) <= leaf_chars:
        return [text]
    return [*halves(text[: len(text) // 2], leaf_chars), *halves(text[len(text) // 2 :], leaf_chars)]


def _columns(outputs: Sequence[str], encoder: PieceEncoder, each: list[np.ndarray]) -> dict:
    """The asked outputs of documents with these ids."""
    columns: dict = {"n_tokens": [len(x) for x in each]}
    if "ids" in outputs:
        columns["ids"] = [x.astype(np.int32) for x in each]
    if "ids_sha256" in outputs:
        columns["ids_sha256"] = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in each]
    if {"decoded", "decoded_sha256"} & set(outputs):
        decoded = []
        for lo in range(0, len(each), 64):
            decoded += encoder.tokenizer.decode_batch([x.tolist() for x in each[lo : lo + 64]], skip_special_tokens=False)
        columns["decoded"] = decoded
        columns["decoded_sha256"] = [hashlib.sha256(x.encode()).hexdigest() for x in decoded]
    return {k: columns[k] for k in outputs}


def encode_decode(
    docs: DataFrame, path: str, outputs: Sequence[str] = ("n_tokens", "ids", "decoded"),
    id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = LEAF_CHARS,
) -> DataFrame:
    """One row per document: ``id_col`` and the ``outputs`` (any of the keys of TYPES).

    ``path`` names the tokenizer file, which every executor has.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, " + ", ".join(f"`{k}` {TYPES[k]}" for k in outputs)

    def batch(ids: pa.Array, encoder: PieceEncoder, each: list[np.ndarray]) -> pa.RecordBatch:
        made = _columns(outputs, encoder, each)
        return pa.RecordBatch.from_arrays([ids, *(pa.array(made[k], ARROW[k]) for k in outputs)], ["id", *outputs])

    def short(batches: Iterable[pa.RecordBatch]):
        encoder = PieceEncoder(path)
        for whole in batches:
            for part in slices(whole, "text", BATCH_BYTES):
                flat, at = encoder.encode(part.column("text"))
                yield batch(part.column("id"), encoder, [flat[at[i] : at[i + 1]] for i in range(part.num_rows)])

    def leaves(batches: Iterable[pa.RecordBatch]):
        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for i in range(whole.num_rows):
                parts = halves(whole.column("text")[i].as_py(), leaf_chars)
                ids = whole.column("id").take(pa.array([i] * len(parts)))
                for lo in range(0, len(parts), 64):
                    n = len(parts[lo : lo + 64])
                    yield pa.RecordBatch.from_arrays([pa.array([row] * n, pa.int64()), ids.slice(lo, n), pa.array(range(lo, lo + n), pa.int32()), pa.array(parts[lo : lo + n])], ["row", "id", "leaf", "text"])
                row += 1

    def encode_leaves(batches: Iterable[pa.RecordBatch]):
        encoder = PieceEncoder(path)
        for whole in batches:
            for part in slices(whole, "text", BATCH_BYTES):
                flat, at = encoder.encode(part.column("text"))
                ids = pa.array([flat[at[i] : at[i + 1]].astype("<u4").tobytes() for i in range(part.num_rows)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "id", "leaf", "text")), ids], ["row", "id", "leaf", "text", "ids"])

    def join(table: pa.Table) -> pa.Table:
        encoder = _encoder(path)
        table = table.sort_by("leaf")
        parts = [(t, np.frombuffer(i, "<u4")) for t, i in zip(table["text"].to_pylist(), table["ids"].to_pylist(), strict=True)]
        _, ids = Joiner(encoder).tree(parts)
        return pa.Table.from_batches([batch(table["id"].slice(0, 1).combine_chunks(), encoder, [ids])])

    long = F.length("text") > leaf_chars
    spread = rows.where(long).mapInArrow(tidy(leaves), f"row long, id {id_type}, leaf int, text string").repartition(parallelism(docs.sparkSession), "row", "leaf")
    encoded = spread.mapInArrow(tidy(encode_leaves), f"row long, id {id_type}, leaf int, text string, ids binary")
    joined = encoded.groupBy("row").applyInArrow(join, schema)
    return rows.where(~long).mapInArrow(tidy(short), schema).unionAll(joined).withColumnRenamed("id", id_col)


_ENCODERS: dict[str, PieceEncoder] = {}


def _encoder(path: str) -> PieceEncoder:
    """One encoder for the groups of a worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
