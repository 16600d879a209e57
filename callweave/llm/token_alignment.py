"""Alignment of two tokenizers over the same texts, composed out of fragments of byte ranges.

A byte-level BPE (A) reads a space and the text; a sentencepiece BPE with byte fallback (B) reads the text and puts the
space there itself, so both tokenize the same bytes.  Where tokens of both end, they are cut into groups; tokens of a
group whose byte ranges overlap are linked.

Documents of up to ``CHUNK_BYTES`` are aligned where they lie.  Both tokenizers cut before a space that follows a
visible character, so a batch aligns each distinct piece once and adds up pieces.  Longer documents are dealt to tasks as
byte ranges.  A range holds the tokens of A from its first cut of A to that of the next range, and likewise those of B; as
A and B may not be cut at the same places, its ends are open.  Such a fragment is

    open head | digest of the closed groups | open tail        (or an open head alone, if no token ends of both meet)

and fragments form a monoid: the tail of the left one and the head of the right one are joined, groups that close there
are added to the digests, and what stays open becomes head or tail of the result.  Composition is associative, so
fragments of a document are reduced in a tree, ``FAN`` neighbours at a time, whatever tasks they come from.

A document keeps its distinct id pairs with their number of links in a table in the shared folder; counts of the
corpus come from one aggregation over it and return to the documents by a join, broadcast while the pairs are few, salted
and shuffled beyond that.

Edge cases: texts that are null or empty have no tokens, nor have texts whose joined token bytes differ from space and text
(B turns U+2581 into a space): zeros and an empty digest.  Null and repeated ids and repeated rows count row by row; an empty
table gives an empty table; other columns are ignored, whatever their names.  Strings of special tokens are plain text.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callweave.llm.bpe import CALL_BYTES, PieceEncoder, gather, safe_starts
from callweave.llm.common import BROADCAST_ROWS, cut_lineage, parallelism, shared_folder, slices, string_array, tidy, utf8

BATCH_BYTES = 2 << 20
#: Longer documents are dealt out in ranges of about so many bytes.
CHUNK_BYTES = 32 << 10
#: Fragments that one step of the reduction composes.
FAN = 16
#: Copies of the pair counts, and parts of each pair's documents, where they are joined by a shuffle.
SALTS = 16
_META = "▁".encode()


class PlainEncoder(PieceEncoder):
    """The byte-level tokenizer, special strings being plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True


class SentencePieces(PieceEncoder):
    """A sentencepiece model over streams that start with the space that it would add; cut before spaces."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        names = self.model.id_to_piece(list(range(n)))
        own = [bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        if any(" " in p.replace("▁", " ").lstrip(" ") or "\n" in p for p in names) or self.model.encode("  x", out_type=str)[-1] != "▁x":
            raise ValueError(f"{path} has pieces with inner spaces, or drops spaces")
        self.blank = self.model.piece_to_id("▁")
        self.id_bytes = np.array([len(b) for b in own], np.int64)
        self.spelled = np.frombuffer(b"".join(own), np.uint8)
        self.kept, self.kept_ids, self.kept_n = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [x if w != " " else [self.blank] for x, w in zip(self.model.encode([w[1:] for w in words], num_threads=1), words, strict=True)]
        return np.fromiter((i for x in got for i in x), np.uint32), np.fromiter(map(len, got), np.int64, len(got))

    def _joined(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, at = utf8(words)
        texts, lo = [], 0
        while lo < len(words):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CALL_BYTES, "right")) - 1)
            texts.append(data[at[lo] + 1 : at[hi]].tobytes().decode())
            lo = hi
        flat = np.concatenate([*(np.array(x, np.uint32) for x in self.model.encode(texts, num_threads=1)), np.zeros(0, np.uint32)])
        ends = np.cumsum(self.id_bytes[flat])
        last = np.searchsorted(ends, at[1:], "left")
        if len(words) and (last[-1] + 1 != len(flat) or (ends[last] != at[1:]).any()):
            return self._alone(words.to_pylist())
        return flat, np.diff(last + 1, prepend=0)

    @staticmethod
    def cuts(data: np.ndarray) -> np.ndarray:
        """Spaces after anything but a space, which no piece of the model spans."""
        return np.flatnonzero((data[1:] == 0x20) & (data[:-1] != 0x20)) + 1

    def pieces(self, texts: pa.Array):
        data, offsets = utf8(texts)
        starts = np.union1d(self.cuts(data), offsets[:-1][offsets[:-1] < len(data)])
        coded = string_array(data, np.append(starts, len(data))).dictionary_encode()
        index = coded.indices.to_numpy()
        ids, lengths = self._distinct(coded.dictionary, np.bincount(index, minlength=len(coded.dictionary)))
        return index, ids, lengths, np.searchsorted(starts, offsets)

    def agrees(self, words: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Words whose pieces spell their bytes."""
        data, at = utf8(words)
        first = np.concatenate([[0], np.cumsum(lengths)])
        size = np.diff(np.concatenate([[0], np.cumsum(self.id_bytes[ids])])[first])
        same = size == np.diff(at)
        spelled = gather(self.spelled, self.id_bytes, ids[np.repeat(same, lengths)].astype(np.int64))
        wrong = np.flatnonzero(data[np.repeat(same, np.diff(at))] != spelled)
        of = np.flatnonzero(same)
        same[of[np.unique(np.searchsorted(np.cumsum(size[of]), wrong, "right"))]] = False
        return same


# Aligned runs


@functools.lru_cache(1)
def _digits(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal forms of 0..most, each followed by ``,``, then each by ``|``, then each by ``;``."""
    forms = [f"{i}{c}".encode() for c in ",|;" for i in range(most + 1)]
    return np.frombuffer(b"".join(forms), np.uint8), np.array([len(f) for f in forms], np.int64)


class Aligner:
    """Groups and links of token runs that begin and end together."""

    def __init__(self, a_size: int, b_size: int):
        self.most, self.b_size = max(a_size, b_size), b_size
        self.forms, self.form_bytes = _digits(self.most)

    def links(self, a, a_ends, b, b_ends) -> tuple[np.ndarray, np.ndarray]:
        """Id pairs of all overlaps and where each overlap ends: one for each stretch without an end inside."""
        ends = np.union1d(a_ends, b_ends)
        at_a, at_b = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
        return a[at_a].astype(np.int64) * self.b_size + b[at_b], ends

    def groups(self, a, a_ends, b, b_ends) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of ``a1,a2|b1;`` for all groups in a row, the byte ends of the groups among the texts and among those bytes."""
        a_last = np.isin(a_ends, b_ends, assume_unique=True)
        b_last = np.isin(b_ends, a_ends, assume_unique=True)
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        order = np.zeros(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.searchsorted(b_group, a_group, "left")] = a + np.where(a_last, 1, 0) * (self.most + 1)
        at_b = np.arange(len(b)) + np.searchsorted(a_group, b_group, "right")
        order[at_b] = b + np.where(b_last, 2, 0) * (self.most + 1)
        written = np.cumsum(self.form_bytes[order])
        return gather(self.forms, self.form_bytes, order), a_ends[a_last], written[at_b[b_last]]


@dataclass
class Run:
    """Tokens of A from byte a0 and of B from byte b0, with the ends of each."""

    a0: int
    b0: int
    a: np.ndarray
    a_ends: np.ndarray
    b: np.ndarray
    b_ends: np.ndarray

    def between(self, low: int | None, high: int | None) -> Run:
        """Tokens that end after ``low`` and up to ``high``."""
        keep = lambda e: (e > (-1 if low is None else low)) & (True if high is None else e <= high)
        x, y = keep(self.a_ends), keep(self.b_ends)
        return Run(self.a0 if low is None else low, self.b0 if low is None else low, self.a[x], self.a_ends[x], self.b[y], self.b_ends[y])

    def then(self, other: Run) -> Run:
        return Run(self.a0, self.b0, *(np.concatenate([getattr(self, k), getattr(other, k)]) for k in ("a", "a_ends", "b", "b_ends")))

    def meets(self) -> np.ndarray:
        """Places where tokens of both end."""
        return np.intersect1d(np.append(self.a_ends, self.a0), np.append(self.b_ends, self.b0))


@dataclass
class Closed:
    """Digest of closed groups: counts, their text, and their id pairs with numbers of links."""

    n_a: int
    n_b: int
    n_groups: int
    text: bytes
    pairs: np.ndarray
    links: np.ndarray

    @staticmethod
    def of(run: Run, aligner: Aligner) -> Closed:
        if not len(run.a):
            return Closed(0, 0, 0, b"", np.zeros(0, np.int64), np.zeros(0, np.int64))
        text, ends, _ = aligner.groups(run.a, run.a_ends, run.b, run.b_ends)
        pairs, links = np.unique(aligner.links(run.a, run.a_ends, run.b, run.b_ends)[0], return_counts=True)
        return Closed(len(run.a), len(run.b), len(ends), text.tobytes(), pairs, links)

    def plus(self, other: Closed) -> Closed:
        pairs, at = np.unique(np.concatenate([self.pairs, other.pairs]), return_inverse=True)
        links = np.bincount(at, np.concatenate([self.links, other.links]), len(pairs)).astype(np.int64)
        return Closed(self.n_a + other.n_a, self.n_b + other.n_b, self.n_groups + other.n_groups, self.text + other.text, pairs, links)


@dataclass
class Fragment:
    """What a byte range knows of a document; ``tail`` is None while no token ends of both have met."""

    head: Run
    closed: Closed
    tail: Run | None

    @staticmethod
    def of(run: Run, aligner: Aligner) -> Fragment:
        meets = run.meets()
        if not len(meets):
            return Fragment(run, Closed.of(run.between(0, 0), aligner), None)
        first, last = int(meets[0]), int(meets[-1])
        return Fragment(run.between(None, first), Closed.of(run.between(first, last), aligner), run.between(last, None))

    def plus(self, right: Fragment, aligner: Aligner) -> Fragment:
        """The associative composition with the fragment of the range that follows."""
        middle = Fragment.of((self.head if self.tail is None else self.tail).then(right.head), aligner)
        if middle.tail is None:
            return middle
        closed = self.closed.plus(middle.closed).plus(right.closed)
        return Fragment(middle.head if self.tail is None else self.head, closed, middle.tail if right.tail is None else right.tail)


_RUN = [("a0", "long"), ("b0", "long"), ("a", "array<long>"), ("a_ends", "array<long>"), ("b", "array<long>"), ("b_ends", "array<long>")]
_CLOSED = [("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("text", "binary"), ("pairs", "array<long>"), ("links", "array<long>")]
#: A fragment as a row: the document, the place among its fragments, whether all bytes agree, then head, digest and tail.
_FRAGMENT = ", ".join(["row long, at long, agrees boolean, has_tail boolean", *(f"{p}_{n} {t}" for p, names in (("head", _RUN), ("closed", _CLOSED), ("tail", _RUN)) for n, t in names)])


def _to_row(row: int, at: int, agrees: bool, f: Fragment) -> dict:
    tail = f.tail if f.tail is not None else Run(0, 0, *(np.zeros(0, np.int64) for _ in range(4)))
    parts = {f"{p}_{n}": getattr(x, n) for p, x, names in (("head", f.head, _RUN), ("closed", f.closed, _CLOSED), ("tail", tail, _RUN)) for n, _ in names}
    return {"row": row, "at": at, "agrees": agrees, "has_tail": f.tail is not None} | parts


def _from_row(r: dict) -> Fragment:
    take = lambda p, names, kind: kind(*(np.asarray(r[f"{p}_{n}"], np.int64) if t.startswith("array") else r[f"{p}_{n}"] for n, t in names))
    return Fragment(take("head", _RUN, Run), take("closed", _CLOSED, Closed), take("tail", _RUN, Run) if r["has_tail"] else None)


# Documents


def _short(rows: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Documents aligned piece by piece, in batches."""

    def align(batches: Iterable[pa.RecordBatch]):
        a_code, b_code = PlainEncoder(a_path), SentencePieces(b_path)
        aligner = Aligner(len(a_code.id_bytes), len(b_code.id_bytes))
        for whole in batches:
            for part in slices(whole, "text", BATCH_BYTES):
                yield _align_batch(part, a_code, b_code, aligner)

    return rows.mapInArrow(tidy(align), _document(rows))


def _document(rows: DataFrame) -> str:
    return f"id {rows.schema['id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<int>"


def _align_batch(part: pa.RecordBatch, a_code: PlainEncoder, b_code: SentencePieces, aligner: Aligner) -> pa.RecordBatch:
    texts = part.column("text").fill_null("")
    texts = pc.if_else(pc.match_substring(texts, "▁"), "", texts)
    texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
    data, offsets = utf8(texts)
    starts = safe_starts(data, offsets)
    starts = starts[data[starts] == 0x20] if len(data) else starts
    coded = string_array(data, np.append(starts, len(data))).dictionary_encode()
    words, index, first = coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.searchsorted(starts, offsets)
    seen = np.bincount(index, minlength=len(words))
    a, a_n = a_code._distinct(words, seen)
    b, b_n = b_code._distinct(words, seen)
    agrees = b_code.agrees(words, b, b_n)
    a, b, a_n, b_n = a[np.repeat(agrees, a_n)].astype(np.int64), b[np.repeat(agrees, b_n)].astype(np.int64), a_n * agrees, b_n * agrees
    a_ends, b_ends = np.cumsum(a_code.id_bytes[a]), np.cumsum(b_code.id_bytes[b])
    word_ends = np.cumsum(np.diff(utf8(words)[1]) * agrees)
    pairs, pair_ends = aligner.links(a, a_ends, b, b_ends)
    text, group_ends, written = aligner.groups(a, a_ends, b, b_ends)
    upto = lambda ends: np.concatenate([[0], np.searchsorted(ends, word_ends, "right")])
    pair_n, group_at = np.diff(upto(pair_ends)), upto(group_ends)
    group_n = np.diff(group_at)
    forms = string_array(text, np.concatenate([[0], written])[group_at])
    keep = np.ones(part.num_rows, bool)
    owner = np.repeat(np.arange(part.num_rows), np.diff(first))
    keep[owner[~agrees[index]]] = False
    per_text = lambda n: np.diff(np.concatenate([[0], np.cumsum(n[index])])[first]) * keep
    stream, stream_at = utf8(forms.cast(pa.large_string()).take(pa.array(index)))
    at = stream_at[first]
    digests = [hashlib.sha256(stream[at[i] : at[i + 1] - 1]).hexdigest() if keep[i] and at[i + 1] > at[i] else "" for i in range(part.num_rows)]
    n_links = per_text(pair_n)
    size = int(aligner.b_size) * (aligner.most + 1)
    key = np.sort((np.repeat(owner, pair_n[index]) * size + gather(pairs, pair_n, index))[np.repeat(keep[owner], pair_n[index])])
    new = np.flatnonzero(np.diff(key, prepend=-1))
    lists = np.searchsorted(key[new], np.arange(part.num_rows + 1) * size).astype(np.int32)
    times = np.diff(np.append(new, len(key)))
    columns = [part.column("id"), *(pa.array(x) for x in (per_text(a_n), per_text(b_n), per_text(group_n), n_links)), pa.array(digests, pa.string())]
    columns += [pa.ListArray.from_arrays(lists, pa.array(key[new] % size)), pa.ListArray.from_arrays(lists, pa.array(times.astype(np.int32)))]
    return pa.RecordBatch.from_arrays(columns, ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"])


def _ranges(rows: DataFrame, chunk: int) -> DataFrame:
    """Each long document as byte ranges: row, at, the texts that A and B read there, and where these start."""

    def cut(batches: Iterable[pa.RecordBatch]):
        for whole in batches:
            for i, text in enumerate(whole.column("text")):
                data = np.frombuffer(b" " + text.as_py().encode(), np.uint8)
                marks = np.arange(chunk, len(data), chunk)
                sides = []
                for safe in (safe_starts(data, np.array([0, len(data)])), SentencePieces.cuts(data)):
                    safe = np.append(safe, len(data))
                    sides.append([0, *safe[np.searchsorted(safe, marks)].tolist(), len(data)])
                for at, (a0, a1, b0, b1) in enumerate(zip(sides[0], sides[0][1:], sides[1], sides[1][1:], strict=False)):
                    pieces = [whole.column("row")[i].as_py()], [at], [a0], [b0], [data[a0:a1].tobytes().decode()], [data[b0:b1].tobytes().decode()]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in pieces], ["row", "at", "a0", "b0", "a_text", "b_text"])

    return rows.select("row", "text").mapInArrow(tidy(cut), "row long, at long, a0 long, b0 long, a_text string, b_text string")


def _fragments(ranges: DataFrame, a_path: str, b_path: str) -> DataFrame:
    def read(batches: Iterable[pa.RecordBatch]):
        a_code, b_code = PlainEncoder(a_path), SentencePieces(b_path)
        aligner = Aligner(len(a_code.id_bytes), len(b_code.id_bytes))
        for whole in batches:
            for r in whole.to_pylist():
                a, _ = a_code.encode(pa.array([r["a_text"]]))
                b_texts = pa.array([r["b_text"]])
                b, _ = b_code.encode(b_texts)
                agrees = _META not in r["b_text"].encode() and bool(b_code.agrees(b_texts, b, np.array([len(b)]))[0])
                a_ends, b_ends = r["a0"] + np.cumsum(a_code.id_bytes[a]), r["b0"] + np.cumsum(b_code.id_bytes[b])
                run = Run(r["a0"], r["b0"], a.astype(np.int64), a_ends, b.astype(np.int64), b_ends) if agrees else Run(0, 0, *(np.zeros(0, np.int64) for _ in range(4)))
                yield _batch([_to_row(r["row"], r["at"], agrees, Fragment.of(run, aligner))])

    return ranges.mapInArrow(tidy(read), _FRAGMENT)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema([(n, _ARROW[t]) for n, t in (x.rsplit(" ", 1) for x in _FRAGMENT.split(", "))]))


_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _composed(fragments: DataFrame, most: int, a_size: int, b_size: int) -> DataFrame:
    """One fragment a document: ``FAN`` neighbours at a time, level by level."""

    def compose(key, table):
        aligner = Aligner(a_size, b_size)
        rows = sorted(table.to_pylist(), key=lambda r: r["at"])
        agrees, whole = all(r["agrees"] for r in rows), _from_row(rows[0])
        for r in rows[1:] if agrees else []:
            whole = whole.plus(_from_row(r), aligner)
        return pa.Table.from_batches([_batch([_to_row(rows[0]["row"], key[1].as_py(), agrees, whole)])])

    while most > 1:
        fragments = fragments.groupBy("row", F.expr(f"at div {FAN}").alias("next")).applyInArrow(compose, _FRAGMENT)
        most = -(-most // FAN)
    return fragments


def _long(rows: DataFrame, a_path: str, b_path: str, chunk: int) -> DataFrame:
    """Documents beyond ``chunk`` bytes, their ranges in tasks of their own."""
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))
    ranges = cut_lineage(_ranges(rows, chunk))
    most = (ranges.agg(F.max("at")).first()[0] or 0) + 1
    n = parallelism(rows.sparkSession)
    sizes = _sizes(a_path, b_path)
    whole = _composed(_fragments(ranges.repartition(n, "row", "at"), a_path, b_path), most, *sizes)
    n_links = F.aggregate("closed_links", F.lit(0).cast("long"), lambda s, x: s + x)
    made = whole.where("agrees").select(
        "row", *(F.col(f"closed_{c}").alias(c) for c in ("n_a", "n_b", "n_groups")), n_links.alias("n_links"),
        F.sha2(F.expr("substring(closed_text, 1, octet_length(closed_text) - 1)"), 256).alias("groups_sha256"), F.col("closed_pairs").alias("pairs"), F.col("closed_links").cast("array<int>").alias("links"),
    )
    joined = rows.select("id", "row").join(made, "row", "left").drop("row")
    return joined.na.fill(0, ["n_a", "n_b", "n_groups", "n_links"]).na.fill("", ["groups_sha256"])


def _sizes(a_path: str, b_path: str) -> tuple[int, int]:
    return len(PlainEncoder(a_path).id_bytes), len(SentencePieces(b_path).id_bytes)


def align_tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``id_col``, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for every document."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    long = F.coalesce(F.octet_length("text"), F.lit(0)) > chunk
    folder = f"{shared_folder(docs.sparkSession)}/aligned-{uuid.uuid4().hex}"
    for name, made in (("short", _short(rows.where(~long), a_path, b_path)), ("long", _long(rows.where(long), a_path, b_path, chunk))):
        made.write.option("compression", "zstd").parquet(f"{folder}/{name}")
    aligned = docs.sparkSession.read.parquet(f"{folder}/short", f"{folder}/long").withColumn("row", F.monotonically_increasing_id())
    b_size = _sizes(a_path, b_path)[1]
    linked = aligned.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("row", "x.pairs", F.col("x.links").cast("long").alias("links"))
    counts = linked.groupBy("pairs").agg(F.sum("links").alias("count"))
    best = F.max("count").over(Window.partitionBy(F.col("pairs") % b_size)) == F.col("count")
    counts = cut_lineage(counts.select("pairs", "count", best.alias("best")))
    if counts.count() <= broadcast_rows:
        known = linked.join(F.broadcast(counts), "pairs")
    else:
        copies = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        known = linked.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(copies, ["pairs", "salt"])
    sums = known.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("count")).alias("count_sum"))
    shown = aligned.drop("pairs", "links").join(sums, "row", "left").na.fill(0, ["n_best", "count_sum"])
    return shown.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
