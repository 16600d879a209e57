"""Reads at the sites of a tile: the sites as one sorted array, the CIGAR laid out once, partial counts out of every batch.

A contig is cut into tiles.  Each tile's sites are one array; each read goes to the tiles that it spans, mostly one.  Both
are dealt by tile and sorted, so that a task meets the sites of a tile first and then streams its reads past them.  A read finds
its sites by binary search, and what it says at each is looked up in a table of its CIGAR, made once for all reads that share it.  Read-site pairs
live in one batch only: what leaves a task are sums and value counts by site.  So as many rows are shuffled as there are reads, and a
second time as there are sites.

Tiles with more than ``READS_PER_PART`` reads are dealt to several tasks by read name, so mates stay together.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.operators.ensemble import KEY
from callweave.operators.reads import with_end

TILE = 1 << 13
READS_PER_PART = 50_000
#: Read-site pairs that are laid out at once, about; and partial results of a tile that are held before they are merged.
PAIRS_AT_ONCE, HELD = 1 << 17, 8
#: Cells of a dense count, for each value that is counted; sparser ones are sorted.
DENSE = 8
#: Distances to other indels that count at most.
NEAR = 3
MATCH, INSERTION, DELETION, UNKNOWN = range(4)
_NONE = np.iinfo(np.int32).min
_OPS = re.compile(r"([0-9]+)([MIDNSHP=X])")
_READ = {"start0": "long", "end0": "long", "cigar": "string", "seq": "string", "quals": "string", "mapq": "int", "flag": "int", "nm": "int"}


@functools.lru_cache(4096)
def laid_out(cigar: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
    """For each reference base under a read: kind, indel length, offset in the read, distance to another indel; and whether it is clipped."""
    ops = [(int(n), c) for n, c in _OPS.findall(cigar) if c not in "HP"]
    kinds = ["ins" if c in "IS" else "del" if c in "DN" else "match" for _, c in ops]
    read = pair = 0
    at = []
    for (n, _), k in zip(ops, kinds, strict=True):
        at.append((read, pair))
        read, pair = read + n * (k != "del"), pair + n
    parts = [[], [], [], []]
    left_end = None
    for i, ((n, _), k) in enumerate(zip(ops, kinds, strict=True)):
        if k != "ins":
            kind, length, offset, near = np.zeros(n, np.int8), np.zeros(n, np.int32), np.full(n, -1, np.int32), np.full(n, np.inf)
            if k == "del":
                kind[:], length[:], near[:] = UNKNOWN, _NONE, np.nan
            else:
                offset[:] = at[i][0] + np.arange(n)
                follows = kinds[i + 1] if i + 1 < len(ops) else None
                if follows is None:
                    length[n - 1 :] = _NONE
                elif follows != "match":
                    run = 0
                    for (m, _), f in zip(ops[i + 1 :], kinds[i + 1 :], strict=True):
                        if f != follows:
                            break
                        run += m
                    kind[n - 1 :], length[n - 1 :] = (INSERTION, run) if follows == "ins" else (DELETION, -run)
                here = at[i][1] + np.arange(n)
                if left_end is not None:
                    near = np.where(here - left_end <= NEAR, here - left_end, near)
                beyond = here + np.abs(np.where(length == _NONE, 0, length)) + 1
                right = np.full(n, np.inf)
                for j in range(i + 1, len(ops)):
                    if n and at[j][1] > beyond[-1] + NEAR + 1:
                        break
                    if kinds[j] != "match":
                        last = at[j][1] + ops[j][0] - 1
                        right = np.where(last > beyond, np.minimum(right, np.maximum(at[j][1], beyond + 1) - beyond), right)
                near = np.minimum(near, np.where(right <= NEAR, right, np.inf))
                near = np.where(length == _NONE, np.nan, near)
            for part, x in zip(parts, (kind, length, offset, near), strict=True):
                part.append(x)
        if k != "match":
            left_end = at[i][1] + ops[i][0] - 1
    clipped = bool(ops) and (ops[0][1] == "S" or ops[-1][1] == "S")
    made = [np.concatenate([*p, np.zeros(0, t)]) for p, t in zip(parts, (np.int8, np.int32, np.int32, np.float64), strict=True)]
    return *made, clipped


def streams(reads: DataFrame, variants: DataFrame, by: tuple[str, ...] = (), tile: int = TILE, reads_per_part: int = READS_PER_PART) -> DataFrame:
    """Sites and reads of each tile side by side in one partition: the row of the sites first, then the reads by name."""
    sites = variants.select(*KEY).distinct().where("pos is not null").withColumn("tile", F.expr(f"(pos - 1) div {tile}"))
    sites = sites.groupBy("chrom", "tile").agg(F.sort_array(F.collect_list(F.struct("pos", "ref", "alt"))).alias("sites"))
    spans = with_end(reads).where("end0 > start0").select("chrom", F.xxhash64("qname").alias("name"), *[F.col(c).cast(t).alias(c) for c, t in _READ.items()], *by)
    spans = spans.withColumn("tile", F.explode(F.expr(f"sequence(start0 div {tile}, (end0 - 1) div {tile})")))
    spans = spans.join(sites.select("chrom", "tile"), ["chrom", "tile"], "left_semi")
    deep = spans.groupBy("chrom", "tile").count().where(F.col("count") > reads_per_part).select("chrom", "tile", F.ceil(F.col("count") / reads_per_part).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    sites = sites.join(deep, ["chrom", "tile"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    spans = spans.join(deep, ["chrom", "tile"], "left").withColumn("part", F.pmod("name", parts).cast("int")).drop("parts")
    both = sites.unionByName(spans, allowMissingColumns=True)
    n = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = F.col("sites").isNull()
    return both.repartition(n, "chrom", "tile", "part").sortWithinPartitions("chrom", "tile", "part", first, *by, "name").withColumn("read", first)


def allele_numbers(ref: pa.Array, alt: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of variants: the first letters, how much longer the alternative is, and whether it is one base."""
    initial = lambda x: np.array([ord(s[0]) if s else 0 for s in pc.utf8_slice_codeunits(x, 0, 1).fill_null("").to_pylist()], np.int64)
    width = lambda x: pc.utf8_length(x).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return initial(ref), initial(alt), width(alt) - width(ref), width(alt) == 1


class Pairs:
    """All read-site pairs of a batch as arrays: ``read`` and ``site`` index the batch's reads and its site table."""

    def __init__(self, reads: pa.RecordBatch, tables: list[tuple], first_read: np.ndarray):
        """``tables``: the (chrom, pos, ref, alt) arrays of the tiles in the batch; ``first_read``: where the reads of each begin."""
        column = lambda c: reads.column(reads.schema.get_field_index(c))
        number = lambda c, none: column(c).fill_null(none).to_numpy(zero_copy_only=False)
        self.n, self.first_read = reads.num_rows, first_read
        sizes = np.array([len(t[1]) for t in tables])
        site_at = np.concatenate([[0], np.cumsum(sizes)])
        pos = np.concatenate([t[1] for t in tables])
        self.site_n = int(site_at[-1])
        tile_of = np.repeat(np.arange(len(tables)), np.diff(np.append(first_read, self.n)))
        far = int(pos.max(initial=0)) + int(number("end0", 0).max(initial=0)) + 2
        line = pos + np.repeat(np.arange(len(tables)) * far, sizes)
        start, end = number("start0", 0), number("end0", 0)
        lo = np.searchsorted(line, tile_of * far + start, "right")
        n = np.maximum(np.searchsorted(line, tile_of * far + end, "right") - lo, 0)
        #: The sites of read i are ``lo[i]`` to ``lo[i] + n_sites[i]``, and its pairs begin at ``pair_at[i]``.
        self.lo, self.n_sites, self.pair_at = lo, n, np.cumsum(n) - n
        self.read = np.repeat(np.arange(self.n), n)
        self.site = np.repeat(lo - self.pair_at, n) + np.arange(int(n.sum()))
        coded = column("cigar").dictionary_encode()
        laid = [laid_out(c) for c in coded.dictionary.to_pylist()]
        kind, length, offset, near = (np.concatenate([*(x[k] for x in laid), np.zeros(0)]) for k in range(4))
        base = np.concatenate([[0], np.cumsum([len(x[0]) for x in laid])])[:-1] if laid else np.zeros(1, np.int64)
        code = coded.indices.fill_null(0).to_numpy(zero_copy_only=False)
        at = (base[code][self.read] + pos[self.site] - 1 - start[self.read]).astype(np.int64)
        self.kind, self.length, self.offset, self.near = kind[at], length[at], offset[at].astype(np.int64), near[at]
        self.clipped = np.array([x[4] for x in laid] or [False])[code][self.read]
        self.seq_n = pc.binary_length(column("seq")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        letter, has_letter = self._letters(column("seq"))
        quality, self.has_bq = self._letters(column("quals"))
        self.bq = quality.astype(np.int64) - 33
        self.mapq, self.flag, self.nm = (number(c, 0).astype(np.int64)[self.read] for c in ("mapq", "flag", "nm"))
        self.has_mapq, self.has_nm = (column(c).is_valid().to_numpy(zero_copy_only=False)[self.read] for c in ("mapq", "nm"))
        ref0, alt0, size, single = (np.concatenate([(t[5] if len(t) > 5 else allele_numbers(t[2], t[3]))[k] for t in tables]) for k in range(4))
        size, single = size[self.site], single[self.site]
        match = self.kind == MATCH
        is_ref = match & has_letter & (letter == ref0[self.site])
        is_alt = (size == 0) & match & single & has_letter & (letter == alt0[self.site])
        is_alt |= (size < 0) & (self.kind == DELETION) & (self.length == size)
        is_alt |= (size > 0) & (self.kind == INSERTION)
        self.cls = np.where(is_ref, 0, np.where(is_alt, 1, 2))

    def _letters(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The byte of each pair's read at its offset, and whether there is one."""
        texts = texts.cast(pa.large_string()).fill_null("")
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
        place = at[:-1][self.read] + self.offset if len(texts) else self.offset
        has = (self.offset >= 0) & (place < at[1:][self.read]) if len(texts) else self.offset >= 0
        return data[np.where(has, np.minimum(place, len(data) - 1), 0)], has

    def sums(self, flags: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """By site, how many pairs have the flag, or the sum of their weights."""
        chosen = self.site[flags]
        return np.bincount(chosen, None if weights is None else weights[flags], self.site_n).astype(np.int64)

    def histogram(self, values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets by site, and the columns value, alternative reads, reference reads of the distinct values there."""
        use = known & (self.cls < 2)
        low = int(values[use].min(initial=0))
        wide = int(values[use].max(initial=0)) - low + 1
        key = self.site[use] * wide + values[use] - low
        if self.site_n * wide <= DENSE * len(key):
            total = np.bincount(key, minlength=self.site_n * wide)
            alternative = np.bincount(key[self.cls[use] == 1], minlength=self.site_n * wide)
            key = np.flatnonzero(total)
            total, alternative = total[key], alternative[key]
        else:
            key, at = np.unique(key, return_inverse=True)
            alternative = np.bincount(at, self.cls[use] == 1, len(key)).astype(np.int64)
            total = np.bincount(at, minlength=len(key))
        return np.searchsorted(key, np.arange(self.site_n + 1) * wide), np.stack([key % wide + low, alternative, total - alternative])


def merged(parts: list[tuple[np.ndarray, list[pa.Array]]]) -> tuple[np.ndarray, list[pa.Array]]:
    """Partial results of the same sites as one: numbers are added up, and so are the entries of lists that have the same first field."""
    if len(parts) == 1:
        return parts[0]
    every = np.concatenate([p[0] for p in parts])
    sites, of = np.unique(every, return_inverse=True)
    order = np.argsort(of, kind="stable")
    begins = np.searchsorted(of[order], np.arange(len(sites)))
    out = []
    for column in zip(*(p[1] for p in parts), strict=True):
        whole = pa.concat_arrays(column)
        if not pa.types.is_list(whole.type):
            out.append(pa.array(np.add.reduceat(whole.to_numpy()[order], begins)))
            continue
        owner = np.repeat(of, pc.list_value_length(whole).to_numpy())
        entries = whole.flatten()
        first, *rest = (x.to_numpy() for x in entries.flatten())
        low, high = int(first.min(initial=0)), int(first.max(initial=0))
        cells = len(sites) * (high - low + 1)
        if cells <= DENSE * len(first):
            key = owner * (high - low + 1) + first - low
            kept = np.flatnonzero(np.bincount(key, minlength=cells))
            sums = [np.bincount(key, x, cells)[kept].astype(np.int64) for x in rest]
            owner, first = kept // (high - low + 1), kept % (high - low + 1) + low
        else:
            by = np.lexsort((first, owner))
            owner, first = owner[by], first[by]
            new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (first[1:] != first[:-1])])[: len(by)])
            sums = [np.add.reduceat(x[by], new) if len(new) else x for x in rest]
            owner, first = owner[new], first[new]
        names = [entries.type.field(i).name for i in range(entries.type.num_fields)]
        lists = np.searchsorted(owner, np.arange(len(sites) + 1)).astype(np.int32)
        out.append(pa.ListArray.from_arrays(pa.array(lists), pa.StructArray.from_arrays([pa.array(first), *map(pa.array, sums)], names)))
    return sites, out


def _pieces(batch: pa.RecordBatch, found: list[tuple]) -> list[list[tuple]]:
    """The reads of tiles (table, from, to) in groups of about ``PAIRS_AT_ONCE`` read-site pairs: small tiles together, large ones cut."""
    number = lambda c: batch.column(c).fill_null(0).to_numpy(zero_copy_only=False)
    start, end = number("start0"), number("end0")
    groups, held, size = [], [], 0
    for table, a, b in found:
        ends = np.cumsum(np.searchsorted(table[1], end[a:b], "right") - np.searchsorted(table[1], start[a:b], "right"))
        n = int(ends[-1]) if len(ends) else 0
        if n > PAIRS_AT_ONCE:
            cuts = [0, *(np.searchsorted(ends, np.arange(PAIRS_AT_ONCE, n, PAIRS_AT_ONCE)) + 1).tolist(), b - a]
            groups += [[(table, a + x, a + y)] for x, y in zip(cuts, cuts[1:], strict=False) if x < y]
            continue
        if held and size + n > PAIRS_AT_ONCE:
            groups, held, size = [*groups, held], [], 0
        held, size = [*held, (table, a, b)], size + n
    return [*groups, held] if held else groups


def by_site(stream: DataFrame, reduce: Callable[[Pairs, np.ndarray], tuple[np.ndarray, list[pa.Array]]], columns: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Partial rows (variant, ``by``, ``columns``) that ``reduce`` makes of pieces of batches; it gives the sites and the arrays.

    What the pieces of one tile give is merged before it leaves the task, so it grows with the parts of a tile and not with its batches.
    """
    kinds = dict(stream.dtypes)
    names = [c.split()[0] for c in columns.split(", ")]
    keys = ", ".join([*(f"{k} {kinds['chrom'] if k == 'chrom' else dict((f.name, f.dataType.simpleString()) for f in stream.schema['sites'].dataType.elementType.fields)[k]}" for k in KEY), *(f"{c} {kinds[c]}" for c in by)])

    def shown(tables: list[tuple], value: tuple, schema: pa.Schema, sites: np.ndarray, made: list[pa.Array]) -> pa.RecordBatch:
        chrom = pa.array(np.repeat([t[0] for t in tables], [len(t[1]) for t in tables])[sites].tolist(), pa.string())
        take = pa.array(sites)
        pos = pa.array(np.concatenate([t[1] for t in tables])[sites], pa.int64()).cast(tables[0][4])
        ref, alt = (pa.concat_arrays([t[k] for t in tables]).take(take) for k in (2, 3))
        own = [pa.array([v] * len(sites), schema.field(c).type) for c, v in zip(by, value, strict=True)]
        return pa.RecordBatch.from_arrays([chrom, pos, ref, alt, *own, *made], [*KEY, *by, *names])

    def run(batches: Iterable[pa.RecordBatch]):
        table, held, schema = None, {}, None
        for batch in batches:
            schema = batch.schema
            is_read = batch.column("read").to_numpy(zero_copy_only=False)
            starts = [0, *np.flatnonzero(~is_read).tolist()]
            groups: dict = {}
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                if a < b and not is_read[a]:
                    own = batch.column("sites")[a].values
                    pos, ref, alt = (own.field(k) for k in ("pos", "ref", "alt"))
                    table, a = (batch.column("chrom")[a].as_py(), pos.to_numpy(zero_copy_only=False).astype(np.int64), ref, alt, pos.type, allele_numbers(ref, alt)), a + 1
                if a < b and table is not None:
                    edges = [a]
                    if by:
                        values = [batch.column(c).slice(a, b - a).to_pylist() for c in by]
                        said = list(zip(*values, strict=True))
                        edges += [a + i for i in range(1, len(said)) if said[i] != said[i - 1]]
                    for x, y in zip(edges, [*edges[1:], b], strict=True):
                        groups.setdefault(tuple(batch.column(c)[x].as_py() for c in by), []).append((table, x, y))
            for value, found in groups.items():
                for piece in _pieces(batch, found):
                    rows = pa.Table.from_batches([batch.slice(x, y - x) for _, x, y in piece]).combine_chunks().to_batches()[0]
                    first = np.concatenate([[0], np.cumsum([y - x for _, x, y in piece])])[:-1]
                    tables = [t for t, _, _ in piece]
                    pairs = Pairs(rows, tables, first)
                    if not len(pairs.read):
                        continue
                    made = reduce(pairs, rows)
                    del pairs
                    if len(tables) > 1:
                        yield shown(tables, value, schema, *made)
                        continue
                    parts = held.setdefault((id(tables[0]), value), (tables[0], []))[1]
                    parts.append(made)
                    if len(parts) >= HELD:
                        parts[:] = [merged(parts)]
            for key in [k for k, (t, _) in held.items() if t is not table]:
                whole, parts = held.pop(key)
                yield shown([whole], key[1], schema, *merged(parts))
        for key, (whole, parts) in held.items():
            yield shown([whole], key[1], schema, *merged(parts))

    return stream.mapInArrow(run, f"{keys}, {columns}")


def counts(pairs: Pairs, rows: pa.RecordBatch) -> tuple[np.ndarray, list[pa.Array]]:
    """Variant, reference, other and all reads of each site."""
    all_ = np.ones(len(pairs.read), bool)
    depth = pairs.sums(all_)
    sites = np.flatnonzero(depth)
    return sites, [pa.array(x[sites]) for x in (*(pairs.sums(pairs.cls == k) for k in (1, 0, 2)), depth)]
