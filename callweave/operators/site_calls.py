"""What each read says at a site, from its CIGAR alone."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.operators.reads import BROADCAST_SITES, at_sites
from callweave.operators.site_tiles import laid_out
from callweave.storage import settle

#: Operations of all different CIGARs, and bases that they span, that are sent to all tasks at most.
BROADCAST_BASES = 2_000_000
_CALLS = "struct<kind:array<tinyint>,length:array<int>,offset:array<int>,near:array<double>>"


def _calls(cigars: pa.Array) -> pa.Array:
    """By reference base under the read: kind, indel length, offset in the read and distance to another indel."""
    coded = cigars.dictionary_encode()
    laid = [laid_out(c) for c in coded.dictionary.to_pylist()]
    none = np.iinfo(np.int32).min
    code = coded.indices.fill_null(0).to_numpy(zero_copy_only=False) if laid else np.zeros(0, np.int64)
    valid = cigars.is_valid().to_numpy(zero_copy_only=False)
    chosen = [laid[c] if v else None for c, v in zip(code, valid, strict=True)] if laid else [None] * len(cigars)
    ends = np.cumsum([0, *(len(x[0]) if x else 0 for x in chosen)]).astype(np.int32)
    kind, length, offset, near = (np.concatenate([np.zeros(0, t), *(x[k] for x in chosen if x)]) for k, t in enumerate((np.int8, np.int32, np.int32, np.float64)))
    values = pa.array(kind), pa.array(length, mask=length == none), pa.array(offset, mask=offset < 0), pa.array(near, mask=np.isnan(near))
    lists = [pa.ListArray.from_arrays(pa.array(ends), v) for v in values]
    return pa.StructArray.from_arrays(lists, ["kind", "length", "offset", "near"], mask=pa.array(~valid))


def with_calls(reads: DataFrame, broadcast_bases: int = BROADCAST_BASES) -> DataFrame:
    """Reads with a CIGAR, with end0 and ``__calls``: what the CIGAR says at each reference base from start0 on.

    CIGARs are laid out once each and sent to the reads; where that is too much, each batch of reads lays out its own.
    """
    laid = F.arrow_udf(_calls, _CALLS)
    distinct = settle(reads.where("cigar is not null").select("cigar").distinct())
    bases = distinct.agg(F.sum(F.length("cigar") + F.aggregate(F.regexp_extract_all("cigar", F.lit("([0-9]+)[MDN=X]"), F.lit(1)), F.lit(0).cast("long"), lambda a, n: a + n.cast("long")))).first()[0] or 0
    if bases <= broadcast_bases:
        told = reads.join(F.broadcast(settle(distinct.withColumn("__calls", laid("cigar")))), "cigar").select(*reads.columns, "__calls")
    else:
        told = reads.where("cigar is not null").withColumn("__calls", laid("cigar"))
    return told.withColumn("end0", F.expr("start0 + size(__calls.kind)")).where("end0 > start0")


def site_calls(reads: DataFrame, sites: DataFrame, broadcast_bases: int = BROADCAST_BASES, broadcast_rows: int = BROADCAST_SITES) -> DataFrame:
    """Reads at the sites that they span, with kind, indel_length, read_offset and nearest.

    kind: match, insertion, deletion, or unknown inside a deletion.  Clips count as insertions.  nearest is the distance
    to another indel or clip if it is at most NEAR, else infinity.  The last aligned base has a null length and distance.
    """
    met = at_sites(with_calls(reads, broadcast_bases), sites, broadcast_rows).withColumn("__at", F.expr("cast(pos - 1 - start0 as int)"))
    at = lambda c: F.expr(f"get(__calls.{c}, __at)")
    kind = F.expr("element_at(array('match', 'insertion', 'deletion', 'unknown'), get(__calls.kind, __at) + 1)")
    made = {"kind": kind, "indel_length": at("length").cast("long"), "read_offset": at("offset").cast("long"), "nearest": at("near")}
    return met.withColumns(made).drop("__calls", "__at")
