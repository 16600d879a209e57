"""Queries that write tables as text files in a scratch folder and read them back, and data-quality counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.operators import ensemble as E
from callweave.operators import reads as R
from callweave.operators import reference as W
from callweave.operators import summaries as M
from callweave.operators.pileup import indel_totals
from callweave.plans.register import query
from callweave.plans.views import as_records
from callweave.sources import text as S
from callweave.storage import scratch


def _contigs(rows: DataFrame) -> DataFrame:
    """The contigs of rows as an index, chr5 first."""
    return rows.select("chrom").distinct().select("chrom", F.lit(1000).cast("long").alias("size"), (10 - F.substr("chrom", F.lit(4), F.lit(1)).cast("long")).alias("offset"))


@query("""select chrom, pos, nullif(id, '.') as id, ref, alt, cast(case when pos % 3 = 0 then pos / 4.0 end as double) as qual, filter, nullif(info, '.') as info, fmt, s0 || ' ' || s1 as samples from (select distinct * from vcf_v)""")
def vcf_round_trip(v):
    rows = as_records(v("vcf_v")).drop("caller").withColumn("qual", F.when(F.col("pos") % 3 == 0, F.col("pos") / 4.0))
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "records")
    header = S.vcf_header({"FORMAT:GT": ("FORMAT", "1", "String", "Genotype")}, {"PASS": "Accepted"}, ["NORMAL", "TUMOR"])
    keyed = rows.withColumn("info", F.concat_ws(";", F.nullif("info", F.lit(".")), F.concat(F.lit("ROW="), F.monotonically_increasing_id())))
    S.write_vcf(keyed, path, _contigs(rows), header)
    back = S.scan_vcf(spark, path)
    info = F.nullif(F.regexp_replace("info", ";?ROW=[0-9]+$", ""), F.lit(""))
    return back.select("chrom", "pos", "id", "ref", "alt", "qual", "filter", info.alias("info"), F.array_join("format", ":").alias("fmt"), F.array_join("samples", " ").alias("samples"))


@query("select * from (values ('CHROM', null, '#CHROM' || chr(9) || 'POS'), ('FILTER', 'PASS', '##FILTER=<ID='), ('INFO', 'DP', '##INFO=<ID=DP'), ('INFO', 'LC', '##INFO=<ID=LC'), ('fileformat', null, '##fileformat=')) t(kind, id, start) where (select count(*) from truth_v) > 0")
def vcf_headers(v):
    rows = v("truth_v")
    path = scratch(rows.sparkSession, "header")
    old = ["##INFO=<ID=OLD,Number=1,Type=Float,Description=\"Goes\">", "##INFO=<ID=DP,Number=1,Type=Integer,Description=\"Stays\">"]
    S.write_vcf(rows, path, header=S.vcf_header({"INFO:LC": ("INFO", "1", "Float", "Complexity")}, {"PASS": "Accepted"}, [], old, ("OLD",)))
    return S.scan_vcf_header(rows.sparkSession, path).select("kind", "id", F.left("line", F.lit(13)).alias("line")).select("kind", "id", F.when(F.col("kind") == "CHROM", F.left("line", F.lit(10))).otherwise(F.col("line")).alias("start"))


@query("select chrom, start0, end0, label from regions_v")
def bed_round_trip(v):
    rows = v("regions_v")
    path = scratch(rows.sparkSession, "regions")
    S.write_bed(rows.select("chrom", "start0", "end0", "label"), path)
    return S.scan_bed(rows.sparkSession, path)


@query("select chrom, pos from truth_v")
def positions_round_trip(v):
    rows = v("truth_v").select("chrom", "pos")
    path = scratch(rows.sparkSession, "positions")
    rows.write.csv(path, sep="\t")
    return S.scan_positions(rows.sparkSession, path)


@query("select chrom, pos, ref, cast(case when site % 9 = 0 then 0 else 5 end as int) as depth, case when site % 9 = 0 then null else bases end as bases, site % 9 = 0 as bare from pileup_v")
def pileup_round_trip(v):
    rows = v("pileup_v")
    path = scratch(rows.sparkSession, "pileup")
    bare = F.col("site") % 9 == 0
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "ref", F.when(bare, "0").otherwise("5"), F.when(~bare, F.col("bases")), F.when(~bare, F.lit("IIIII")))
    rows.select(line.alias("value")).write.text(path)
    return S.scan_pileup(rows.sparkSession, path).select("chrom", "pos", "ref", "depth", "bases", F.col("quals").isNull().alias("bare"))


@query("select site, n_insertions, n_deletions, round(coalesce((n_insertions + n_deletions) / nullif(depth, 0), 0), 9) as indel_fraction from (select o_orderkey as site, case when o_custkey % 3 = 0 then 1 else 0 end as n_insertions, case when o_orderkey % 4 = 0 then 1 else 0 end as n_deletions, o_custkey % 5 as depth from orders)")
def pileup_indels(v):
    depth = F.substr("chrom", F.lit(4), F.lit(1)).cast("long") - 1
    return indel_totals(v("pileup_v").withColumn("depth", depth)).select("site", "n_insertions", "n_deletions", F.round("indel_fraction", 9).alias("indel_fraction"))


@query("select chrom, pos, ref, alt, label, score, tBAM_REF_MQ from (select chrom, pos, ref, alt, 1 as label, case when pos % 4 = 0 then null else cast(pos as double) end as score, cast(pos as double) * 2 as tBAM_REF_MQ from truth_v union all select chrom, pos, ref, alt, 0, null, null from truth_v)")
def features_round_trip(v):
    rows = v("truth_v").select(F.col("chrom").alias("CHROM"), F.col("pos").alias("POS"), F.col("ref").alias("REF"), F.col("alt").alias("ALT"))
    one, two = scratch(rows.sparkSession, "features"), scratch(rows.sparkSession, "features")
    pos = F.col("POS").cast("double")
    S.write_features(rows.withColumns({"label": F.lit(1.0), "score": F.when(F.col("POS") % 4 != 0, pos), "tBAM_REF_MQ": pos * 2}).coalesce(1), one)
    S.write_features(rows.withColumn("label", F.lit(0.0)).coalesce(1), two)
    back = S.scan_features(rows.sparkSession, [one, two])
    return back.select(F.col("CHROM").alias("chrom"), F.col("POS").alias("pos"), F.col("REF").alias("ref"), F.col("ALT").alias("alt"), F.col("label").cast("int").alias("label"), "score", "tBAM_REF_MQ")


@query("select read_id, qname, flag, chrom, start0, mapq, cigar, tlen, nm, seq, quals from reads_v")
def sam_round_trip(v):
    rows = v("reads_v")
    path = scratch(rows.sparkSession, "reads")
    tags = F.concat_ws("\t", F.when(F.col("nm").isNotNull(), F.concat(F.lit("NM:i:"), "nm")), F.concat(F.lit("XI:i:"), "read_id"))
    cells = ["qname", "flag", "chrom", F.col("start0") + 1, "mapq", "cigar", F.lit("="), F.lit(1), "tlen", "seq", "quals"]
    rows.select(F.concat_ws("\t", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cells], tags).alias("value")).write.text(path)
    back = S.scan_sam(rows.sparkSession, path)
    return back.select(F.col("tags")["XI"].cast("long").alias("read_id"), "qname", "flag", "chrom", "start0", "mapq", "cigar", "tlen", "nm", "seq", "quals")


@query("select distinct sample from reads_v")
def sample_names(v):
    rows = v("reads_v").select("sample").distinct()
    path = scratch(rows.sparkSession, "groups")
    rows.select(F.explode(F.array(F.concat(F.lit("@RG\tID:1\tSM:"), "sample", F.lit("\tPL:x")), F.concat(F.lit("@RG\tID:2\tSM:"), "sample"), F.lit("@HD\tVN:1"))).alias("value")).write.text(path)
    return S.sample_names(rows.sparkSession, path)


@query("select chrom, 10 - cast(substr(chrom, 4, 1) as int) as rank, cast(size as bigint) as size from (select chrom, max(end0) as size from regions_v group by chrom)")
def contig_index(v):
    sizes = v("regions_v").groupBy("chrom").agg(F.max("end0").alias("size")).withColumn("offset", 10 - F.substr("chrom", F.lit(4), F.lit(1)).cast("int"))
    path = scratch(sizes.sparkSession, "index")
    sizes.select(F.concat_ws("\t", F.concat("chrom", F.lit(" a description")), F.col("size").cast("string"), F.col("offset").cast("string"), F.lit("60"), F.lit("61")).alias("value")).write.text(path)
    return S.scan_contigs(sizes.sparkSession, path).select("chrom", F.col("offset").cast("int").alias("rank"), "size")


@query("select 'd' || cast(doc_id as varchar) as chrom, tile, tile * 4096 as start0, substr(seq0, cast(tile * 4096 + 1 as int), 4352) as seq from (select *, unnest(range(0, (length(seq0) - 1) // 4096 + 1)) as tile from sequences_v where length(seq0) > 0)")
def fasta_tiles(v):
    rows = v("sequences_v").where("length(seq0) > 0")
    path = scratch(rows.sparkSession, "sequences")
    lines = F.regexp_replace("seq0", "(.{1,60})", "$1\n")
    rows.select(F.concat(F.lit(">d"), F.col("doc_id").cast("string"), F.lit(" of a document\n"), lines).alias("value")).write.text(path)
    return S.scan_fasta(rows.sparkSession, path)


@query("select qname, count(*) as n from (select a.qname from reads_v a join reads_v b on a.qname = b.qname where (a.flag & 64) <> 0 and (b.flag & 128) <> 0 and (a.flag & 256) = 0 and (b.flag & 256) = 0) group by qname")
def fastq_round_trip(v):
    pairs = R.reads_to_fastq(v("reads_v"))
    one, two = scratch(pairs.sparkSession, "fastq"), scratch(pairs.sparkSession, "fastq")
    S.write_fastq(pairs, one, two)
    spark = pairs.sparkSession
    names = [spark.read.text(p).where(F.col("value").rlike("^@q[0-9]+/[12]$")).select(F.regexp_extract("value", "^@(q[0-9]+)/", 1).alias("qname")) for p in (one, two)]
    return names[0].join(names[1].distinct(), "qname").groupBy("qname").agg(F.count("*").alias("n"))


@query("select read_id, cast(((row_number() over (partition by sample order by read_id) - 1) // 4) % 3 as int) as shard from reads_v")
def spread(v):
    return S.spread(S.numbered(v("reads_v").select("read_id", "sample"), "read_id", "sample"), 3).select("read_id", "shard")


@query("select distinct chrom, pos, ref, alt from (select chrom, pos, ref, alt from truth_v union all select chrom, pos, ref, alt from calls_v)")
def concat_unique(v):
    return S.unique_rows(S.concat_tables([v("truth_v"), v("calls_v").select(*E.KEY)]))


@query("""with k as (select read_id, chrom, start0, 10 - cast(substr(chrom, 4, 1) as int) as r, lag(10 - cast(substr(chrom, 4, 1) as int)) over (order by read_id) as pr, lag(start0) over (order by read_id) as pp from reads_v)
 select count(*) filter (where r < pr or (r = pr and start0 < pp)) as unsorted, 0 as unknown_contigs from k""")
def unsorted_records(v):
    rows = v("reads_v").select("chrom", F.col("start0").alias("pos"), F.col("read_id").alias("line"))
    return M.unsorted_records(rows, _contigs(rows))


@query("select chrom, pos, ref, alt, row_number() over (order by 10 - cast(substr(chrom, 4, 1) as int), pos, ref, alt) as place from truth_v")
def contig_order(v):
    rows = v("truth_v").select(*E.KEY)
    path = scratch(rows.sparkSession, "ordered")
    S.write_vcf(rows, path, _contigs(rows), ["##fileformat=VCFv4.1"])
    return S.record_places(rows.sparkSession, path).select(*E.KEY, F.col("line").alias("place"))


@query("""with n as (select chrom, count(*) as n from (select distinct chrom, pos, ref, alt from calls_v) group by chrom)
 select chrom, n, cast(sum(n) over (order by 10 - cast(substr(chrom, 4, 1) as int)) - n as bigint) as first_line, cast(sum(n) over (order by 10 - cast(substr(chrom, 4, 1) as int)) - 1 as bigint) as last_line, cast(0 as bigint) as unsorted from n""")
def written_order(v):
    rows = v("calls_v").select(*E.KEY)
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "ordered")
    S.write_vcf(rows, path, _contigs(rows))
    lines = S.record_places(spark, path).groupBy("chrom").agg(F.count("*").alias("n"), F.min("line").alias("first_line"), F.max("line").alias("last_line"))
    return lines.crossJoin(S.written_disorder(spark, path, _contigs(rows)).select("unsorted"))


def _document_sites(v) -> tuple[DataFrame, DataFrame]:
    """A site every 211 bases of the documents' sequences, with the documents as contigs."""
    rows = v("sequences_v").select(F.col("doc_id").cast("string").alias("chrom"), F.col("seq0").alias("sequence"))
    sites = rows.where("length(sequence) > 0").select("chrom", F.explode(F.expr("sequence(1L, cast(length(sequence) as bigint), 211L)")).alias("pos"))
    return sites, W.tiles(rows)


SITES = "sites as (select doc_id, seq0, unnest(range(1, length(seq0) + 1, 211)) as pos from sequences_v where length(seq0) > 0)"


@query(f"with {SITES} select cast(doc_id as varchar) as chrom, pos, greatest(pos - 41, 0) as window_start0, substr(seq0, cast(greatest(pos - 41, 0) + 1 as int), cast(pos + 40 - greatest(pos - 41, 0) as int)) as window from sites")
def reference_windows(v):
    sites, reference = _document_sites(v)
    return W.with_window(sites, reference, 41, 40)


RUNS = "list_max(list_transform(regexp_extract_all({}, 'A+|C+|G+|T+'), lambda x: length(x)))"


def _touch(seq: str, base: str) -> str:
    return f"length(regexp_extract({seq}, '^{base}*'))"


PART = "substr(seq0, cast(greatest({a}, 0) + 1 as int), cast(greatest(least({b}, length(seq0)) - greatest({a}, 0), 0) as int))"

@query(f"""with {SITES}, w as (select doc_id, pos, {PART.format(a='pos - 20', b='pos')} as l, {PART.format(a='pos + 1', b='pos + 21')} as r from sites)
 select cast(doc_id as varchar) as chrom, pos, greatest({RUNS.format("l || 'A' || r")}, {RUNS.format("l || 'CG' || r")}) as max_homopolymer, 1 + {_touch('r', 'A')} + {_touch('reverse(l)', 'A')} as site_homopolymer from w""")
def homopolymers(v):
    sites, reference = _document_sites(v)
    made = W.sequence_features(sites.withColumns({"ref": F.lit("A"), "alt": F.lit("CG")}), reference)
    return made.select("chrom", "pos", F.col("max_homopolymer").cast("long").alias("max_homopolymer"), F.col("site_homopolymer").cast("long").alias("site_homopolymer"))


WINDOWS = {"span": ("pos - 41", "pos + 40"), "leftw": ("pos - 81", "pos"), "rightw": ("pos", "pos + 81")}


@query(f"""with {SITES}, w as (select doc_id, pos, which, s from (select doc_id, pos, {', '.join(f"{PART.format(a=a, b=b)} as {n}" for n, (a, b) in WINDOWS.items())} from sites) unpivot (s for which in (span, leftw, rightw))),
 k as (select doc_id, pos, which, s, z, unnest(range(1, length(s) - z + 2)) as i from (select *, unnest(range(1, 21)) as z from w where length(s) > 20)),
 c as (select doc_id, pos, which, count(distinct substr(s, cast(i as int), cast(z as int))) / any_value(list_sum(list_transform(range(1, 21), lambda x: least(pow(4, x), length(s) - x + 1)))) as lc from k group by doc_id, pos, which),
 p as (select doc_id, pos, max(lc) filter (where which = 'span') as a, max(lc) filter (where which = 'leftw') as b, max(lc) filter (where which = 'rightw') as d from c group by doc_id, pos),
 q as (select s.doc_id, s.pos, a, case when b is not null then least(b, d) end as e from sites s left join p on p.doc_id = s.doc_id and p.pos = s.pos)
 select cast(doc_id as varchar) as chrom, pos, round(case when a = 1 then 40.0 when a < 1 then least(-10 * log10(1 - a), 40.0) end, 6) as complexity_span, round(case when e = 1 then 40.0 when e < 1 then least(-10 * log10(1 - e), 40.0) end, 6) as complexity_adjacent from q""")
def sequence_complexity(v):
    sites, reference = _document_sites(v)
    made = W.sequence_features(sites.withColumns({"ref": F.lit("A"), "alt": F.lit("CG")}), reference)
    return made.select("chrom", "pos", F.round("complexity_span", 6).alias("complexity_span"), F.round("complexity_adjacent", 6).alias("complexity_adjacent"))
