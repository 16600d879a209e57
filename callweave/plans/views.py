"""Call sets, caller records, regions, reads, pileups and truth as views of the test tables, in SQL that Spark and DuckDB both run.

``EACH(n, o -> x)`` in a view stands for the characters x of o = 0 .. n - 1 in a row.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = "substr('ACGT', cast((({pos})*7919 + ({c})*104729) % 10007 as int) % 4 + 1, 1)"
OTHER = "substr('ACGT', (cast((({pos})*7919 + ({c})*104729) % 10007 as int) % 4 + 1 + cast(k as int)) % 4 + 1, 1)"
#: Bases from pos on, as many as asked for.
RUN = lambda n: " || ".join(BASE.format(pos=f"pos + {i}", c="c") for i in range(n))

VIEWS = {
    "regions_v": """
        select o_orderstatus as label, concat('chr', cast(o_custkey % 5 + 1 as string)) as chrom,
               o_orderkey*61 as start0, o_orderkey*61 + 50 + o_custkey % 400 as end0
        from orders""",
    "calls_v": f"""
        select caller, concat('chr', cast(c as string)) as chrom, pos, {BASE.format(pos='pos', c='c')} as ref,
               {OTHER.format(pos='pos', c='c')} as alt,
               case min(rf) when 'A' then 'PASS' when 'N' then 'LowQual' else 'REJECT' end as filter
        from (select concat('c', cast(l_linenumber as string)) as caller, l_partkey % 5 + 1 as c,
                     1 + (l_partkey*91) % 20000 as pos, l_suppkey % 3 as k, l_returnflag as rf from lineitem) r
        group by caller, c, pos, k""",
    "truth_v": f"""
        select distinct concat('chr', cast(c as string)) as chrom, pos, {BASE.format(pos='pos', c='c')} as ref,
               substr('ACGT', (cast((pos*7919 + c*104729) % 10007 as int) % 4 + 1) % 4 + 1, 1) as alt
        from (select p_partkey % 5 + 1 as c, 1 + (p_partkey*91) % 20000 as pos from part where p_size % 3 = 0) p""",
    # records of seven callers at the places of calls_v, with SNVs, several alternatives, indels and complex variants
    "vcf_v": f"""
        select caller, concat('chr', cast(c as string)) as chrom, pos, case when x % 4 = 0 then concat('rs', cast(pos as string), ';COSM', cast(x as string)) else '.' end as id,
               case when (pos + k) % 6 >= 4 then {RUN(3)} else {RUN(1)} end as ref,
               case (pos + k) % 6 when 2 then {OTHER.format(pos='pos', c='c')} || ',' || substr('ACGT', (cast((pos*7919 + c*104729) % 10007 as int) % 4 + 2 + cast(k as int)) % 4 + 1, 1)
                    when 3 then {RUN(1)} || 'GT' when 4 then {RUN(1)} when 5 then {OTHER.format(pos='pos', c='c')} || 'T' else {OTHER.format(pos='pos', c='c')} end as alt,
               case caller when 'MuSE' then case x % 4 when 0 then 'PASS' when 1 then 'Tier2' when 2 then 'Tier4' else 'Tier7' end
                    when 'VarDict' then case x % 7 when 0 then 'PASS' when 1 then 'P0.05' when 2 then 'v3;q22.5' when 3 then 'NM4.25' when 4 then 'd7;v4' when 5 then 'p8;q22.5;x' else 'v4' end
                    else case x % 5 when 0 then 'PASS' when 1 then 'LowQual' when 2 then 'REJECT' when 3 then 'germline_risk' else 'clustered;PASS' end end as filter,
               case caller when 'MuTect2' then concat(case when x % 3 = 0 then 'SOMATIC;' else '' end, 'NLOD=', cast(pos % 50 as string), '.5,', cast(x as string), '.25;TLOD=', cast(pos % 31 as string), '.5,1.5;',
                         case when x % 2 = 0 then 'STR;' else '' end, case when x % 4 = 1 then 'ECNT=many' else concat('ECNT=', cast(x as string)) end)
                    when 'VarScan2' then case when x % 2 = 0 then 'SOMATIC;SS=2' else 'SS=1;XSOMATIC' end
                    when 'VarDict' then concat('STATUS=', case when x % 3 = 2 then 'Germline' else 'StrongSomatic' end, ';SSF=0.', cast(x % 10 as string), '5;MSI=', cast(x as string), '.5;MSILEN=1;SHIFT3=', cast(pos % 9 as string))
                    when 'Strelka' then concat('SOMATIC;QSS=', cast(x as string), ';TQSS=', cast(x % 3 as string), case when x % 2 = 0 then concat(';SomaticEVS=', cast(pos % 20 as string), '.5') else '' end)
                    else '.' end as info,
               case caller when 'SomaticSniper' then 'GT:SS:SSC' when 'VarDict' then 'GT:DP:VD' else 'GT:DP' end as fmt,
               case caller when 'SomaticSniper' then '0/0:1:.' when 'VarDict' then concat('0/1:30:', cast(pos % 6 as string)) else '0/0:20' end as s0,
               case caller when 'SomaticSniper' then concat('0/1:', cast(x % 3 as string), ':', cast(pos % 97 as string)) when 'VarDict' then '0/0:25:0' else '0/1:30' end as s1
        from (select c, pos, k, n, (pos*7 + k*3 + n*5) % 11 as x, case n when 1 then 'MuTect2' when 2 then 'VarScan2' when 3 then 'SomaticSniper' when 4 then 'VarDict' when 5 then 'MuSE' when 6 then 'Strelka' else 'Caller_1' end as caller
              from (select distinct l_partkey % 5 + 1 as c, 1 + (l_partkey*91) % 20000 as pos, l_suppkey % 3 as k, l_linenumber as n from lineitem) a) b""",
    # known variants: some of the places and alternatives of vcf_v, with identifiers and annotations
    "known_v": f"""
        select distinct concat('chr', cast(c as string)) as chrom, pos, concat('rs', cast(pos as string), case when pos % 4 = 0 then ',rs7' else '' end) as id, {RUN(1)} as ref, {OTHER.format(pos='pos', c='c')} as alt,
               concat('CNT=', cast(pos % 12 as string), case when pos % 3 = 0 then ';COMMON=1' else ';COMMON=0' end, case when pos % 5 = 0 then ';SNP' else '' end, ';GENE=g', cast(pos % 7 as string), ';VC=SNV') as info
        from (select p_partkey % 5 + 1 as c, 1 + (p_partkey*91) % 20000 as pos, p_size % 3 as k from part where p_size % 2 = 0) p
        where (pos + k) % 6 in (0, 1)""",
    # raw records, one for each lineitem, with what callers do to alleles, formats and info fields
    "raw_v": """
        select rid, concat('chr', cast(rid % 5 + 1 as string)) as chrom, rid % 20000 + 1 as pos, '.' as id,
               case rid % 7 when 0 then 'G' when 1 then 'AC' when 2 then 'ATG' when 3 then 'C' when 4 then 'TM' when 5 then 'N' else 'GA/T' end as ref,
               case rid % 9 when 0 then 'T' when 1 then 'A,C' when 2 then 'ACG' when 3 then 'A/T' when 4 then 'GT,GA' when 5 then 'C' when 6 then '<DEL>' when 7 then 'TTT' else 'C,C' end as alt,
               case rid % 5 when 0 then 'PASS' when 1 then 'germline_risk' when 2 then 'LowQual' when 3 then 'REJECT' else 'germline_risk;x' end as filter,
               concat('NLOD=', cast(rid % 13 as string), ',', cast(rid % 4 as string), case when rid % 2 = 0 then ';TLOD=1.5,2.5' else '' end, case when rid % 3 = 0 then ';STR' else '' end, ';ECNT=', cast(rid % 6 as string),
                      ';END=', cast(rid % 100 as string), ';REFREP=', cast(rid % 8 as string), ',3;MQ=60', case rid % 4 when 0 then ';TYPE=SNV' when 1 then ';TYPE=Deletion' when 2 then ';TYPE=Insertion' else ';TYPE=Complex' end) as info,
               case rid % 3 when 0 then 'GT:RD:AD:DP' when 1 then 'GT:AD:RD:ALD:SS' else 'GT:DP' end as fmt,
               case rid % 3 when 0 then concat(case rid % 4 when 0 then '0/0' when 1 then '0/1' else '1/2' end, ':', cast(rid % 11 as string), ':', cast(rid % 6 as string), ':9')
                    when 1 then concat('0/1:', cast(rid % 7 as string), ':', cast(rid % 10 as string), ':', cast(rid % 3 as string), ',1:2') else '1/1:8' end as s0,
               case rid % 3 when 0 then concat(case rid % 5 when 0 then '0/0' when 1 then '0/1' else '1/2' end, ':', cast(rid % 4 as string), ':', cast(rid % 9 as string), ':7')
                    when 1 then concat('0/0:', cast(rid % 5 as string), ':', cast(rid % 2 as string), ':', cast(rid % 8 as string), ',0:1') else '0/1:6' end as s1
        from (select l_orderkey*8 + l_linenumber as rid from lineitem) r""",
    # mate pairs of 100-base reads of two samples; duplicates, secondary and unmapped reads, all operations of a CIGAR
    "reads_v": f"""
        select e as read_id, concat('q', cast(e - m as string)) as qname, case when cast((e - m) / 2 as int) % 3 = 0 then 'normal' else 'tumor' end as sample,
               1 + case when e % 9 <> 0 then 2 else 0 end + case when e % 41 = 0 then 4 else 0 end + case when m = 1 then 16 + 128 else 64 end + case when e % 37 = 0 then 256 else 0 end + case when e % 17 = 0 then 1024 else 0 end as flag,
               concat('chr', cast(c as string)) as chrom, pos - 1 as start0, cast(e % 61 as int) as mapq,
               case e % 9 when 0 then '100M' when 1 then '40M2I58M' when 2 then '50M3D50M' when 3 then '5S95M' when 4 then '90M10S' when 5 then '30M1D70M'
                    when 6 then '3S40M2I3D40M15S' when 7 then '2H50M4N48M2S' else '20M1P30M5I45M' end as cigar,
               case when m = 0 then 150 + (e - m) % 1200 else -150 - (e - m) % 1200 end as tlen, case when e % 7 = 0 then null else cast(e % 5 as int) end as nm,
               EACH(100, o -> substr('ACGT', (cast(((pos + o)*7919 + c*104729) % 10007 as int) % 4 + case when (e + o) % 23 = 0 then 1 else 0 end) % 4 + 1, 1)) as seq,
               EACH(100, o -> chr(cast(35 + (e + o) % 40 as int))) as quals
        from (select event_id as e, event_id % 2 as m, (event_id - event_id % 2) % 5 + 1 as c, ((event_id - event_id % 2)*53 + (event_id % 2)*60) % 20000 + 1 as pos from events) r""",
    "pileup_v": """
        select o_orderkey as site, concat('chr', cast(o_custkey % 5 + 1 as string)) as chrom, 1 + (o_orderkey*91) % 20000 as pos, 'A' as ref,
               concat(repeat('.', cast(o_custkey % 7 as int)), repeat(',', cast(o_orderkey % 5 as int)), repeat('^+.', cast(o_orderkey % 2 as int)),
                      case when o_custkey % 3 = 0 then 'G+2ACT' else 'g$' end, repeat('t', cast(o_custkey % 4 as int)),
                      case when o_orderkey % 4 = 0 then ',-3ttt' else '*' end) as bases
        from orders""",
    "records_v": """
        select o_orderkey as site, case o_custkey % 6 when 0 then 'R' when 1 then 'AM' else 'C' end as ref, case o_orderkey % 5 when 0 then '<DEL>' else 'T' end as alt,
               case o_custkey % 11 when 0 then 'PASS' when 1 then 'Tier1' when 2 then 'Tier3' when 3 then 'Tier5' when 4 then 'REJECT' when 5 then 'p8;NM4' when 6 then 'q1;PASS' when 7 then 'P0.05' when 8 then 'v3;q9' when 9 then 'a;b;c' else 'v4' end as filter,
               case o_orderkey % 6 when 0 then 'SOMATIC;TLOD=1.5' when 1 then 'STATUS=LikelySomatic;SSF=0.14;VD=8' when 2 then 'DP=3;END=9' when 3 then 'STATUS=StrongSomatic;SSF=0.2;VD=2' when 4 then 'XSOMATIC=1;END=3' else '.' end as info,
               case o_custkey % 4 when 0 then 'rs5,COSM7' when 1 then 'COSV8;rs9;x' when 2 then '.' else 'rsx' end as id,
               concat('ANN=T|missense|M|', case when o_custkey % 3 = 0 then '' else concat('G', cast(o_custkey % 9 as string)) end, '|i|transcript|TX', cast(o_orderkey % 8 as string), '|c|1|c.1A>T|', case o_orderkey % 3 when 0 then 'p.Ala5Val' when 1 then 'p.Gly7Gly' else '' end,
                      '|9,C|x|y|G2|i|t|TX9|c|1|c.2|p.Leu', cast(o_custkey % 50 as string), 'Pro|3;DP=', cast(o_orderkey % 40 as string)) as effects
        from orders""",
    "sequences_v": "select doc_id, upper(regexp_replace(text, '[^ACGTacgt]', 'A')) as seq0 from documents",
}
# single-base records of vcf_v, each with a neighbour one or two bases on
VIEWS["near_v"] = f"""
        select chrom, pos + step * (1 + pos % 2) as pos, case step when 0 then ref else {BASE.format(pos='pos + 1 + pos % 2', c='cast(substr(chrom, 4) as int)')} end as ref,
               case step when 0 then alt else substr('ACGT', (cast(((pos + 1 + pos % 2)*7919 + cast(substr(chrom, 4) as int)*104729) % 10007 as int) % 4 + 1) % 4 + 1, 1) end as alt, filter
        from ({VIEWS['vcf_v']}) v join (select 0 as step union all select 1 as step) s on length(ref) = 1"""
TABLES = ("orders", "lineitem", "part", "events", "customer", "documents")
_EACH = re.compile(r"EACH\((\d+), o -> (.*?)\) as (\w+)")
_READS = re.compile(r"from \((select event_id as e, .* from events)\) r")


#: What ``BASE`` gives for one place after another, from the one whose pos*7919 + c*104729 is 0 modulo 10007 on: one period and 200 more.
_BASES = "".join("ACGT"[j * 7919 % 10007 % 4] for j in range(10007 + 200))
#: The places by which a contig is ahead of the one before; 10007 is a prime, so there is one such number.
_AHEAD = 104729 * pow(7919, -1, 10007) % 10007
_QUALITIES = "".join(chr(35 + j % 40) for j in range(140)).replace("'", "\\'")


def _line(bases: str) -> str:
    """Up to 200 bases from a multiple of 100 on, so that at least 100 follow place j; short, as a text is walked from its start."""
    return f"get(split('{' '.join(bases[i : i + 200] for i in range(0, 10007, 100))}', ' '), cast((pos + c*{_AHEAD}) % 10007 div 100 as int))"


#: The sequence of a read in parts: of its line as it is, and at every 23rd base from place f on, of the line of next letters.
_PARTS = [("a", "0", "f")]
for _k in range(5):
    _PARTS += [("b", f"f + {23 * _k}", "1" if _k < 4 else "if(f < 8, 1, 0)"), ("a", f"f + {23 * _k + 1}", "22" if _k < 3 else f"greatest(0, least(22, {99 - 23 * _k} - f))")]
#: Texts of ``reads_v`` that Spark cuts out of fixed lines, for e >= 0; made letter by letter they took most of the time of queries over reads.
_CUT = {
    "seq": f"concat({', '.join(f'substr({line}, j + 1 + {at}, {n})' for line, at, n in _PARTS)})",
    "quals": f"substr('{_QUALITIES}', cast(e % 40 as int) + 1, 100)",
}
_CUT_FROM = rf"""from (select *, {_line(_BASES)} as a, {_line(_BASES.translate(str.maketrans('ACGT', 'CGTA')))} as b,
               cast((pos + c*{_AHEAD}) % 10007 % 100 as int) as j, cast((23 - e % 23) % 23 as int) as f from (\1) s) r"""


def _spark(text: str) -> str:
    """Characters as one expression each, so that they are compiled; a lambda over a sequence is interpreted.

    The empty text at the end is a lambda on purpose: it keeps them out of whole-stage code, where they would be one method too long for the JIT.
    """

    def characters(m: re.Match) -> str:
        each = ", ".join(re.sub(r"\bo\b", str(o), m[2]) for o in range(int(m[1])))
        made = f"concat({each}, array_join(filter(array(''), z -> z is null), ''))"
        return f"case when e >= 0 then {_CUT[m[3]]} else {made} end as {m[3]}" if of_reads and m[3] in _CUT else f"{made} as {m[3]}"

    of_reads = _READS.search(text)
    return _READS.sub(_CUT_FROM, _EACH.sub(characters, text))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views over the tables of a folder."""
    text = _spark(VIEWS[name])
    for table in TABLES:
        if f"from {table}" in text:
            return spark.sql(text.replace(f"from {table}", "from {source}"), source=spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    raise KeyError(name)


def as_records(rows: DataFrame) -> DataFrame:
    """Rows of ``vcf_v`` or ``raw_v`` in the form of ``scan_vcf``: format and samples as arrays, no quality."""
    return rows.withColumns({"format": F.split("fmt", ":"), "samples": F.array("s0", "s1"), "qual": F.lit(None).cast("double")}).drop("fmt", "s0", "s1")


def duck(sql: str) -> str:
    """A query over views as one DuckDB statement."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    text = ", ".join(f"{n} as ({VIEWS[n]})" for n in used)
    recursive = "recursive " if sql.lower().startswith("with recursive ") else ""
    rest = "," + sql[5 + len(recursive) :] if sql.lower().startswith("with ") else sql
    text = f"with {recursive}{text} {rest}" if used else sql
    text = _EACH.sub(lambda m: f"array_to_string(list_transform(range({m[1]}), lambda o: {m[2]}), '') as {m[3]}", text)
    return text.replace(" as string)", " as varchar)").replace("'[^ACGTacgt]', 'A')", "'[^ACGTacgt]', 'A', 'g')")
