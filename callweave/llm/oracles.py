"""The queries of this subpackage as DuckDB statements, where SQL can express them."""

from __future__ import annotations

from callweave.llm import quality_rules as Q

#: Lines of documents, distinct lines with their first place, and the neighbourhood of one deletion of each.
LINE_DEDUP = r"""
with lines as (select doc_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents where text is not null),
 shown as (select doc_id, pos, trim(raw, ' ') as line from lines where regexp_matches(raw, '[^ \t\n\x0B\f\r]')),
 firsts as (select line, min((doc_id, pos)) as first, length(line) as n from shown group by line),
 long as (select line, first, n from firsts),
 variants as (select line, first, i, hash(substr(line, 1, i - 1) || substr(line, i + 1)) as v from (select *, unnest(range(1, n + 1)) as i from long)),
 replaced as (select v, i, min(first) as first from variants group by v, i having count(*) > 1),
 near as (select distinct a.line from variants a join replaced b on b.v = a.v and b.i = a.i and b.first < a.first
  union select distinct a.line from variants a join long b on hash(b.line) = a.v and b.first < a.first union select distinct b.line from variants a join long b on hash(b.line) = a.v and a.first < b.first),
 gone as (select s.doc_id, s.pos from shown s join firsts f on f.line = s.line left join near x on x.line = s.line where x.line is not null or (s.doc_id, s.pos) <> f.first),
 kept as (select l.doc_id, string_agg(raw, chr(10) order by l.pos) as text from lines l anti join gone g on g.doc_id = l.doc_id and g.pos = l.pos group by l.doc_id)
select d.doc_id, case when d.text is null then null else coalesce(k.text, '') end as text, cast(case when d.text is null then 0 else len(string_split(d.text, chr(10))) end as bigint) as n_lines,
 coalesce((select count(*) from gone g where g.doc_id = d.doc_id), 0) as n_removed from documents d left join kept k on k.doc_id = d.doc_id
"""

#: Two-word shingles of lower-cased words, links at 80 % by an inverted index, and everything that a document reaches.
NEAR_DUPLICATES = r"""
with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
 sets as (select doc_id, list_distinct(case when len(w) >= 2 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else w end) as s from words),
 shingles as (select doc_id, len(s) as n, unnest(s) as x from sets),
 shared as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as k from shingles a join shingles b on a.x = b.x and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
 links as (select a, b from shared where 100 * k >= 80 * (na + nb - k)),
 reached as (select doc_id as a, doc_id as b from sets union select r.a, l.b from reached r join links l on l.a = r.b),
 roots as (select a, min(b) as root from reached group by a)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, r.root as component_id, s.doc_id = r.root as kept from sets s join roots r on r.a = s.doc_id
"""

_LETTERS = {"lower": "a-z", "upper": "A-ZÀ-ÖØ-Þ", "digit": "0-9", "blank": r" \t-\r", "stop": r".,;:!?''\"()\-", "symbol": "#*$%&|<>"}
_COUNT = {k: f"length(t) - length(regexp_replace(t, '[{x}]', '', 'g'))" for k, x in _LETTERS.items()}
#: Characters beyond ASCII without those that count as upper case.
_COUNT["other_letter"] = "length(regexp_replace(t, '[\\x00-\\x7FÀ-ÖØ-Þ]', '', 'g'))"
#: Base counts, histograms, references of languages (the mean over all for small or unknown ones) and distances from them.
QUALITY_RULES = rf"""
with texts as (select row_number() over (order by doc_id) as r, doc_id, lang, coalesce(text, '') as t from documents),
 w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from texts),
 windows as (select r, i, hash(array_to_string(w[i:i + {Q.WINDOW_WORDS - 1}], ' ')) as h from (select r, w, unnest(range(1, len(w) - {Q.WINDOW_WORDS - 2})) as i from w)),
 again as (select r, i from windows qualify count(*) over (partition by r, h) > 1), covered as (select r, count(distinct i + j) as n from again, range({Q.WINDOW_WORDS}) s(j) group by r),
 lines as (select r, unnest(string_split(t, chr(10))) as line from texts), dups as (select r, count(*) - count(distinct line) as n from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
 base as (select w.r, doc_id, lang, t, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars, cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
   coalesce(d.n, 0) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words, length(t) as n_chars from w left join dups d on d.r = w.r left join covered c on c.r = w.r),
 judged as (select *, n_words < {Q.MIN_BASE_WORDS} or 100 * n_repeat_words > {Q.MAX_REPEATED_PERCENT} * n_words as base_failed from base),
 plain as (select r, lower(trim(unnest(w), '.,;:!?''"()-')) as x from w), vocabulary as (select unnest({Q.WORDS!r}) as x, generate_subscripts({Q.WORDS!r}, 1) as k),
 counts as (select r, 'classes' as kind, k, c from (select r, {', '.join(f'{e} as {k}' for k, e in _COUNT.items())} from texts) unpivot (c for k in ({', '.join(_COUNT)}))
  union all select r, 'classes', 'other', length(t) - ({' + '.join(_COUNT.values())}) from texts
  union all select p.r, 'common', coalesce(cast(v.k as varchar), 'rest'), count(*) from plain p left join vocabulary v on v.x = p.x group by all),
 shares as (select r, kind, k, c / sum(c) over (partition by r, kind) as p from counts qualify sum(c) over (partition by r, kind) > 0),
 fair as (select r, coalesce(lang, '') as lang from judged where not base_failed and n_words >= {Q.MIN_WORDS} and n_chars >= {Q.MIN_CHARS}), sizes as (select lang, count(*) as n from fair group by lang),
 by_lang as (select f.lang, kind, k, sum(p) / any_value(z.n) as y from shares join fair f on f.r = shares.r join sizes z on z.lang = f.lang where z.n >= {Q.MIN_REFERENCE_DOCS} and f.lang <> '' group by f.lang, kind, k),
 overall as (select kind, k, sum(p) / (select count(*) from fair) as y from shares join fair f on f.r = shares.r group by kind, k),
 refs as (select j.r, o.kind, o.k, o.y from judged j, overall o where coalesce(j.lang, '') not in (select lang from by_lang) union all select j.r, b.kind, b.k, b.y from judged j join by_lang b on b.lang = j.lang),
 terms as (select coalesce(s.r, f.r) as r, coalesce(s.kind, f.kind) as kind, coalesce(s.p, 0) as x, coalesce(f.y, 0) as y from shares s full join refs f on f.r = s.r and f.kind = s.kind and f.k = s.k),
 distances as (select r, kind, sqrt(greatest(0, sum(case when x > 0 then x * log2(2 * x / (x + y)) else 0 end + case when y > 0 then y * log2(2 * y / (x + y)) else 0 end) / 2)) as d, sum(x) as whole, sum(y) as known from terms group by r, kind),
 far as (select r, max(d) filter (where kind = 'classes' and whole > 0 and known > 0) as cd, max(d) filter (where kind = 'common' and whole > 0 and known > 0) as wd from distances group by r)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(cd, 9) as class_distance, round(wd, 9) as word_distance,
 not base_failed and not coalesce((n_chars >= {Q.MIN_CHARS} and cd > {Q.CLASS_LIMIT[0]} + {Q.CLASS_LIMIT[1]} / sqrt(n_words)) or (n_words >= {Q.MIN_WORDS} and wd > {Q.WORD_LIMIT[0]} + {Q.WORD_LIMIT[1]} / sqrt(n_words)), false) as kept
from judged j left join far f on f.r = j.r
"""

#: A table of crc32 by its rule, hashed words, gains of buckets, weights, noise and the places of the highest scores.
IMPORTANCE_DRAW = r"""
with crc as (select list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, i: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as t),
 texts as (select doc_id, text, 'd' as side from documents union all select null, text, 'b' from benchmark),
 words as (select doc_id, side, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from texts),
 spelled as (select w, hex(encode(w)) as x from (select distinct unnest(w) as w from words)),
 hashed as (select w, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(length(x) // 2), lambda i: cast('0x' || x[2 * i + 1:2 * i + 2] as bigint))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 10000 as bucket from spelled, crc),
 found as (select doc_id, side, bucket from (select doc_id, side, unnest(w) as w from words) join hashed using (w)),
 counts as (select bucket, count(*) filter (where side = 'd') as s, count(*) filter (where side = 'b') as t from found group by bucket),
 totals as (select cast(coalesce(sum(s), 0) as double) as s, cast(coalesce(sum(t), 0) as double) as t from counts),
 gains as (select bucket, cast(floor(1000 * ln((c.t + 1) * (z.s + 10000) / ((c.s + 1) * (z.t + 10000)))) as bigint) as gain from counts c, totals z),
 weighed as (select doc_id, count(*) as n, cast(sum(gain) as bigint) as weight from found join gains using (bucket) where side = 'd' group by doc_id),
 scored as (select d.doc_id, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || sha256('2024:' || d.doc_id)[1:8] as bigint) + 0.5) / 4294967296.0))) as bigint) as score from documents d left join weighed w on w.doc_id = d.doc_id),
 placed as (select doc_id, row_number() over (order by score desc, doc_id) as rank from scored where n_features >= 20 qualify rank <= 10 * count(*) over () // 100)
select s.doc_id, n_features, weight, score, rank from scored s left join placed p on p.doc_id = s.doc_id
"""

ORACLES = {"op2_quality_rules": QUALITY_RULES, "op3_chosen_path": NEAR_DUPLICATES, "op5_line_dedup": LINE_DEDUP, "op13_importance_draw": IMPORTANCE_DRAW}
