"""Main text of web pages: markup tells what is furniture or article, a suffix array of each host tells what repeats.

A scanner reads each page once and gives its blocks (the text between tags that break lines), each with what the markup
says of it: furniture (menus, headers, footers, sidebars, notices, adverts, forms, reader comments, by tag, role, class or id),
article (``article``; else ``main`` and its like), or nothing.  Scripts, styles and other hidden elements have no blocks.

All words of a page form its token stream, inside and outside a declared article.  A task concatenates the streams of a chunk of pages
and sorts their suffixes by host and their first ``RUN`` words by prefix doubling; suffixes that agree in all of them are neighbours, and
where such neighbours belong to pages of one host and different content, the run repeats.  Runs that no other content of the chunk has go to
the task that compares their range of keys over all chunks, in compressed columns, a row for a chunk and range; what comes back are the
places of those that repeat.  So a menu on millions of pages is an entry a chunk, and a host with a third of all pages is spread over tasks.

A page that declares an article gives its blocks, whatever repeats: articles are published twice, and passages are shared;
``n_repeated`` tells how many of its words repeat.  On any other page, words that repeated runs cover go, with leftovers between them of
fewer than ``KEPT_RUN`` words, and so does what the markup calls furniture; unique runs stay.

Edge cases: null and empty pages have no text (empty string); a null or odd url counts to the host ""; pages of equal content
count once, so exact copies never remove each other; null and repeated ids and repeated rows give one row each; unclosed, stray
and cut-off tags, comments and scripts are read as far as they go; an empty table gives an empty table; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import BROADCAST_ROWS, bounded, cut_lineage, parallelism, slices, tidy

BATCH_BYTES = 4 << 20
#: Words that a repeated run has at least.
RUN = 8
#: Words between repeated runs that stay at least; shorter leftovers are a template's fields.
KEPT_RUN = 3
#: Words whose suffixes a task sorts at once.
SORTED_WORDS = 1 << 20
#: Letters of a page for each of its words, about.
LETTERS = 8
#: Runs that a task compares at once, about.
HELD_RUNS = 1 << 21

# Elements without text of their own, elements inside a line, furniture and articles.
HIDDEN = "script style noscript template svg math iframe object select button textarea audio video canvas title head".split()
RAW = "script style textarea title".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
INLINE = "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split()
FURNITURE = "nav footer aside form dialog menu".split()
FURNITURE_ROLES = "navigation banner contentinfo complementary search dialog alertdialog menu menubar form".split()
FURNITURE_WORDS = (
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr legal login masthead menu modal nav "
    "navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommended related replies respond share sharing sidebar signup social sponsor sponsored subscribe widget"
).split()
ARTICLE_ROLES = {"article": 2, "main": 1}
MAIN_NAMES = "article-body article-content content entry-content main main-content post-body post-content story-body".split()

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)")
_HIDDEN, _VOID, _INLINE, _FURNITURE, _WORDS = map(frozenset, (HIDDEN, VOID, INLINE, FURNITURE, FURNITURE_WORDS))
#: Elements that another one of the same kind closes, up to the element that holds them.
_CLOSED_BY = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


def host(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _marks(name: str, attributes: str, inside: int) -> tuple[bool, bool, int]:
    """Whether an element is hidden or furniture, and how surely it is the article (2), the main part (1) or neither (0)."""
    level = {"article": 2, "main": 1}.get(name, 0)
    hidden, furniture = name in _HIDDEN, name in _FURNITURE or name == "header" and inside == 0
    if attributes and "=" in attributes or "hidden" in attributes:
        found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)}
        named = f"{found.get('class', '')} {found.get('id', '')}"
        role = found.get("role", "")
        hidden |= "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
        words = set(re.split(r"[^a-z0-9]+", named))
        furniture |= role in FURNITURE_ROLES or not words.isdisjoint(_WORDS) or "header" in words and inside == 0 and level == 0
        level = max(level, ARTICLE_ROLES.get(role, 0), 2 if found.get("itemprop") == "articlebody" else 0, 1 if not set(named.split()).isdisjoint(MAIN_NAMES) else 0)
    return hidden, furniture, level


def blocks(page: str) -> list[tuple[str, bool, int]]:
    """Text, whether it is furniture, and article level of each block that shows text."""
    out, line, stack = [], [], [("", False, False, 0)]

    def flush() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            out.append((text, stack[-1][2], stack[-1][3]))

    at, n = 0, len(page)
    while at < n:
        tag = _TAG.search(page, at)
        stop = tag.start() if tag else n
        if stop > at and not stack[-1][1]:
            line.append(html.unescape(page[at:stop]))
        if not tag:
            break
        at = tag.end()
        close, name, attributes = (tag[1], tag[2], tag[3]) if tag[2] else (tag[4], tag[5], tag[6])
        if not name:
            continue
        name = name.lower()
        if name not in _INLINE:
            flush()
        if close:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name), 0)
            if depth and name in _INLINE and any(s[0] not in _INLINE for s in stack[depth + 1 :]):
                depth = 0  # a line's element doesn't close the blocks around it
            if depth:
                if stack[depth][1:] != stack[depth - 1][1:]:
                    flush()
                del stack[depth:]
            continue
        if name == "p" or name not in _INLINE and name not in _VOID:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] not in _INLINE), 0)
            if depth and stack[depth][0] == "p":
                del stack[depth:]
        if name in _CLOSED_BY:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
                if stack[k][0] in _CLOSED_BY[name]:
                    break
        if name in _VOID:
            continue
        hidden, furniture, level = _marks(name, attributes, stack[-1][3])
        if name in RAW:
            end = _END[name].search(page, at)
            at = end.start() if end else n
        if attributes.endswith("/") and name in ("svg", "math"):
            continue
        held = (stack[-1][1] or hidden, stack[-1][2] or furniture, max(stack[-1][3], level))
        if held != stack[-1][1:]:
            flush()
        stack.append((name, *held))
    flush()
    return out


# Pages to streams


def _read(url: str | None, page: str | None) -> tuple[str, list[tuple[str, bool, int]], int, int]:
    """Host, blocks, and hashes of the content alone and with its host: pages that agree in the latter are one row of what repeats."""
    found, name = blocks(page or ""), host(url)
    shown = "\n".join(t for t, _, _ in found)
    return name, found, xxhash.xxh64_intdigest(shown) - (1 << 63), xxhash.xxh64_intdigest(f"{name}\n{shown}") - (1 << 63)


def _parsed(pages: DataFrame) -> DataFrame:
    """Pages with the text of their declared article, or else all their blocks, and how many words they have."""
    kinds = [f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("id", "url")]

    def parse(batches: Iterable[pa.RecordBatch]):
        for whole in batches:
            for part in slices(whole, "html", BATCH_BYTES):
                rows = []
                for url, page in zip(part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True):
                    _, found, _, row = _read(url, page)
                    declared = max((level for _, marked, level in found if not marked), default=0)
                    article = " ".join(t for t, marked, level in found if not marked and level == declared) if declared else None
                    rows.append((row, article, [] if declared else [{"text": t, "marked": marked} for t, marked, _ in found], sum(t.count(" ") + 1 for t, _, _ in found)))
                made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), _BLOCKS, pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), *made], ["id", "url", "row", "article", "blocks", "n_words"])

    return pages.mapInArrow(tidy(parse), ", ".join([*kinds, "row long, article string, blocks array<struct<text:string,marked:boolean>>, n_words long"]))


_BLOCKS = pa.list_(pa.struct([("text", pa.string()), ("marked", pa.bool_())]))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word) - (1 << 63)
        return found


def _streams(pages: DataFrame) -> DataFrame:
    """The stream of all words of each page: hashes of the words of its blocks, in page order."""

    def hashed(batches: Iterable[pa.RecordBatch]):
        known = _Hashes()
        for whole in batches:
            for part in slices(whole, "html", BATCH_BYTES):
                rows, streams = [], []
                for url, page in zip(part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True):
                    name, found, content, row = _read(url, page)
                    words = [w for t, _, _ in found for w in t.split(" ")]
                    streams.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
                    rows.append((row, name, content))
                    if len(known) > 1 << 18:
                        known.clear()
                ends = np.cumsum([0, *map(len, streams)])
                stream = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*streams, np.zeros(0, np.int64)])))
                made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*made, stream], ["row", "host", "content", "stream"])

    return pages.mapInArrow(tidy(hashed), "row long, host string, content long, stream array<long>")


# Suffix arrays


def sorted_suffixes(words: np.ndarray, streams: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes with ``run`` words before their stream ends, sorted by these words; and a rank that is equal where they are.

    ``streams`` holds the stream of each word.  Prefix doubling, by as many prefixes at once as a number holds: ranks of the first k
    words make those of the first 2k, 3k, ..., and overlapping prefixes make those of ``run`` words.
    """
    at = np.arange(max(len(words) - run + 1, 0))
    at = at[streams[at] == streams[at + run - 1]]
    rank, k = np.unique(words, return_inverse=True)[1].astype(np.int64), 1
    while True:
        bits = max(1, int(rank.max(initial=0)).bit_length())
        steps = [min(i * k, run - k) for i in range(min(max(2, 63 // bits), -(-run // k)))]
        n = len(rank) - steps[-1]
        joined = np.zeros(max(n, 0), np.int64)
        for step in steps:
            joined = joined << bits | rank[step : step + len(joined)]
        k += steps[-1]
        if k == run:
            break
        rank = np.unique(joined, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(joined[at], kind="stable")
    at, joined = at[order], joined[at[order]]
    return at, np.cumsum(np.diff(joined, prepend=joined[:1]) != 0)


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of numbers as one compressed text, byte by byte of their numbers, as there may be one for each word of the corpus."""
    kinds = b"".join(c.dtype.str.encode() for c in columns)
    planes = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes() for c in columns)
    raw = np.array([len(columns), *map(len, columns)], np.int64).tobytes() + kinds + planes
    return np.int64(len(raw)).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(packed: bytes) -> list[np.ndarray]:
    raw = pa.decompress(packed[8:], int(np.frombuffer(packed, np.int64, 1)[0]), "zstd", asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    at, out = 8 * (n + 1) + 3 * n, []
    for k, size in enumerate(np.frombuffer(raw, np.int64, n, 8).tolist()):
        kind = np.dtype(raw[8 * (n + 1) + 3 * k : 8 * (n + 1) + 3 * (k + 1)].decode())
        planes = np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += size * kind.itemsize
    return out


def _found(streams: DataFrame, run: int, ranges: int) -> DataFrame:
    """Rows (to, chunk, entries, data) of what the suffix arrays of chunks of pages hold.

    To the task of each range of keys goes one row a chunk with the chunk's runs in it: key, content and place, in the order of places.
    A run that several contents of the chunk have is one entry without a content, as its places are known to repeat; these go, with the rows
    of the chunk's pages and where they begin, in a row of their own.
    """

    def sort(batches: Iterable[pa.RecordBatch]):
        held, n = [], 0
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("host", "row", "content")), (x.values.to_numpy() for x in batch.column("stream")), strict=True):
                held.append(r)
                n += len(r[3])
                if n >= SORTED_WORDS:
                    yield from of_chunk(held)
                    held, n = [], 0
        if held:
            yield from of_chunk(held)

    def of_chunk(held: list):
        sizes = np.array([len(r[3]) for r in held])
        owner = np.repeat(np.arange(len(held)), sizes)
        names = {h: xxhash.xxh64_intdigest(h) for h in {r[0] for r in held}}
        hosts = np.array([names[r[0]] for r in held], np.uint64)
        words = np.concatenate([r[3] for r in held]).astype(np.int64).view(np.uint64)
        suffixes, rank = sorted_suffixes(words ^ hosts[owner], owner, run)
        if not len(suffixes):
            return
        new = np.flatnonzero(np.diff(rank, prepend=-1))
        size = np.diff(np.append(new, len(rank)))
        keys = []
        starts = len(words) - run + 1
        for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):  # two independent hashes of the run and its host
            h = hosts[owner[:starts]]
            for j in range(run):
                h ^= words[j : j + starts]
                h *= np.uint64(factor)
                h ^= h >> np.uint64(29)
            keys.append(h[suffixes[new]])
        content, rows = np.array([r[2] for r in held], np.int64), np.array([r[1] for r in held], np.int64)
        of = content[owner[suffixes]]
        many = np.minimum.reduceat(of, new) != np.maximum.reduceat(of, new)
        apart = np.repeat(~many, size)
        group = np.concatenate([np.flatnonzero(many), np.repeat(np.flatnonzero(~many), size[~many])])
        place = np.concatenate([suffixes[new[many]], suffixes[apart]])
        of = np.concatenate([np.zeros(int(many.sum()), np.int64), np.where(of[apart] == 0, 1 << 62, of[apart])])
        to = (keys[1][group] % np.uint64(ranges)).astype(np.int64)
        order = np.argsort(to << 40 | place)
        cut = np.flatnonzero(np.diff(to[order], prepend=-1, append=ranges))
        key, chunk = keys[0] >> np.uint64(8), int(rows[0])
        for first, last in zip(cut[:-1], cut[1:], strict=True):
            here = order[first:last]
            # contents and places in the order of places hardly take room
            yield row(int(to[here[0]]), chunk, _packed(key[group[here]], of[here], np.diff(place[here], prepend=0).astype(np.uint32)), None)
        known = np.sort(suffixes[~apart])
        yield row(chunk % ranges, chunk, None, _packed(rows, (np.cumsum(sizes) - sizes).astype(np.int64), known.astype(np.uint32)))

    def row(*values):
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["to", "chunk", "entries", "data"])

    return streams.mapInArrow(tidy(sort), "to int, chunk long, entries binary, data binary")


def _compared(found: DataFrame) -> DataFrame:
    """Rows (chunk, places, data): the places of a chunk's runs that another content has as well, of all chunks that meet in a task."""

    def compare(batches: Iterable[pa.RecordBatch]):
        ranges: dict[int, list] = {}
        for batch in batches:
            for to, chunk, entries, data in zip(*(batch.column(c).to_pylist() for c in ("to", "chunk", "entries", "data")), strict=True):
                if entries is None:
                    yield row(chunk, None, data)
                else:
                    ranges.setdefault(to, []).append((chunk, *_unpacked(entries)))
        for held in ranges.values():
            key, of = (np.concatenate([h[k] for h in held]) for k in (1, 2))
            order = np.argsort(key, kind="stable")
            new = np.flatnonzero(np.diff(key[order], prepend=~key[order[0]]))
            low, high = (f.reduceat(of[order], new) for f in (np.minimum, np.maximum))
            shared = np.zeros(len(key), bool)
            shared[order] = np.repeat(low != high, np.diff(np.append(new, len(key))))
            shared &= of != 0
            ends = np.cumsum([len(h[1]) for h in held])
            for (chunk, _, _, steps), end in zip(held, ends, strict=True):
                here = shared[end - len(steps) : end]
                if here.any():
                    yield row(chunk, _packed(np.cumsum(steps.astype(np.int64))[here].astype(np.uint32)), None)

    def row(*values):
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["chunk", "places", "data"])

    return found.mapInArrow(tidy(compare), "chunk long, places binary, data binary")


def _spans(streams: DataFrame, run: int, words: int, held: int = HELD_RUNS) -> DataFrame:
    """For each row once, where the places begin and end in it, one after another, that hold a run of ``run`` words which another content of the host has as well.

    Runs are compared by 56 bits of a hash and the range that another hash puts them into; there are as many ranges as hold about ``held`` runs.
    """
    spark = streams.sparkSession
    ranges = max(parallelism(spark), -(-words // max(held, 256)))
    compared = _compared(_found(streams, run, ranges).repartition(ranges, "to"))
    chunks = compared.groupBy("chunk").agg(F.collect_list("places").alias("places"), F.first("data", ignorenulls=True).alias("data"))

    def resolve(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for places, data in zip(batch.column("places").to_pylist(), batch.column("data").to_pylist(), strict=True):
                rows, begins, known = _unpacked(data)
                at = np.unique(np.concatenate([known, *(_unpacked(p)[0] for p in places)]).astype(np.int64))
                if not len(at):
                    continue
                page = np.searchsorted(begins, at, "right") - 1
                at -= begins[page]
                first = np.flatnonzero((np.diff(page, prepend=-1) != 0) | (np.diff(at, prepend=-2) != 1))
                last = np.append(first[1:], len(at)) - 1
                owner, n = np.unique(page[first], return_counts=True)
                ends = pa.array(np.cumsum([0, *n]), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(rows[owner]), *(pa.ListArray.from_arrays(ends, pa.array(at[x])) for x in (first, last))], ["row", "first", "last"])

    return chunks.mapInArrow(tidy(resolve), "row long, first array<long>, last array<long>").dropDuplicates(["row"])


def repeated(streams: DataFrame, run: int = RUN, held: int = HELD_RUNS) -> DataFrame:
    """row and the places where a run of ``run`` words starts that another content of the host has as well."""
    words = streams.agg(F.sum(F.size("stream"))).first()[0] or 0
    each = F.flatten(F.transform(F.arrays_zip("first", "last"), lambda s: F.sequence(s["first"], s["last"])))
    return _spans(streams, run, words, held).select("row", each.alias("places"))


def _unique(blocks_: list[dict], covered: np.ndarray) -> str:
    """Unmarked blocks without their covered words and without short leftovers between these."""
    kept, at = [], 0
    for block in blocks_:
        words = block["text"].split(" ")
        here = covered[at : at + len(words)]
        at += len(words)
        if block["marked"] or here.all():
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[1], here, [1]])))
        whole = not here.any()
        kept.extend(" ".join(words[a:b]) for a, b in zip(edges[::2], edges[1::2], strict=True) if whole or b - a >= KEPT_RUN)
    return " ".join(kept)


def main_text(pages: DataFrame, run: int = RUN, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``id_col``, ``url_col``, text, n_chars, and n_repeated: the words of the whole page that repeat on the host."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    words = (rows.agg(F.sum(F.length("html"))).first()[0] or 0) // LETTERS
    places = cut_lineage(_spans(_streams(rows), run, words))
    held = places.agg(F.coalesce(F.sum(F.size("first")), F.lit(0))).first()[0]
    joined = _parsed(rows).join(bounded(places, broadcast_rows) if held <= 8 * broadcast_rows else places, "row", "left").drop("row")
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", "url"))

    def assemble(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            texts, n_repeated = [], []
            for article, found, n, first, last in zip(*(batch.column(c).to_pylist() for c in ("article", "blocks", "n_words", "first", "last")), strict=True):
                edge = np.zeros(n + run + 1, np.int64)
                np.add.at(edge, np.array(first or [], np.int64), 1)
                np.add.at(edge, np.array(last or [], np.int64) + run, -1)
                covered = np.cumsum(edge)[:n] > 0
                n_repeated.append(int(covered.sum()))
                texts.append(_unique(found, covered) if article is None else article)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(n_repeated, pa.int64())], ["id", "url", "text", "n_repeated"])

    made = joined.mapInArrow(tidy(assemble), f"{kinds}, text string, n_repeated long")
    return made.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"), "n_repeated")
