"""Main text by hand-made pages; runs that repeat against plain loops; pages of the tables against their articles."""

import html
import os
import random
import re
import sys

import numpy as np
import pytest

from callweave.llm import host_suffix as H

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from test_queries import SF  # noqa: E402

SCHEMA = "page_id long, url string, html string, id string, row int, text string, stream string, host string"


def frame(spark, pages):
    return spark.createDataFrame([(i, u, h, "x", 1, "x", "x", "x") for i, u, h in pages], SCHEMA)


def shown(page):
    return [t for t, furniture, _ in H.blocks(page) if not furniture]


@pytest.mark.parametrize(("page", "text"), [
    ("<p>one<b>two</b> <i>three</i><br>four<p>five", ["onetwo three", "four", "five"]),
    ("a &lt; b &amp;amp; c&nbsp;&#233; &copy d", ["a < b &amp; c é © d"]),
    ("<script>var t=\"</p>\";</script>x<style>p{}</style><SCRIPT>y</SCRIPT >z", ["x", "z"]),
    ("<title>t</title><p title='a>b' class=x>1 < 2 and 3 > 2</p><!-- <p>no</p> -->", ["1 < 2 and 3 > 2"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
    ("<nav><a href=x>m</a></nav><div class='post ad-slot'>ad<p>more</div><div id=comments><p>said</div><form>f</form>rest", ["rest"]),
    ("<div role=navigation>n</div><div hidden>h</div><div style='display: none'>h</div><header>top</header><article><header>head</header>x</article>", ["head", "x"]),
    ("<p>a</b></div>b</p>c<textarea>t</textarea><div><b>d</div>e", ["a", "b", "c", "d", "e"]),
    ("text <a href=\"unclosed>x</a> y", ["text x y"]),
    ("<p>cut off <b", ["cut off"]), ("<script>never closed", []), ("<!-- never closed", []), ("", []), ("   \n ", []), ("<>< a", ["<>< a"]),
])
def test_blocks(page, text):
    assert shown(page) == text


def test_articles_and_runs(spark):
    menu, notice = "home news sport weather travel money food books", "we use small files to make this site better for you"
    pages = [
        (1, "http://a.org/1", f"<ul><li>{menu.replace(' ', '<li>')}</ul><p>The first story is told here.<p>{notice}"),
        (2, "http://u@A.org:80/2", f"<ul><li>{menu.replace(' ', '<li>')}</ul><p>Another one stands on this page.<p>{notice}"),
        (3, "http://b.org/1", f"<p>{notice}<p>Only on this host."),
        (4, "http://a.org/3", f"<article><h1>Title</h1><p>{notice}<p>Kept as it is.</article><p>{notice}"),
        (5, "http://a.org/4", f"<article><h1>Title</h1><p>{notice}<p>Kept as it is.</article><p>{notice}"),
        (6, None, None), (7, "", ""), (None, "odd", "<p>odd"), (None, "odd", "<p>odd"), (1, "http://a.org/1", "<p>same id"),
        (8, "http://c.org/1", f"<p>{notice} and {menu}"), (9, "http://c.org/2", f"<p>{notice} and {menu}"),
        (10, "http://a.org/9", f"<p>{menu} <b>3</b> {notice}"),
    ]
    whole = f"Title {notice} Kept as it is."
    want = {(1, "The first story is told here."), (2, "Another one stands on this page."), (3, f"{notice} Only on this host."), (4, whole), (5, whole), (6, ""), (7, ""), (None, "odd"), (1, "same id"), (8, f"{notice} and {menu}"), (9, f"{notice} and {menu}"), (10, "")}
    for rows in (10**6, 0):
        got = H.main_text(frame(spark, pages), broadcast_rows=rows)
        assert got.columns == ["page_id", "url", "text", "n_chars", "n_repeated"]
        got = got.collect()
        assert len(got) == len(pages) and {(r["page_id"], r["text"]) for r in got} == want
        assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert H.main_text(frame(spark, [])).count() == 0


def test_suffixes():
    r = random.Random(1)
    for run in (1, 2, 3, 5, 8):
        streams = np.sort(np.array([r.randrange(6) for _ in range(200)]))
        words = np.array([r.randrange(3) for _ in range(200)])
        at, rank = H.sorted_suffixes(words, streams, run)
        whole = [i for i in range(200 - run + 1) if streams[i] == streams[i + run - 1]]
        key = lambda i: tuple(words[i : i + run])  # noqa: B023, E731
        assert sorted(at.tolist()) == whole
        keys = [key(i) for i in at]
        assert keys == sorted(keys) and all((a == b) == (x == y) for a, b, x, y in zip(keys, keys[1:], rank, rank[1:], strict=False))


def test_repeated(spark, monkeypatch):
    """Places of runs that another content of the host has, over several tasks and small arrays."""
    monkeypatch.setattr(H, "SORTED_WORDS", 60)
    r = random.Random(8)
    rows = [(i, r.choice("ab"), r.randrange(20), [r.randrange(4) for _ in range(r.randrange(30))]) for i in range(80)]
    held = {}
    for i, host, content, stream in rows:
        for k in range(len(stream) - 3):
            held.setdefault((host, *stream[k : k + 4]), []).append((i, k, content))
    want = sorted((i, k) for found in held.values() if len({c for _, _, c in found}) > 1 for i, k, _ in found)
    table = spark.createDataFrame(rows, "row long, host string, content long, stream array<long>").repartition(3)
    for limit in (10**6, 0):
        got = H.repeated(table, 4, limit).collect()
        assert sorted((x["row"], k) for x in got for k in x["places"]) == want


def test_tables(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in H.main_text(pages).collect()}
    for r in pages.collect():
        body = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("</?b>", "", b)).split()) for b in re.split("</?(?:p|h1|br)>", body))
        assert got[r["page_id"]] == " ".join(b for b in blocks if b)


def test_articles_are_compared(spark):
    """Words of declared articles go through the suffix arrays of their host as well; the articles stay whole."""
    told, other = "a story of nine words that two pages tell", "one more that only a single page of it tells"
    pages = [
        (1, "http://a.org/1", f"<nav>menu one</nav><article><p>{told}<p>{other}</article>"),
        (2, "http://a.org/2", f"<nav>menu two</nav><article><p>Before it. {told}</article>"),
        (3, "http://b.org/1", f"<article><p>{told}</article>"),
        (4, "http://a.org/3", f"<p>{told} <p>and this stays"),
    ]
    got = {r["page_id"]: (r["text"], r["n_repeated"]) for r in H.main_text(frame(spark, pages)).collect()}
    assert got == {1: (f"{told} {other}", 9), 2: (f"Before it. {told}", 9), 3: (told, 0), 4: ("and this stays", 9)}
