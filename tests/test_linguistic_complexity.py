"""Substrings of up to 20 bases (X17) and of any length (X16 of the survey), against plain Python."""

import os
import random
import time

from callweave.functions.substrings import count_distinct, count_up_to, full_complexity, linguistic_complexity
from callweave.plans import registry
from callweave.plans.views import view

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def complexity(seq, longest=20):
    top = range(1, min(longest, len(seq)) + 1)
    kinds = len({seq[i : i + k] for k in top for i in range(len(seq) - k + 1)})
    return kinds / sum(min(4**k, len(seq) - k + 1) for k in top)


def test_query_against_plain_python(spark):
    want = {}
    for r in view(spark, SF, "sequences_v").where("doc_id < 20").collect():
        for w, at in enumerate(range(0, len(r.seq0), 81), 1):
            want[r.doc_id, w] = complexity(r.seq0[at : at + 81])
    got = {(r.doc_id, r.w): r.complexity for r in registry.QUERIES["linguistic_complexity"](spark, SF).where("doc_id < 20").collect()}
    assert set(got) == set(want) and len(got) > 20
    assert all(abs(got[k] - round(want[k], 9)) < 2e-9 for k in want)


def test_words_across_windows_count(spark):
    """Each window comes with the complexity of its whole sequence, whose words cross the ends of windows."""
    want = {r.doc_id: complexity(r.seq0) for r in view(spark, SF, "sequences_v").where("doc_id < 20 and length(seq0) > 0").collect()}
    got = {(r.doc_id, r.sequence_complexity) for r in registry.QUERIES["linguistic_complexity"](spark, SF).where("doc_id < 20").collect()}
    assert {d for d, _ in got} == set(want) and len(got) == len(want)
    assert all(abs(c - round(want[d], 9)) < 2e-9 for d, c in got)


def test_distinct_substrings():
    r = random.Random(4)
    texts = ["", "A", "AA", "A" * 400, "ACGT" * 90, "banana", "é\U0001f600é\U0001f600a", "ab" * 100 + "c" + "ab" * 100]
    texts += ["".join(r.choice("ACGT"[: r.randrange(1, 5)]) for _ in range(r.randrange(1, 200))) for _ in range(150)]
    for t in texts:
        assert count_distinct(t) == len({t[i:j] for i in range(len(t)) for j in range(i + 1, len(t) + 1)}), t
    assert count_distinct("A" * 300_000) == 300_000


def test_distinct_words_together():
    """Many texts at once, of any letters and lengths; a plain loop over 200,000 windows takes minutes, this a few seconds."""
    r = random.Random(5)
    texts = ["", "A", "A" * 400, "banana", "é\U0001f600é\U0001f600a", "abcdefghijklmnop" * 4, *("".join(r.choice("ACGTN"[: r.randrange(1, 6)]) for _ in range(r.randrange(1, 120))) for _ in range(200))]
    for longest in (1, 3, 20, 21, 40):
        want = [len({t[i : i + k] for k in range(1, longest + 1) for i in range(len(t) - k + 1)}) for t in texts]
        assert count_up_to(texts, longest).tolist() == want
    start = time.process_time()
    count_up_to(["".join(r.choices("ACGT", k=81)) for _ in range(1000)] * 200, 20)
    assert time.process_time() - start < 20


def test_complexity_column(spark):
    r = random.Random(6)
    texts = [None, "", "A", "ACGTN", "ACGT", *("".join(r.choice("ACGT") for _ in range(n)) for n in (19, 20, 21, 150))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, seq string").repartition(3)
    made = rows.select("i", linguistic_complexity("seq", 20).alias("c"))
    got = {x.i: x.c for x in made.collect()}
    for i, t in enumerate(texts):
        assert got[i] is None if not t or "N" in t else abs(got[i] - complexity(t)) < 1e-12
    assert "ArrowEvalPython" in made._jdf.queryExecution().executedPlan().toString()


def test_full_complexity(spark):
    r = random.Random(9)
    texts = [None, "", "A", "ACGTN", "A" * 60, "ACGT", *("".join(r.choice("ACGT") for _ in range(n)) for n in (19, 20, 21, 22, 150))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, seq string").repartition(3)
    got = {x.i: x.c for x in rows.select("i", full_complexity("seq").alias("c")).collect()}
    for i, t in enumerate(texts):
        if not t or "N" in t:
            assert got[i] is None
        else:
            assert abs(got[i] - complexity(t, len(t))) < 1e-12
    assert rows.limit(0).select(full_complexity("seq")).count() == 0


def test_query_of_whole_sequences(spark):
    got = {x.doc_id: x.complexity for x in registry.QUERIES["sequence_complexity_full"](spark, SF).collect()}
    rows = view(spark, SF, "sequences_v").collect()
    assert set(got) == {x.doc_id for x in rows}
    short = [x for x in rows if x.seq0 and len(x.seq0) < 400]
    assert short and all(abs(got[x.doc_id] - round(complexity(x.seq0, len(x.seq0)), 9)) < 2e-9 for x in short)


def test_substrings_of_all_lengths_are_counted_with_few_sorts(monkeypatch):
    """Ranks begin with as many characters as a number holds, so a repeat of 60 bases takes 3 sorts (7 by doubling from one)."""
    import numpy as np

    from callweave.functions import substrings as U

    for text in ("", "A", "AAAA", "é😀é😀x", "ACGT" * 17, "GATTACA" * 5 + "é"):
        assert U.count_distinct(text) == len({text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)})
    part = "ACGGTTCAGGCATTACGTTTGACCAGTAACCGGTATCGATTGCAACTGGCATGTCCAATGC"
    sorts, unique = [], np.unique
    monkeypatch.setattr(U.np, "unique", lambda *a, **k: sorts.append(1) or unique(*a, **k))
    U.count_distinct(part + "T" + part)
    assert len(sorts) == 3
