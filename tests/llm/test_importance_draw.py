"""The draw against plain Python: nulls, ties, repeated rows, very long words, runs of words, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from callweave.llm import importance_draw as I

SCHEMA = "doc_id long, text string, id string, key string, row long, at int, score int, rank string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text, ngrams, buckets):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, ngrams + 1) for i in range(len(w) - n + 1)]


def expected(docs, target, percent, ngrams, buckets, min_words, seed):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text, ngrams, buckets))
    for text in target:
        t.update(features(text, ngrams, buckets))
    whole, aimed = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (whole + buckets) / ((s[b] + 1) * (aimed + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        f = features(text, ngrams, buckets)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    fit = sorted((r for r, (_, text) in zip(out, docs, strict=True) if len(words(text)) >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = rank
    return out


@pytest.fixture(scope="module")
def docs():
    r = random.Random(3)
    made = [(i, " ".join(r.choice(["alpha", "Beta", "gamma1", "Été", "日本", "x-y"]) for _ in range(r.randrange(60)))) for i in range(150)]
    same = (7, "one text twice " * 12)
    return [*made, same, same, same, (None, "no id at all " * 9), (900, None), (901, ""), (902, "z" * 3000 + " " + "q" * 64 + " " + "é" * 40), (903, " \n--- ")]


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x", "x", 5, 6, 7, "x") for i, t in docs], SCHEMA)


@pytest.mark.parametrize(("ngrams", "percent"), [(1, 10), (1, 55), (1, 100), (2, 30)])
def test_draw(spark, docs, ngrams, percent):
    target = ["alpha beta zulu", "beta beta Été", None]
    got = I.draw(frame(spark, docs), spark.createDataFrame([(t,) for t in target], "text string"), percent, ngrams, 50, 20, 11)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    order = lambda r: [(x is None, x or 0) for x in r]
    assert sorted(map(tuple, got.collect()), key=order) == sorted(map(tuple, expected(docs, target, percent, ngrams, 50, 20, 11)), key=order)


def test_small_tables(spark, docs):
    none = spark.createDataFrame([], "text string")
    assert I.draw(frame(spark, []), none).count() == 0
    assert {r["rank"] for r in I.draw(frame(spark, docs[:5]), none, percent=1).collect()} == {None}


def test_crc32():
    texts = ["", "a", "é", "x" * 64, "x" * 65, "long " * 999, "a"]
    assert I.crc32(pa.array(texts)).tolist() == [zlib.crc32(t.encode()) for t in texts]
    assert I.crc32(pa.array([], pa.string())).tolist() == []


@pytest.mark.parametrize("k", [1, 2, 999, 1000, 3000])
def test_kth_key(spark, k):
    r = random.Random(k)
    keys = [(r.randrange(20), i) for i in range(3000)]
    table = spark.createDataFrame(keys, "a long, b long").repartition(5)
    assert I.kth_key(table, F.struct("a", "b"), k) == sorted(keys)[k - 1]
