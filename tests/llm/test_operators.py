import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from callweave.llm import chosen_path, components, line_crf, line_dedup, prefix_forest, quality_rules, shards, soft_mixing
from callweave.llm.text_arrays import TextArrays

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, shard int, node string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, "s", 1, "clash", 1, "x") for i, t in enumerate(texts)], SCHEMA)


def prose(r, n=60, words=400):
    return " ".join(r.choice([f"w{k}" for k in range(words)]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    base = [prose(r) for _ in range(12)]
    near = []
    for b in base[:6]:
        for _ in range(4):
            w = b.split()
            w[r.randrange(len(w))] = "changed"
            near.append(" ".join(w))
    lines = ["The first line stands here.\nAnother line that is long enough.\nshort", "the start\nAnother line that is long enuogh.\nThe first line stands here.", "The first lines stands here.\nThe fist line stands here.\n\nThe first line stands here!"]
    return [*base, *near, base[0], base[0], *lines, "", None, "one", "One", " \n\t", "é È " * 30, "a b a b a b a b a b", "x" * 5000]


def test_counts_by_hand(texts):
    t = TextArrays(pa.array(texts))
    for i, x in enumerate(texts):
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", x or "") if w]
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        hit = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
        seen, dup = set(), 0
        for line in (x or "").split("\n"):
            dup += line in seen and bool(line.strip(" \t\x0b\x0c\r"))
            seen.add(line)
        assert t.n_words[i] == len(words)
        assert t.per_text(t.visible & t.first_bytes)[i] == sum(map(len, words))
        assert np.bincount(t.word_text[t.repeated_words(8)], minlength=t.n)[i] == len(hit)
        assert np.bincount(t.line_text[t.repeated_line], minlength=t.n)[i] == dup


def test_quality_rules(spark, texts):
    got = {r.doc_id: r for r in quality_rules.quality_rules(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept) for r in got.values())
    assert quality_rules.quality_rules(frame(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, texts, words):
    def shingles(x):
        w = [v for v in (x or "").encode().lower().split()]
        return {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())

    sets = [shingles(x) for x in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    got = {r.doc_id: r for r in chosen_path.near_duplicates(frame(spark, texts), shingle_words=words).collect()}
    assert [got[i].component_id for i in range(len(texts))] == root
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert chosen_path.near_duplicates(frame(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("local", [0, 100_000])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(components, "LOCAL_EDGES", local)
    r = random.Random(2)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(50)]
    root = list(range(60))
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {n: root[n] for e in edges for n in e if e[0] != e[1] or n in got}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_line_dedup(spark, texts):
    r = random.Random(9)
    lines = ["".join(r.choice("abcdef gh") for _ in range(r.randint(20, 60))).strip() + "." for _ in range(12)]
    docs = []
    for _ in range(12):
        picked = []
        for x in r.choices(lines, k=4):
            k, how = r.randrange(1, len(x)), r.randrange(5)
            picked.append([x, x[:k] + x[k + 1 :], x[:k] + "z" + x[k:], x[:k] + "y" + x[k + 1 :], x][how])
        docs.append("\n".join(picked))
    docs += texts[-12:]
    seen, want = [], {}
    for i, t in enumerate(docs):
        rest = []
        for line in (t or "").split("\n"):
            x = line.strip(" ")
            if not x.strip() or all(abs(len(x) - len(y)) > 1 or edit_distance(x, y) > 1 for y in seen):
                rest.append(line)
            if x.strip() and x not in seen:
                seen.append(x)
        want[i] = None if t is None else "\n".join(rest)
    got = {x.doc_id: x for x in line_dedup.drop_repeated_lines(frame(spark, docs), counts=True).collect()}
    assert {k: v.text for k, v in got.items()} == want
    assert line_dedup.drop_repeated_lines(frame(spark, docs).limit(0)).count() == 0


def test_line_crf(spark):
    r = random.Random(3)
    good = [("\n".join(prose(r, 30) + "." for _ in range(5)), 1) for _ in range(60)]
    bad = [("\n".join(" ".join(f"W{k}###" for k in range(30)) for _ in range(5)), 0) for _ in range(60)]
    docs = frame(spark, [t for t, _ in good + bad] + ["", None])
    labels = spark.createDataFrame([(i, y, "x") for i, (_, y) in enumerate(good + bad)] + [(None, 1, "x"), (3, None, "x")], "doc_id long, quality int, text string")
    model = line_crf.train(docs, labels)
    got = {x.doc_id: x for x in line_crf.score(docs, model).collect()}
    assert all((got[i].score > 0.5) == (y == 1) for i, (_, y) in enumerate(good + bad)) and all(0 <= x.score <= 1 for x in got.values())
    assert line_crf.keep_good(docs, model).columns == docs.columns
    assert line_crf.train(docs, labels.limit(0)).constant == 0.5
    # forward-backward against all labellings of short chains
    rng = np.random.default_rng(0)
    emission, pairs, at = rng.normal(size=5), rng.normal(size=(2, 2)), np.array([0, 3, 5])
    p, _, z = line_crf.marginals(emission, pairs, at)
    for c in range(2):
        e, total, on = emission[at[c] : at[c + 1]], 0.0, np.zeros(at[c + 1] - at[c])
        for code in range(1 << len(e)):
            y = [(code >> k) & 1 for k in range(len(e))]
            w = np.exp(sum(e[k] * y[k] for k in range(len(e))) + sum(pairs[y[k], y[k + 1]] for k in range(len(e) - 1)))
            total, on = total + w, on + w * np.array(y)
        assert np.allclose(p[at[c] : at[c + 1]], on / total) and np.isclose(z[c], np.log(total))


def test_prefix_forest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16))
    x[7] = x[8]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, [1.0] * 16), (900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, [1.0])]
    index = prefix_forest.PrefixForestIndex(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = index.search(F.col("id") % 20 == 0, 5).collect()
    found, hits = {}, 0
    for r in got:
        found.setdefault(r.query_id, {})[r.rank] = r
    assert sorted(found) == list(range(0, 300, 20)) and all(sorted(v) == [1, 2, 3, 4, 5] for v in found.values())
    for q, ranks in found.items():
        s = x @ x[q]
        s[q] = -np.inf
        hits += len({r.vec_id for r in ranks.values()} & set(np.lexsort((np.arange(300), -s))[:5].tolist()))
        assert all(np.isclose(r.score, s[r.vec_id]) for r in ranks.values())
    assert hits / (5 * len(found)) >= 0.9


def test_shards(spark, texts):
    docs = frame(spark, texts + ["copy of a text " * 20] * 40)
    got = shards.shard(docs, 3).collect()
    assert len(got) == docs.count()
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {r.shard for r in got} == {0, 1, 2}
    assert shards.shard(docs.limit(0), 3).count() == 0


def best_fit(classes, capacity):
    """Groups one by one into the tightest bin: what is left of each bin."""
    rooms = []
    for size in [s for s, n in sorted(classes, reverse=True) for _ in range(n)]:
        fits = [(room, i) for i, room in enumerate(rooms) if room >= size]
        if fits:
            rooms[min(fits)[1]] -= size
        else:
            rooms.append(max(capacity, size) - size)
    return sorted(rooms)


def test_packing():
    r = random.Random(1)
    for _ in range(500):
        classes = [(s, r.randint(1, 30)) for s in r.sample(range(1, 60), r.randint(1, 12))]
        capacity = r.randint(20, 120)
        runs, bins = shards.pack(classes, capacity)
        load, ranks = [0] * bins, [0] * len(classes)
        for x in runs:
            assert x.start == ranks[x.index]
            ranks[x.index] = x.stop
            for k in range(x.start, x.stop):
                load[x.first + (k - x.start) // x.each] += classes[x.index][0]
        assert ranks == [n for _, n in classes]
        assert sorted(max(capacity, n) - n for n in load) == best_fit(classes, capacity)


def test_capacity(spark):
    """No shard holds more than the capacity, but for one group that is larger; equal texts stay together."""
    r = random.Random(2)
    texts = [x for i in range(60) for x in ["y" * r.randint(4000, 9000) + str(i)] * r.randint(1, 3)] + ["z" * 30_000] * 2 + [None, None, ""]
    got = shards.shard(frame(spark, texts), capacity=40_000).collect()
    size, where = {}, {}
    for x in got:
        size[x.shard] = size.get(x.shard, 0) + x.size
        where.setdefault(texts[x.doc_id] or "", set()).add(x.shard)
    assert len(got) == len(texts) and all(len(s) == 1 for s in where.values())
    assert sorted(size)[-1] == len(size) - 1 and sum(v > 40_000 for v in size.values()) == 1 and max(size.values()) == 60_002
    assert len(size) <= sum(size.values()) // 40_000 + 3


def test_mixing(spark):
    r = random.Random(4)
    rows = [("good", prose(r, 80)) for _ in range(120)] + [("toxic", prose(r, 76) + " idiot scum moron trash") for _ in range(60)] + [("low", "SHOUT## " * 40) for _ in range(60)]
    docs = frame(spark, [t for _, t in rows] + [None, ""])
    labels = spark.createDataFrame([(i, int(d != "low"), int(d == "toxic")) for i, (d, _) in enumerate(rows)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    got = soft_mixing.soft_mixture(docs, labels, {"good": 0.8, "toxic": 0.1, "low": 0.1}).collect()
    assert len(got) == len(rows) + 2 and all(abs(g.p_low + g.p_good + g.p_toxic - 1) < 1e-9 and g.rate >= 0 for g in got)
    sums = {d: sum(g.rate * g.n_tokens * g[f"p_{d}"] for g in got) for d in soft_mixing.DOMAINS}
    assert abs(sums["good"] / sum(sums.values()) - 0.8) < 0.02 and abs(sums["toxic"] / sum(sums.values()) - 0.1) < 0.02
    named = docs.limit(150).withColumns({"__copies": F.lit(3), "__KEY": F.lit("q"), "__k": F.lit(None).cast("int")})
    mixed = soft_mixing.mix(named, labels)
    assert mixed.columns == named.columns and {(x["__copies"], x["__KEY"], x["__k"]) for x in mixed.collect()} == {(3, "q", None)}
    assert soft_mixing.soft_mixture(docs.limit(0), labels).count() == 0 and soft_mixing.soft_mixture(docs, labels.limit(0)).count() == len(rows) + 2
