"""The pipeline on a small fixture: stages against plain Python, and all of them chained."""

import random

import corpus_pipeline
from test_operators import edit_distance, prose


def fixture(spark, folder):
    r = random.Random(11)
    texts = [f"{prose(r, 40)}\n{prose(r, 30)}" for _ in range(24)]
    texts += [texts[0], texts[1].replace("w1", "w2", 1), "Read more\n" + prose(r, 20), "Read more\n" + prose(r, 25), "Read more"]
    texts += ["\n".join(" ".join(f"W{k}###" for k in range(30 + i)) for _ in range(3)) for i in range(12)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    good = [(i, int(i < 29), 0) for i in range(len(texts))]
    spark.createDataFrame(good, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet"), texts


def test_stages(spark, tmp_path):
    docs, texts = fixture(spark, str(tmp_path))
    stages = dict(corpus_pipeline.STAGES)

    kept = {r.doc_id for r in stages["quality"](spark, docs, str(tmp_path)).collect()}
    assert kept == set(range(29))

    seen, want = [], {}
    for i, t in enumerate(texts):
        rest = []
        for line in t.split("\n"):
            if not any(line == y or min(len(line), len(y)) >= 20 and abs(len(line) - len(y)) <= 1 and edit_distance(line, y) <= 1 for y in seen):
                rest.append(line)
            seen.append(line)
        if "".join(rest).strip():
            want[i] = "\n".join(rest)
    got = stages["lines"](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= 80 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    got = stages["near_duplicates"](spark, docs, str(tmp_path))
    assert {r.doc_id for r in got.collect()} == {i for i, x in enumerate(root) if i == x}

    mixed = stages["mixing"](spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns and {(r.doc_id, r.text) for r in mixed.collect()} <= set(enumerate(texts))

    out = {r.doc_id: r for r in stages["encoding"](spark, docs, str(tmp_path)).collect()}
    assert set(out) == set(range(len(texts))) and all(r.n_tokens == len(r.ids) > 0 for r in out.values())


def test_run(spark, tmp_path):
    fixture(spark, str(tmp_path))
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got and got <= set(range(29)) - {24, 28}  # neither junk nor what has no line or text of its own
