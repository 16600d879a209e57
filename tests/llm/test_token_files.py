"""Token files: single documents, the dictionary, and what tokenizers are taken."""

import json
import zlib

import numpy as np
import pytest

from callweave.llm import bpe, queries, token_files
from test_bpe import PATH


def ids_of(text):
    return [*bpe.tokenizer(PATH).encode(text or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("texts", [["one", None, ""], ["a few words of text number %d" % i for i in range(300)], []])
def test_single_documents(spark, tmp_path, texts):
    rows = [(i * 3, t, "x") for i, t in enumerate(texts)] + ([(6, "again", "x"), (None, "no id", "x")] if texts else [])
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    folder = str(tmp_path / "files")
    token_files.write_token_files(docs, PATH, folder)
    stored = token_files._stored(spark, folder)
    assert len(stored) == 1 and all(len(raw) > 0 for raw, _ in stored.values())
    for i in (0, 6, 3 * len(texts) + 1):
        want = sorted(ids_of(t) for d, t, _ in rows if d == i)
        assert sorted(token_files.read_document(spark, folder, i)) == want
    got = token_files.read_token_files(spark, folder, ("ids", "ids_crc32")).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids) for r in got) == sorted((d is not None, d or 0, ids_of(t)) for d, t, _ in rows)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens


def test_changed_dictionary_is_refused(spark):
    with pytest.raises(ValueError):
        token_files._dictionary(b"something else", "0" * 64)


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"added_tokens": [{"content": "<pad>", "id": 0}]}, {"model": {"type": "Unigram"}}])
def test_other_tokenizers_are_refused(tmp_path, change):
    with open(PATH, encoding="utf-8") as file:
        made = json.load(file)
    bpe._check(made, PATH)
    with pytest.raises(ValueError):
        bpe._check(made | change, "changed")


def test_long_text_of_other_scripts_is_cut():
    data = np.frombuffer("слово за словом και ελληνικά 日本 語  x  y".encode(), np.uint8)
    starts = bpe.safe_starts(data, np.array([0, len(data)]))
    pieces = [bytes(data[a:b]).decode() for a, b in zip(starts, [*starts[1:], len(data)], strict=True)]
    assert len(pieces) > 6 and "".join(pieces) == bytes(data).decode()
    whole = bpe.tokenizer(PATH).encode("".join(pieces), add_special_tokens=False).ids
    assert [i for p in pieces for i in bpe.tokenizer(PATH).encode(p, add_special_tokens=False).ids] == whole


def test_queries_have_columns(spark):
    assert set(queries.ORACLES) <= set(queries.QUERIES)
