import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from callweave.llm import bpe, bpe_codec, token_counts, token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")

ODD = ["", None, " ", "\n\n", "a", "don't 'll 've", "x<|endoftext|>y <|endoftext|> z", "é" * 50 + " ü 　 b", "a  b", "日本語、テキスト。" * 40, "ab" * 400, "A" * 900, "!?" * 300, " " * 500 + "x", "12 345,6" * 60, "it's\r\n\tfine  \n  so", "\x00\x1c a", "𝔘𝔫 " * 80]


def random_text(r: random.Random) -> str:
    parts = ["the", " of", "\n", "  ", "'s", "'ll", "ing", "é", "日本", "!!", "12", "<|endoftext|>", "|", "ab", " ", "zzz", "á", "'", "tion"]
    return "".join(r.choice(parts) for _ in range(r.randint(0, 400)))


def test_pieces_are_exact():
    encoder, plain = bpe.PieceEncoder(PATH), bpe.tokenizer(PATH)
    r = random.Random(1)
    texts = ODD + [random_text(r) for _ in range(200)]
    for _ in range(2):  # the second time from kept pieces
        flat, at = encoder.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert flat[at[i] : at[i + 1]].tolist() == plain.encode(t or "", add_special_tokens=False).ids, repr(t)
        assert encoder.counts(pa.array(texts)).tolist() == np.diff(at).tolist()


@pytest.mark.parametrize("leaf,window", [(7, 4), (40, 8), (150, 64)])
def test_tree_is_exact(leaf, window):
    encoder, plain = bpe.PieceEncoder(PATH), bpe.tokenizer(PATH)
    joiner, r = bpe_codec.Joiner(encoder, window), random.Random(leaf)
    letters = ["".join(r.choice("abetinosréß") for _ in range(600)) for _ in range(20)]
    for t in [x for x in ODD if x] + [random_text(r) for _ in range(80)] + letters:
        leaves = [(p, joiner.encode(p)) for p in bpe_codec.halves(t, leaf)]
        assert joiner.tree(leaves)[1].tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_encode_decode_counts_and_files(spark):
    plain = bpe.tokenizer(PATH)
    texts = [*ODD, "word " * 30_000 + "end", "x" * 70_000]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(3, texts[-2], "again", 1)] * 2 + [(None, "no id", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    want = sorted((-1 if i is None else i, plain.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in rows)
    got = bpe_codec.encode_decode(docs, PATH, ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"), leaf_chars=1000).collect()
    assert sorted((-1 if g.doc_id is None else g.doc_id, g.ids) for g in got) == want
    for g in got:
        assert g.n_tokens == len(g.ids) and g.decoded == plain.decode(g.ids, skip_special_tokens=False)
        assert g.ids_sha256 == hashlib.sha256(np.array(g.ids, "<u4").tobytes()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(g.decoded.encode()).hexdigest()
    counted = token_counts.token_counts(docs, PATH, limit=5).collect()
    assert sorted((-1 if c.doc_id is None else c.doc_id, c.n_tokens, c.over_limit) for c in counted) == sorted((i, len(x), len(x) > 5) for i, x in want)
    assert sorted(c.n_bytes for c in counted) == sorted(len((t or "").encode()) for _, t, *_ in rows)
    filed = sorted(token_files.token_files(docs, PATH, outputs=("ids", "ids_crc32")).collect(), key=lambda x: x.start)
    keys = [-1 if f.doc_id is None else f.doc_id for f in filed]
    assert keys == sorted(keys) and sorted((k, f.ids[:-1]) for k, f in zip(keys, filed, strict=True)) == want
    at = 0
    for f in filed:
        assert (f.start, f.n_tokens, f.ids[-1]) == (at, len(f.ids), 0) and f.ids_crc32 == zlib.crc32(np.array(f.ids, "<u4").tobytes())
        at += f.n_tokens


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_codec.encode_decode(docs, PATH).count() == 0
    assert token_counts.token_counts(docs, PATH).count() == 0
    assert token_files.token_files(docs, PATH).count() == 0
