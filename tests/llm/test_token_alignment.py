"""Alignment against both libraries and plain loops; the fragment monoid; every way of joining and cutting."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from callweave.llm import token_alignment as T

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, id string, row string, pairs int, best string, at int"


def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def expected(docs):
    a_code, b_code = libraries()
    own = lambda i: bytes([int(b_code.id_to_piece(i)[1:-1], 16)]) if b_code.is_byte(i) else b_code.id_to_piece(i).replace("▁", " ").encode()
    aligned, count = [], Counter()
    for _, text in docs:
        a = a_code.encode(" " + text, add_special_tokens=False) if text else None
        b = b_code.encode(text) if text else []
        if a is None or b"".join(map(own, b)) != (" " + text).encode():
            aligned.append(None)
            continue
        a_ends = np.cumsum([len(a_code.id_to_token(i)) for i in a.ids]).tolist()
        b_ends = np.cumsum([len(own(i)) for i in b]).tolist()
        links, x, y = [], 0, 0
        while x < len(a.ids) and y < len(b):
            links.append((a.ids[x], b[y]))
            left, right = a_ends[x], b_ends[y]
            x, y = x + (left <= right), y + (right <= left)
        groups, x, y = [], 0, 0
        for end in sorted(set(a_ends) & set(b_ends)):
            u, v = a_ends.index(end) + 1, b_ends.index(end) + 1
            groups.append(",".join(map(str, a.ids[x:u])) + "|" + ",".join(map(str, b[y:v])))
            x, y = u, v
        aligned.append((len(a.ids), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        count.update(links)
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = []
    for (i, _), x in zip(docs, aligned, strict=True):
        out.append((i, 0, 0, 0, 0, 0, 0, "") if x is None else (i, *x[:3], len(x[3]), sum(count[k] == best[k[1]] for k in x[3]), sum(count[k] for k in x[3]), x[4]))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def docs():
    r = random.Random(2)
    letters = ["a", "the ", "Übergröße", " ", "  ", "\n", "\t", "日本語", "x1", " ", "<|endoftext|>", "</s>", "ing", "'s", "😀", "\r\n", "é", "0x"]
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(120))) for _ in range(60)]
    texts += ["", None, " ", "  ", "a", "a▁b", "plain text", "plain text", "\x00", "x" * 3000, "word\nnext line\n\n  indented " * 40, "日本" * 700, "trailing  ", "﻿ ﬁ ½"]
    return [*((i if i % 9 else None, t) for i, t in enumerate(texts)), (3, "same id"), (3, "same id")]


@pytest.mark.parametrize(("chunk", "rows"), [(1 << 20, 10**6), (200, 10**6), (37, 0)])
def test_documents(spark, docs, chunk, rows):
    table = spark.createDataFrame([(i, t, "x", "x", 1, "x", 2) for i, t in docs], SCHEMA)
    got = T.align_tokens(table, A, B, chunk=chunk, broadcast_rows=rows)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(docs)


def test_empty_table(spark):
    assert T.align_tokens(spark.createDataFrame([], SCHEMA), A, B).count() == 0


def test_monoid():
    """Any cuts of two token streams, composed in any order, give the digest of the whole."""
    r = random.Random(4)
    aligner = T.Aligner(90, 80)
    for _ in range(60):
        size = r.randrange(2, 60)
        streams = []
        for most in (90, 80):
            ends = np.array(sorted({*r.sample(range(1, size + 1), r.randrange(1, size)), size}))
            streams.append((np.array([r.randrange(most) for _ in ends]), ends))
        whole = T.Closed.of(T.Run(0, 0, *streams[0], *streams[1]), aligner)
        n = r.randrange(1, 6)
        cuts = [sorted([0, size, *(int(r.choice([0, *ends])) for _ in range(n - 1))]) for _, ends in streams]
        parts = []
        for a0, a1, b0, b1 in zip(cuts[0], cuts[0][1:], cuts[1], cuts[1][1:], strict=False):
            (a, ae), (b, be) = streams
            x, y = (ae > a0) & (ae <= a1), (be > b0) & (be <= b1)
            parts.append(T.Fragment.of(T.Run(a0, b0, a[x], ae[x], b[y], be[y]), aligner))
        while len(parts) > 1:
            k = r.randrange(len(parts) - 1)
            parts[k : k + 2] = [parts[k].plus(parts[k + 1], aligner)]
        got = parts[0].closed
        assert (got.n_a, got.n_b, got.n_groups, got.text) == (whole.n_a, whole.n_b, whole.n_groups, whole.text)
        assert got.pairs.tolist() == whole.pairs.tolist() and got.links.tolist() == whole.links.tolist()
        assert not len(parts[0].head.a) and not len(parts[0].tail.a)
