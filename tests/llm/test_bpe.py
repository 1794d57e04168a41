import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from apilattice.llm import bpe

RANKS = bpe.load_ranks()
ENC = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PARTS = ["a", "'", "re", "'ll", " ", "  ", "\n", "\t", "é", "1", "22", "!", "??", "the ", "   x", "aaaaaaaaaaaaaaaaaaaa", "         ", "😀", "\u00a0", "\u3000", "\x1c", "中文"]


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


@pytest.mark.parametrize("chunk, overlap", [(5, 5), (8, 12), (13, 8), (30, 12)])
def test_stitching(chunk, overlap):
    rnd, coder = random.Random(chunk), bpe.Coder(RANKS, chunk, overlap)
    for _ in range(400):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(1, 90)))
        parts = []
        for s in range(0, len(text), chunk):
            piece = text[s : s + chunk + overlap]
            parts.append((s, piece, *coder.part(piece, s, s + chunk >= len(text))))
        assert ids(coder.stitch(parts)) == ENC.encode_ordinary(text)


def test_whole_texts_and_decoding(spark):
    rnd = random.Random(1)
    texts = [None, "", " ", "<|endoftext|>", "x" * 3000, " " * 500, "".join(rnd.choice(PARTS) for _ in range(3000)), "dup", "dup"]
    df = spark.createDataFrame([(k, t, 1, "i") for k, t in enumerate(texts)] + [(None, "no id", 1, "i")], "doc_id bigint, text string, uid int, ids string")
    got = bpe.decode(bpe.encode(df, chunk=100, overlap=20)).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        text = "no id" if r.doc_id is None else texts[r.doc_id] or ""
        assert ids(r.ids) == ENC.encode_ordinary(text) and bytes(r.raw) == text.encode()
    assert bpe.digests(df.limit(0)).collect() == []


def test_digests(spark):
    (r,) = bpe.digests(spark.createDataFrame([(1, "Hello, wörld!")], "doc_id bigint, text string")).collect()
    want = np.array(ENC.encode_ordinary("Hello, wörld!"), "<u4")
    assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(want.tobytes()).hexdigest())
    assert r.decoded_sha256 == hashlib.sha256("Hello, wörld!".encode()).hexdigest()
