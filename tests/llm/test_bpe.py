"""Encoding against the tiktoken library, and exact round trips."""

import base64
import hashlib
import random

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from weft.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def oracle():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def hard_texts() -> list[str]:
    rng = random.Random(7)
    marks = ["'s", "'re", "'", "'ll", "'d", " ", "  ", "\n", "\t", " '", "a", "ab", "é", "ß", "12", "٣", "!?", "<|endoftext|>", " ", " ", "日本", "🙂", "x" * 70, "Zz", "'S", "\r\n", "\x1f", "\x00"]
    made = ["".join(rng.choice(marks) for _ in range(rng.randrange(30))) for _ in range(600)]
    return [*made, "", " ", "  ", "\n\n", "a" * 5000, "ab" * 3000, "don't 'tis we'll''s 's", "x  y   z \n w", "!" * 2000]


def encoded(texts):
    return [x for _, _, ids in bpe.encode_column(pa.array(texts), PATH) for x in ids]


def test_ids_match_library(oracle):
    import numpy as np

    texts = hard_texts()
    for text, ids in zip(texts, encoded(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == oracle.encode_ordinary(text), repr(text)


def test_queries_on_frames(spark, oracle):
    texts = [*hard_texts()[:60], None]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, token_ids string")
    done = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert len(done) == len(texts)
    for r in done:
        raw = (r.text or "").encode()
        assert bytes(r.decoded) == raw and r.token_ids == oracle.encode_ordinary(r.text or "")
        assert all(a <= b for a, b in zip(r.token_starts, r.token_starts[1:])) and (not raw or r.token_starts[0] == 0)
    for r in bpe.digests(df, PATH).collect():
        ids = oracle.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(df, PATH).count() == 0 and bpe.encode(df, PATH).count() == 0
