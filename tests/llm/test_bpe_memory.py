"""Bytes that an encoding pass holds."""

import tracemalloc

import pyarrow as pa
import public_tokenizers

from weft.llm import bpe


def test_encoding_holds_few_texts_at_once():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    texts = ["the words of text number %d, and some more of them. " % (k % 50) * 200 for k in range(200)]  # 2 MB
    bpe.merger(path), bpe.classes()
    tracemalloc.start()
    got = sum(len(ids) for _, _, rows in bpe.encode_column(pa.array(texts), path) for ids in rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    whole = sum(len(ids) for text in texts for _, _, rows in bpe.encode_column(pa.array([text]), path) for ids in rows)
    assert got == whole and peak < 90e6, peak


def test_a_worker_keeps_no_vocabulary_and_no_cache_when_its_task_ends():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def run(batches):
        for texts in batches:
            yield from bpe.encode_column(texts, path)
            assert bpe._MERGERS

    assert len(list(bpe.forgotten(run)([pa.array(["some words"])]))) == 1 and not bpe._MERGERS
