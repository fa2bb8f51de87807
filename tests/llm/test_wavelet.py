"""Wavelet matrices by brute force, and files against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer
from weft.llm import wavelet
from weft.llm.common import shared_dir

PATH = P.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = [None, "", " ", "a  b", "a   b", "x\n y", "x \n", "don't  stop ", "é ü 日本 语", " lead", "two words", "  x", "a  b", "tail\t", "<|endoftext|> x", "hello <|endoftext|> world", "a<|endoftext|><|endoftext|>b c", "<|endoftext |> <|endoftext", "word " * 30_000 + "<|endoftext|>", "it's 'twas we'll", "! !! !!!"]


def test_matrix():
    rng = np.random.default_rng(5)
    for n, top in ((0, 1), (1, 1), (7, 2), (513, 5), (3000, 50_257), (1024, 70_000), (200_000, 3), (131_072, 50_257)):
        ids = rng.integers(0, top, n)
        m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids).to_bytes())
        assert m.ids().tolist() == ids.tolist()
        for i in rng.integers(0, max(n, 1), 20 if n else 0).tolist():
            c = int(ids[i])
            places = np.flatnonzero(ids == c)
            k = int(np.searchsorted(places, i))
            assert m.access(i) == c and m.rank(c, i) == k and m.select(c, k) == i and m.count(c) == len(places) and m.select(c, len(places)) == -1
        assert m.count(1 << 20) == 0


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_files(spark, monkeypatch):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice(["a", "b", " ", "\n", "word", "'s", ".", "é"]) for _ in range(rng.randrange(40))) for _ in range(200)]
    rows = [(i * 3 - 40, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").repartition(3)
    path = shared_dir(spark)
    wavelet.write(df, path, PATH)
    got = {r.doc_id: r for r in wavelet.read_back(spark, path).collect()}
    start = 0
    for i, t in sorted(rows):
        ids = [*library(t), 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), repr(t)
        start += len(ids)
    shards = spark.read.parquet(path).orderBy("part", "shard").collect()
    assert library("hello <|endoftext|> world") == [31373, 220, 50256, 995]
    keys, sizes, m = wavelet.open_shard(bytes(shards[0].body))
    assert m.count(0) >= len(keys) and m.access(int(sizes[0]) - 1) == 0 and len(spark.read.parquet(path).inputFiles()) == len(shards)


def test_repeated_and_empty(spark):
    path = shared_dir(spark)
    wavelet.write(spark.createDataFrame([(1, "b"), (1, "a"), (None, "c")], "doc_id long, text string"), path, PATH)
    assert sorted((str(r.doc_id), r.start) for r in wavelet.read_back(spark, path).collect()) == [("1", 2), ("1", 4), ("None", 0)]
    path = shared_dir(spark)
    wavelet.write(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert wavelet.read_back(spark, path).count() == 0


def test_one_id_is_not_one_task(spark):
    path = shared_dir(spark)
    wavelet.write(spark.createDataFrame([(7, f"text {i % 600}") for i in range(3000)], "doc_id long, text string"), path, PATH)
    rows = wavelet.read_back(spark, path)
    assert spark.read.parquet(path).select("part").distinct().count() > 1
    got = sorted((r.start, r.n_tokens, r.ids_crc32) for r in rows.collect())
    start = 0
    for (at, n, crc), text in zip(got, sorted(f"text {i % 600}" for i in range(3000))):
        ids = [*library(text), 0]
        assert (at, n, crc) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += n
