"""Decoding from ids, ids of other types, and words of great length."""

import gc
import random
import time

from tilewright.llm import bpe, queries


def test_long_words_take_linear_time():
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    own, rng = bpe.TrieBPE(path), random.Random(4)
    word = "".join(rng.choice("etaoinshrdlu") for _ in range(300_000))
    began = time.perf_counter()
    ids = own.encode(word)
    assert time.perf_counter() - began < 15
    assert ids == Tokenizer.from_file(path).encode(word, add_special_tokens=False).ids


def test_decoding_reads_ids(spark):
    path = queries.vocabulary()
    df = spark.createDataFrame([("a", "Hello there", 1), (None, None, 2), ("a", "Hello there", 1)], "doc_id string, text string, n_tokens int")
    encoded = bpe.encode(df, path)
    assert encoded.columns == ["doc_id", "ids", "n_tokens"]
    assert sorted((r.doc_id or "", r.text) for r in bpe.decode(encoded, path).collect()) == [("", ""), ("a", "hello</w> there</w>"), ("a", "hello</w> there</w>")]
    other = spark.createDataFrame([("a", " ".join(encoded.where("doc_id = 'a'").first().ids.split()[::-1]))], "doc_id string, ids string")
    assert bpe.decode(other, path).first().text == "there</w> hello</w>"
    assert bpe.digest(df, path).count() == 3 and gc.isenabled()
