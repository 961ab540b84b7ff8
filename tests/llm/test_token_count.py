import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestrand.llm import token_count as tc


@pytest.fixture(scope="module")
def machine():
    return tc.transducer(tc.tokenizer_path())


def counts(machine, texts):
    raw = [t.encode() for t in texts]
    return machine.count(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


def library(texts):
    t = Tokenizer.from_file(tc.tokenizer_path())
    return [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


PARTS = ["'", " ", "\n", "\t", "s", "t", "re", "ve", "ll", "d", "'re", "'r", "'l", " '", "!", "12", "é", "中", "　", " ", "<|endoftext|>", "<|endof", "  ", "Hello", "😀", "\r\n", "ab", "aaaa"]


def test_as_the_library(machine):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 30))) for _ in range(4000)]
    texts += ["", " ", "a" * 5000, " " * 3000, "<|endoftext|>" * 3, "'re" * 400, "x<|endoftext", "|>y", "word " * 3000]
    assert counts(machine, texts).tolist() == library(texts)


def test_random_characters(machine):
    rnd = random.Random(2)
    kinds = [(32, 126), (0, 0x2FF), (0x3000, 0x9FFF), (0x1F300, 0x1F6FF)]
    texts = ["".join(chr(rnd.randint(*rnd.choice(kinds))) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    assert counts(machine, texts).tolist() == library(texts)


def test_state_maps_compose(machine):
    s = machine.split
    rng = np.random.default_rng(0)
    for _ in range(50):
        seq = rng.integers(0, 23, 40)
        m, state = s.of_class[seq[0]], np.arange(tc.STATES)
        for c in seq[1:]:
            m = s.product[m, s.of_class[c]]
        for c in seq:
            state = s.next[state, c]
        assert s.maps[m].tolist() == state.tolist()


def test_operator_cases(spark):
    rows = [(1, None, 5), (2, "", 6), (3, "Hello world", 7), (3, "Hello world", 7), (4, "long word " * 20000, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = tc.with_token_counts(docs)
    assert out.columns == ["doc_id", "text", "n_tokens"]
    got = sorted((r.doc_id, r.n_tokens) for r in out.collect())
    assert got[:4] == [(1, 0), (2, 0), (3, 2), (3, 2)]
    assert got[4][1] == library(["long word " * 20000])[0]
    assert tc.with_token_counts(docs.limit(0)).count() == 0
    assert tc.with_token_counts(docs.withColumn("text", F.lit(None).cast("string"))).agg(F.sum("n_tokens")).first()[0] == 0


def test_long_pieces(machine):
    rnd = random.Random(6)
    texts = ["a" * 257, "ab" * 700, "é" * 900, "中" * 400, " " * 2000 + "x", "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5000)), "!" * 3000, "=" * 1000 + "word " + "z" * 300, "1" * 800]
    assert counts(machine, texts).tolist() == library(texts)


def test_ten_megabytes_of_one_letter(machine):
    """The library's time grows with the square of a piece, so it is asked about a shorter one: a token takes a whole number of letters."""
    start = time.process_time()
    many = counts(machine, ["a" * 10_000_000])[0]
    assert time.process_time() - start < 60
    short = library(["a" * 10_240, "a" * 20_480])
    assert short[1] == 2 * short[0] and many == short[0] * 10_000_000 // 10_240 + (0 if short[0] * 10_000_000 % 10_240 == 0 else library(["a" * (10_000_000 % 10_240)])[0] - (short[0] * (10_000_000 % 10_240)) // 10_240)


def test_query_columns(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "é" * 600), (4, "word " * 513), (5, "word " * 511), (5, "word " * 511), (None, "<|endoftext|> x")]
    spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, n_tokens int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in tc.op1_token_counts(spark, str(tmp_path)).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=str)
    n = library([t or "" for _, t in rows])
    assert got == sorted(((i, len((t or "").encode()), k, k > 512) for (i, t), k in zip(rows, n)), key=str)
