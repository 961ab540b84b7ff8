"""Cases where less than the whole job was done."""

from collections import Counter

from lodestrand.llm import hamming_search as hs
from lodestrand.llm import line_crf as lc
from lodestrand.llm import source_mix as sm


def test_training_sees_late_lines(spark):
    head = "\n".join(f"Line {k} of a text like any other." for k in range(60))
    tail = {1: "\nThe mole sleeps under the wall.", 0: "\n$$$ 111 ||| 222 ###"}
    docs = spark.createDataFrame([(k, head + tail[k % 2] * 90) for k in range(60)], "doc_id long, text string")
    model = lc.train(docs, spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int"))
    score = {r.doc_id: r.score for r in lc.scored(docs, model).collect()}
    assert min(score[k] for k in range(1, 60, 2)) > max(score[k] for k in range(0, 60, 2)) + 0.3


def test_documents_without_words_stay(spark):
    rows = [(0, "some words here", "a")] + [(k, " " * (k % 3), "a") for k in range(1, 21)] + [(30, None, "a"), (31, "b", "b")]
    out = sm.mix_rows(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {r.doc_id for r in out.collect()} == {r[0] for r in rows}


def test_repeated_vectors(spark):
    v = lambda n: [1.0] * n + [-1.0] * (64 - n)
    rows = [(0, v(20))] * 8 + [(k, v(20 + k)) for k in range(1, 6)] + [(3, v(23))] * 4
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = hs.top_k(df, df.where("vec_id = 0"), 4).collect()
    assert Counter((r.rank, r.id, r.distance) for r in got) == Counter((k, k, k) for k in range(1, 5))


def test_long_vectors_count_in_full(spark):
    df = spark.createDataFrame([(k, [1.0] * 64 + [float(k)]) for k in range(3)], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.id, r.distance) for r in hs.top_k(df, df, 2).collect())
    assert got == [(0, 1, 1, 1), (0, 2, 2, 1), (1, 1, 2, 0), (1, 2, 0, 1), (2, 1, 1, 0), (2, 2, 0, 1)]
