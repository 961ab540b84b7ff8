"""The pipeline's stages, one after the other, against plain versions."""

import pytest

from lodestrand.llm import queries

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = corpus_pipeline.load(spark, SMALL, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs = corpus_pipeline.staged(stage(spark, docs, SMALL), name)
        if name != "encode":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good = {r.doc_id: r.text for r in seen["quality"].collect()}
    largest = {}
    for i, t in good.items():
        largest[t] = max(i, largest.get(t, -1))
    assert {r.doc_id for r in seen["exact"].collect()} == set(largest.values())
    from tests.llm.test_ngram_join import brute

    comp = brute([(i, t) for t, i in largest.items()], 5, 80)
    near = {r.doc_id for r in seen["near"].collect()}
    assert near == {c for _, c in comp.values()}
    assert {r.doc_id for r in seen["mix"].collect()} == near
    assert seen["encode"].count() == seen["mix"].count() and seen["encode"].where("not round_trip").count() == 0


ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, row struct<a:int>, row_key string, times int, _key long, key string, digest binary, token_ids string, _line_crf_score int, _id int"


def odd_rows():
    more = (0.5, (1,), "k", 2, 3, "x", b"d", "t", 4, 5)
    good = "The mole digs a long tunnel under the wall and sleeps there all winter, says the old book."
    texts = [(1, good), (2, good), (2, good), (None, good), (3, None), (4, ""), (5, " \n "), (None, None), (6, good * 3000), (7, "a b"), (8, "a b")]
    return [(i, t, None if k % 3 else "en", None if k % 2 else "src", None, *more) for k, (i, t) in enumerate(texts)]


@pytest.mark.parametrize("name", [s[0] for s in corpus_pipeline.STAGES])
def test_stage_on_odd_rows(spark, name):
    """Nulls in any column, empty and long texts, repeated rows, clashing names, and no rows at all."""
    stage = dict(corpus_pipeline.STAGES)[name]
    df = spark.createDataFrame(odd_rows(), ODD)
    for docs in (df, df.limit(0)):
        out = stage(spark, docs, SMALL)
        rows = out.collect()
        assert out.columns == (docs.columns if name != "encode" else [c for c in docs.columns if c != "token_ids"] + ["token_ids", "round_trip"])
        if docs is not df:
            assert rows == []
        elif name == "exact":
            assert sorted((r.doc_id or 0, r.text or "") for r in rows) == sorted((i, t or "") for i, t in [(2, odd_rows()[0][1]), (4, ""), (5, " \n "), (6, odd_rows()[8][1]), (8, "a b")])
        elif name == "near":
            assert sorted((r.doc_id if r.doc_id is not None else -1) for r in rows) == [-1, 1, 3, 4, 5, 6, 7]
        elif name == "mix":
            assert {(r.doc_id, r.text) for r in rows} == {(r[0], r[1]) for r in odd_rows()} and len(rows) >= 11
        elif name == "encode":
            assert len(rows) == 11 and all(r.round_trip for r in rows)
        else:
            good = {r.text for r in rows}
            assert [r.text for r in df.collect()].count(odd_rows()[0][1]) == 4 and sum(r.text == odd_rows()[0][1] for r in rows) in (0, 4) and good <= {r[1] for r in odd_rows()}


def test_all_queries_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))
    assert set(queries.SQL) <= set(queries.QUERIES)
