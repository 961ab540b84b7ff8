"""Documents without a doc_id."""

from lodestrand.llm import ngram_join as nj
from lodestrand.llm import suffix_dedup as sd

ONE = "the mole digs a long tunnel under the old garden wall and sleeps there all winter"
TWO = "a bat hangs from the roof of the cave and hears every moth that flies by at night"
THREE = "seven grey geese cross the wide river before dawn while nobody on the shore looks up"
ROWS = [(1, ONE), (None, ONE), (None, TWO), (None, TWO), (None, THREE), (None, ""), (None, None), (5, "short")]


def frame(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


def test_components(spark):
    rows = sorted(((r.doc_id, r.n_shingles > 0, r.component_id) for r in nj.similar_components(frame(spark), 3, 90).collect()), key=str)
    assert rows == sorted([(1, True, 1), (5, True, 5), (None, True, 1), *[(None, True, None)] * 3, *[(None, False, None)] * 2], key=str)


def test_keep_one(spark):
    rows = sorted(((r.doc_id, r.text) for r in nj.keep_one(frame(spark)).collect()), key=str)
    assert rows == sorted([(1, ONE), (5, "short"), (None, TWO), (None, THREE), (None, ""), (None, None)], key=str)


def test_suffixes(spark):
    rows = [(r.doc_id, r.n_bytes, r.n_removed) for r in sd.without_repeats(frame(spark), keep_text=False).collect()]
    a, b, c = len(ONE), len(TWO), len(THREE)
    want = [(1, a, 0), (None, a, a), (None, b, 0), (None, b, b), (None, c, 0), (None, 0, 0), (None, 0, 0), (5, 5, 0)]
    assert sorted(rows, key=str) == sorted(want, key=str)
