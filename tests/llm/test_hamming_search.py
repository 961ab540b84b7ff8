import random

import numpy as np

from lodestrand.llm import hamming_search as hs


def test_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(250, 64)).astype(float)
    v[50:120] = v[7]
    v[130] = -v[7]
    v[131:160] = v[3] * np.where(rng.random((29, 64)) < 0.05, -1, 1)
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)] + [(900, None, 1), (None, v[0].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, distance int")
    got = {}
    for r in hs.top_k(df, df.where("vec_id % 25 = 0 or vec_id = 900"), 6).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.distance))
    bits = v > 0
    for q in range(0, 250, 25):
        want = sorted(((bits[q] != bits[i]).sum(), i) for i in range(250) if i != q)[:6]
        assert sorted(got.pop(q)) == [(k + 1, i, d) for k, (d, i) in enumerate(want)]
    assert not got


def test_few_rows(spark):
    df = spark.createDataFrame([(i, [float(random.random()) - 0.5 for _ in range(64)]) for i in range(4)], "vec_id long, embedding array<double>")
    assert hs.top_k(df, df.where("vec_id = 0"), 10).count() == 3
    assert hs.top_k(df.limit(0), df.limit(0), 10).count() == 0


def nearest(v, dims, queries, k):
    bits = np.zeros((len(v), dims), bool)
    for i, x in enumerate(v):
        bits[i, : len(x)] = np.nan_to_num(np.asarray(x)) > 0
    return {q: sorted((int((bits[q] != bits[i]).sum()), i) for i in range(len(v)) if i != q)[:k] for q in queries}


def test_any_number_of_dimensions(spark):
    """Fewer than 64, more, and vectors of different lengths."""
    rng = np.random.default_rng(2)
    for dims in (5, 40, 65, 130):
        v = [rng.normal(size=dims - (i % 3 if dims > 5 else 0)).tolist() for i in range(120)]
        v[3] = [float("nan")] * dims
        df = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")
        got = {}
        for r in hs.top_k(df, df.where("vec_id % 40 = 0"), 4).collect():
            got.setdefault(r.query_id, []).append((r.distance, r.id))
        assert {q: sorted(x) for q, x in got.items()} == nearest(v, dims, (0, 40, 80), 4)


def test_segments_cover_all_bits():
    for dims in (1, 7, 64, 65, 200):
        for codes in (1, 300, 10**6, 10**12):
            parts = hs.segments(dims, codes)
            assert sorted(j * 64 + at + i for j, at, bits in parts for i in range(bits)) == list(range(dims)) and max(b for *_, b in parts) <= hs.MOST_BITS


def test_repeated_rows(spark):
    v = [[1.0, -1.0, 1.0], [1.0, -1.0, 1.0], [1.0, 1.0, 1.0], [-1.0, 1.0, -1.0]]
    rows = [(0, v[0])] * 5 + [(1, v[1]), (2, v[2]), (3, v[3]), (3, v[3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.rank, r.id, r.distance) for r in hs.top_k(df, df.where("vec_id = 0"), 2).collect())
    assert got == [(1, 1, 0), (2, 2, 1)]
