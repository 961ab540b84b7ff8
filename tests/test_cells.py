"""Similar pairs and nearest neighbours by pivot cells, against plain comparisons."""

import numpy as np
import pytest

from lodestrand.operators import cells, vectors


def table(spark, v, groups=None, **kw):
    rows = [(k, x if x is None else [float(c) for c in x], None if groups is None else groups[k]) for k, x in enumerate(v)]
    return spark.createDataFrame(rows, "id long, vector array<double>, groups array<string>").repartition(3)


def clumps(seed, n, dims=6, centres=12, spread=0.15):
    rnd = np.random.default_rng(seed)
    return (rnd.normal(size=(centres, dims))[rnd.integers(centres, size=n)] + spread * rnd.normal(size=(n, dims))).tolist()


def cosines(v):
    m = np.array([np.zeros(len(v[0])) if x is None else x for x in v])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    m = m / np.where(n == 0, 1, n)
    return np.round(m @ m.T, 9)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(cells, "BLOCK", 16)


@pytest.mark.parametrize("threshold,exclude", [(0.9, "equal"), (0.2, "overlap"), (-0.5, "equal")])
def test_similar_pairs(spark, small, threshold, exclude):  # V4, J11, J12
    v = clumps(1, 150)
    v[7], v[9], v[20] = [0.0] * 6, None, v[21]
    groups = [["A", "B"], ["B"], ["A"], ["B", "A"]]
    own = [groups[k % 4] for k in range(len(v))]
    got = vectors.similar_pairs(table(spark, v, own), threshold, exclude).collect()
    c, want = cosines(v), {}
    for i in range(len(v)):
        for j in range(i + 1, len(v)):
            g, h = set(own[i]), set(own[j])
            if 9 not in (i, j) and c[i, j] >= threshold and not (g == h if exclude == "equal" else g & h):
                want[i, j] = round(c[i, j], 4)
    assert {(r.a, r.b): r.score for r in got} == pytest.approx(want) and len(got) == len(want)


def test_cells_are_left_out(spark, small):
    """Of vectors in clumps few pairs are compared, and each pair meets once."""
    v = clumps(2, 400, spread=0.02)
    work = cells.PairPlan(table(spark, v), 0.95).work()
    assert work["rows"] == 400 and work["compared"] < work["all"] / 3
    every = cells.PairPlan(table(spark, v), -1.0).work()
    assert every["compared"] == every["all"] == 400 * 399 // 2


def test_pairs_of_text_ids_and_empty_tables(spark, small):
    rows = spark.createDataFrame([("b", [1.0, 0.0], ["x"]), ("a", [1.0, 0.1], ["y"]), ("a", [1.0, 0.1], ["y"])], "id string, vector array<float>, groups array<string>")
    assert [(r.a, r.b) for r in vectors.similar_pairs(rows, 0.9).collect()] == [("a", "b")] * 2
    assert vectors.similar_pairs(rows.limit(0), 0.9).count() == 0 and cells.PairPlan(rows.limit(0), 0.9).work()["all"] == 0


def plain(v, q, k, metric, by=None):
    out = {}
    for i in q:
        scored = []
        for j, x in enumerate(v):
            if x is None or (by and by[i] != by[j]):
                continue
            a, b = np.array(v[i]), np.array(x)
            s = a @ b / ((np.linalg.norm(a) + 1e-10) * (np.linalg.norm(b) + 1e-10)) if metric == "cosine" else ((a - b) ** 2).sum()
            scored.append((-round(s, 6) if metric == "cosine" else round(s, 6), j))
        out[i] = [(j, abs(s)) for s, j in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("metric,k,spread", [("cosine", 5, 0.1), ("l2", 9, 0.1), ("l2", 40, 1.0)])
def test_nearest(spark, small, metric, k, spread):  # W1, J14, V2
    v = clumps(3, 200, spread=spread)
    v[3], v[50], v[60] = v[4], None, [0.0] * 6
    rows = table(spark, v).select("id", "vector")
    q = [0, 3, 60, *range(100, 140)]
    got = {}
    for r in vectors.nearest(rows.where(rows.id.isin(q)).withColumnRenamed("id", "query_id"), rows, k, metric).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    want = plain(v, q, k, metric)
    assert {i: [j for j, _ in x] for i, x in got.items()} == {i: [j for j, _ in x] for i, x in want.items()}
    assert all(abs(abs(s) - t) < 2e-6 for i in q for (_, s), (_, t) in zip(got[i], want[i]))


def test_nearest_by_value(spark, small):
    v = clumps(4, 120)
    by = [f"g{k % 3}" if k % 10 else "h" for k in range(120)]
    rows = spark.createDataFrame([(k, x, by[k]) for k, x in enumerate(v)], "id long, vector array<double>, specie string")
    q = rows.where("id in (0, 1, 2, 30)").withColumnRenamed("id", "query_id")
    got = {}
    for r in vectors.nearest(q, rows, 15, "l2", by="specie").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {i: [j for j, _ in x] for i, x in plain(v, (0, 1, 2, 30), 15, "l2", by).items()} and len(got[0]) == 12


def test_plans_have_no_nested_loops(spark, small):
    rows = table(spark, clumps(5, 60)).select("id", "vector")
    for out in (vectors.nearest(rows.withColumnRenamed("id", "query_id"), rows, 3), vectors.similar_pairs(rows.selectExpr("*", "array('a') as groups"), 0.9)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_few_rows(spark):
    rows = table(spark, [[1.0, 0.0], [0.0, 1.0]]).select("id", "vector")
    q = rows.withColumnRenamed("id", "query_id")
    assert sorted((r.query_id, r.id, r["rank"]) for r in vectors.nearest(q, rows, 10).collect()) == [(0, 0, 1), (0, 1, 2), (1, 0, 2), (1, 1, 1)]
    assert vectors.nearest(q, rows.limit(0), 3).count() == 0 and vectors.nearest(q.limit(0), rows, 3).count() == 0


def test_scores_are_rounded_once(spark):
    """a cosine just below the threshold or a half stays below, as in SQL."""
    on = lambda c: [c, float(np.sqrt(1 - c * c))]
    rows = spark.createDataFrame([(0, [1.0, 0.0], ["x"]), (1, on(0.3 - 2e-10), ["y"]), (2, on(0.32545 - 2e-10), ["y"]), (3, on(0.32555 + 2e-10), ["y"])], "id long, vector array<double>, groups array<string>")
    got = {(r.a, r.b): r.score for r in vectors.similar_pairs(rows, 0.3).collect()}
    assert got == {(0, 2): 0.3254, (0, 3): 0.3256}


def test_pairs_of_many_blocks(spark, small, monkeypatch):
    """cells of several blocks, few cells: each pair once, with what its ends carry, and rows are sent a bounded number of times."""
    monkeypatch.setattr(cells, "PAIR_BLOCK", 16)
    monkeypatch.setattr(cells, "PAIR_CELLS", 3)
    v = clumps(4, 200, spread=1.0)
    rows = table(spark, v, [["A"] if k % 3 else ["B"] for k in range(200)]).selectExpr("*", "concat('n', id) as name")
    c = cosines(v)
    want = {(i, j, f"n{i}", f"n{j}") for i in range(200) for j in range(i + 1, 200) if c[i, j] >= 0.4 and (i % 3 == 0) != (j % 3 == 0)}
    got = vectors.similar_pairs(rows, 0.4, carry=("name",)).collect()
    assert {(r.a, r.b, r.name_a, r.name_b) for r in got} == want and len(got) == len(want)
    monkeypatch.setattr(cells, "PAIR_BLOCK", 4096)
    assert cells.PairPlan(rows, 0.4).meetings().count() <= 200 * 4
