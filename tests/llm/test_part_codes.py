import hashlib
import random

import duckdb
import numpy as np

from lodestrand.llm import part_codes as pc

from ..conftest import SMALL


def brute(rows, parts=8, entries=16, rounds=6):
    """Lloyd's rounds in Python's numbers, each part compared with every entry."""
    kept = [(i, [int(np.floor(np.float64(x) * 4096)) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0], kept[k][1]))[:entries]
    books = [[cut[k][p] for k in order] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        own = [[near(c[p], books[p])[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                members = [cut[k][p] for k in range(len(cut)) if own[k][p] == e]
                if members:
                    books[p][e] = [sum(x) // len(members) for x in zip(*members)]
    final = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors, by_label = [sum(d for d, _ in f) for f in final], {}
    for (_, _, lab), e in zip(kept, errors):
        by_label[lab] = by_label.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in f), err, by_label[lab], digest) for (i, _, lab), f, err in zip(kept, final, errors)), key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    return sorted((tuple(r) for r in pc.coded(df, **kw).collect()), key=str)


def vectors(seed, n, dims=16, grid=None):
    rnd = np.random.default_rng(seed)
    v = rnd.normal(size=(n, dims)) if grid is None else rnd.integers(-grid, grid, size=(n, dims)) / 4096
    return [(int(k) * 3 % (2 * n + 1), v[k].astype(np.float32).tolist(), int(k) % 4 if k % 5 else None) for k in range(n)]


def test_random_vectors(spark):
    rows = vectors(1, 400)
    assert run(spark, rows) == brute(rows)


def test_ties_and_equal_entries(spark):
    """On a coarse grid many parts are as near to several entries, and entries are equal from the start."""
    rows = vectors(2, 300, grid=2)
    assert run(spark, rows) == brute(rows)


def test_broken_vectors(spark):
    rows = vectors(3, 40) + [(500, None, 1), (501, [float("nan")] + [0.0] * 15, 1), (-9, [float("inf")] * 16, 2), (502, [None] + [1.0] * 15, 1)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[-4:], rounds=1) == []


def test_few_and_repeated_rows(spark):
    rows = [(1, [0.5] * 8, 1), (1, [0.5] * 8, 1), (2, [-0.5] * 8, None)]
    assert run(spark, rows) == brute(rows)
    same = [(7, [0.1 * k for k in range(8)], None)] * 40
    assert run(spark, same, rounds=2) == brute(same, rounds=2)


def test_odd_shapes(spark):
    """Short vectors are filled up with zeros; huge components are kept in bounds; ids may be null."""
    short = [(k, [float(k)] * (3 + k % 4), k % 2) for k in range(30)]
    filled = [(k, v + [0.0] * (8 - len(v)), lab) for k, v, lab in short]
    assert run(spark, short, rounds=2) == brute(filled, rounds=2)
    got = run(spark, rounds=1, rows=[(None, [3e38] * 8, 1), (3, [-3e38] * 8, 1)])
    assert [r[1:3] for r in got] == [("00" * 8, 0), ("01" * 8, 0)]


def test_more_parameters(spark):
    rows = vectors(4, 200, dims=12)
    assert run(spark, rows, parts=3, entries=5, rounds=2) == brute(rows, 3, 5, 2)


def test_bounds_spare_scans_and_change_nothing():
    """Round by round the same codes as a full scan, and fewer and fewer scans."""
    rnd = np.random.default_rng(5)
    centres = rnd.integers(-4000, 4000, size=(16, 2, 4))
    vecs = centres[rnd.integers(16, size=3000)] + rnd.integers(-600, 600, size=(3000, 2, 4))
    books, kept, scans = pc.Codebooks(vecs[:16].transpose(1, 0, 2).copy()), (None, None, None), []
    for _ in range(8):
        *kept, scanned = pc.assign(books, vecs, *kept)
        scans.append(scanned)
        for p in range(2):
            d = pc.squared(vecs[:, p], books.entries[p])
            assert (kept[0][:, p] == d.argmin(axis=1)).all()
            own = np.sqrt(d[np.arange(len(d)), kept[0][:, p]])
            assert (kept[1][:, p] >= own).all()
            d[np.arange(len(d)), kept[0][:, p]] = 1 << 60
            assert (kept[2][:, p] <= np.sqrt(d.min(axis=1))).all()
        sums, counts = np.zeros_like(books.entries), np.zeros(books.entries.shape[:2], np.int64)
        for p in range(2):
            np.add.at(sums[p], kept[0][:, p], vecs[:, p])
            counts[p] = np.bincount(kept[0][:, p], minlength=16)
        books = books.after(sums, counts)
    assert scans[0] > 5900 and scans[-1] < 1500


def test_rounds_report_what_they_spared(spark):
    df = spark.createDataFrame(vectors(6, 500), "vec_id long, embedding array<float>, label int")
    _, _, figures = pc.train_codes(df)
    assert len(figures) == 7 and all(a + b == 500 * 8 for a, b in figures) and figures[-1][1] > figures[0][1]


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    want = con.execute(pc.oracle()).fetch_df()[["vec_id", "code", "error", "label_error", "codebooks_sha256"]]
    got = pc.op12_part_codes(spark, SMALL)
    assert sorted(map(tuple, want.values.tolist())) == sorted(tuple(r) for r in got.select(*want.columns).collect())


def test_clashing_columns(spark):
    df = spark.createDataFrame([(k, [random.Random(k).random()] * 8, 1, "x", 5) for k in range(30)], "vec_id long, embedding array<double>, label int, code string, sums int")
    assert pc.coded(df, rounds=1).count() == 30
