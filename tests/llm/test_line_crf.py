import itertools

import numpy as np

from lodestrand.llm import line_crf as lc


def test_marginals_and_gradient():
    rng = np.random.default_rng(0)
    bounds, pot, ties = np.array([0, 1, 5, 5, 12]), rng.normal(size=12), rng.normal(size=(2, 2))
    crf = lc.LineCrf(np.zeros(1), np.ones(1), np.zeros(1), ties)
    p, logz, joint = crf.marginals(pot, bounds, pairs=True)
    total, pairs = 0.0, np.zeros((2, 2))
    for a, b in zip(bounds, bounds[1:]):
        if a == b:
            continue
        weight = {s: np.exp(sum(pot[a + i] * x for i, x in enumerate(s)) + sum(ties[x, y] for x, y in zip(s, s[1:]))) for s in itertools.product((0, 1), repeat=b - a)}
        z = sum(weight.values())
        total += np.log(z)
        assert np.allclose(p[a:b], [sum(w for s, w in weight.items() if s[i]) / z for i in range(b - a)])
        for s, w in weight.items():
            for x, y in zip(s, s[1:]):
                pairs[x, y] += w / z
    assert np.isclose(logz, total) and np.allclose(joint, pairs)


def test_lines():
    texts = [b"", b"Ab cd\ncd", b"\n\n", b"x x x\n"]
    f, size, bounds = lc.line_features(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert np.diff(bounds).tolist() == [1, 2, 2, 1] and f.shape == (6, lc.FEATURES) and size.min() == 1
    alone = [lc.line_features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(f, np.concatenate(alone))


def test_held_out_accuracy(spark):
    out = lc.op6_line_crf_quality(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 40 and np.mean([r.predicted == r.quality for r in rows]) > 0.97


def test_cases(spark):
    good, bad = "The quick fox runs home, and it sleeps there.", "!!! $$$ ### !!! &&& %%%"
    docs = spark.createDataFrame([(i, (good if i % 2 else bad) + "\n" + good[: i % 30], i) for i in range(80)] + [(900, None, 0), (901, "", 0), (902, (good + "\n") * 3000, 0), (902, bad, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(1, 1), (5, None), (None, 1)], "doc_id long, quality int")
    model = lc.train(docs, labels)
    rows = lc.scored(docs, model).collect()
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == 84
    assert max(r.score for r in rows if r.text == bad) < min(r.score for r in rows if r.doc_id == 902 and r.text != bad)
    kept = lc.good_documents(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < 84
    none = lc.train(docs, labels.limit(0))
    assert {r.score for r in lc.scored(docs, none).collect()} == {0.5}
    assert lc.scored(docs.limit(0), model).count() == 0


def test_query_against_enumeration(spark, tmp_path):
    """Scores of the query as sums over all labelings of a document's lines; folds and threshold as the contract has them."""
    import itertools
    import zlib

    rnd = np.random.default_rng(4)
    word = lambda good: "mole" if good else "$$ 99"
    texts = {k: "\n".join(f"Line {word(k % 2)} {word(rnd.random() < 0.8)} {j}." for j in range(rnd.integers(1, 7))) for k in range(80)}
    texts |= {80: None, 81: "", 82: "\n", 83: texts[0]}
    spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(0, 70)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = lc.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    got = {r.doc_id: r for r in lc.op6_line_crf_quality(spark, str(tmp_path)).collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        b = np.frombuffer((t or "").encode(), np.uint8)
        f, size, _ = lc.line_features(b, np.array([0, len(b)]))
        potential = model.potentials(f)
        total, mass = 0.0, np.zeros(len(f))
        for labels in itertools.product((0, 1), repeat=len(f)):
            w = np.exp(sum(p for p, y in zip(potential, labels) if y) + sum(model.ties[a][z] for a, z in zip(labels, labels[1:])))
            total, mass = total + w, mass + w * np.array(labels)
        score = float((mass / total * size).sum() / size.sum())
        r = got[k]
        assert abs(r.score - score) < 1e-6 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0)


def odd_text(rng, n):
    words = ["The", "mole", "mole", "$$", "x", "Y9", "é", "", ", ."]
    return "".join(rng.choice(words) + rng.choice([" ", " ", "\n", "\t", "\r\n"]) for _ in range(n)).encode()


def some_model(rng):
    return lc.LineCrf(rng.normal(size=lc.FEATURES) * 0.1, rng.random(lc.FEATURES) + 0.5, rng.normal(size=lc.FEATURES) * 0.3, rng.normal(size=(2, 2)))


def test_windows_equal_whole_texts():
    """Windows may end anywhere, also in a line; a text's score is the same in windows, in a block and alone."""
    rng = np.random.default_rng(5)
    model = some_model(rng)
    for _ in range(60):
        texts = [odd_text(rng, int(n)) for n in rng.choice([0, 1, 3, 60], 4)]
        f, size, bounds = lc.line_features(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        scores = model.scores(f, size, bounds)
        for i, t in enumerate(texts):
            b = np.frombuffer(t, np.uint8)
            alone = model.scores(*lc.line_features(b, np.array([0, len(b)])))[0]
            assert alone == scores[i]
            for step in (1, 2, 7, 1000):
                assert np.array_equal(np.concatenate([g for g, _ in lc.text_features(b, step)]), f[bounds[i] : bounds[i + 1]])
                assert abs(model.text_score(b, step) - scores[i]) < 1e-9


def test_memory_of_a_long_text():
    """20 MB of short lines in one text: beyond the text, windows and twelve bytes for each line (and eight for each that is new)."""
    import tracemalloc

    model = some_model(np.random.default_rng(6))
    for t in (b"ab cd ef\n" * 2_200_000, b"the mole digs " * 1_500_000, b"x" * 20_000_000):
        b = np.frombuffer(t, np.uint8)
        tracemalloc.start()
        assert 0 <= model.text_score(b) <= 1
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 250 << 20


def test_sample_of_lines(spark):
    assert lc.level([1, 5, 9], 100) == 9 and lc.level([1, 5, 9], 11) == 5 and lc.level([1, 5, 9], 9) == 4 and lc.level([], 5) == 1
    for n, most in ((5, 5), (100, 50), (100, 3), (10**7, 1000)):
        parts = lc.chosen(n, most)
        assert parts[0][0] == 0 and parts[-1][1] == (n if n <= most or most > 1 else 1) and sum(b - a for a, b in parts) <= max(most, n if n <= most else 0)
        assert all(a[1] <= b[0] for a, b in zip(parts, parts[1:]))
    good, bad = "The quick fox runs home, and it sleeps there.", "!!! $$$ ### !!! &&& %%%"
    docs = spark.createDataFrame([(i, "\n".join([good if i % 2 else bad] * (1 + i % 40 * 20))) for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    model = lc.train(docs, labels, max_lines=500)
    assert all((r.score > 0.5) == (r.doc_id % 2 == 1) for r in lc.scored(docs, model).collect())
