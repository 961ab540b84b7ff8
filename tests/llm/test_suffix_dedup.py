import hashlib
import random

import numpy as np

from lodestrand.llm import suffix_dedup as sd

L = sd.LENGTH


def brute(rows):
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for k in range(len(b) - L + 1):
            first.setdefault(b[k : k + L], i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - L + 1):
            if first[b[k : k + L]] < i:
                gone[k : k + L] = b"\1" * L
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1])), hashlib.sha256(kept).hexdigest(), kept)
    return out


def corpus(seed):
    rnd = random.Random(seed)
    text = lambda n, letters: "".join(rnd.choice(letters) for _ in range(n))
    pool = [text(n, a) for n in (20, 49, 50, 51, 90, 300) for a in ("ab", "abcdefgh é")] + ["a" * 200, "ab" * 90, "\0" * 120]
    rows = []
    for _ in range(60):
        rows.append("".join(rnd.choice(pool) if rnd.random() < 0.7 else text(rnd.randint(0, 80), "abcdexyz") for _ in range(rnd.randint(0, 5))))
    rows += [rows[3], rows[3] + "x", None, "", "a" * 49, "a" * 50, "a" * 51, "a" * 50]
    order = list(range(len(rows)))
    rnd.shuffle(order)
    return list(zip(order, rows))


def test_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, marks string").repartition(5)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in sd.without_repeats(df).collect()}
        assert got == brute(rows)


def test_cover():
    d = {(a - b) % sd.V for a in sd.COVER for b in sd.COVER}
    assert d == set(range(sd.V))


def minima(contexts, at, doc):
    least, owner, offset = sd.suffix_minima(contexts, np.zeros(len(contexts), np.int64), at, doc)
    out = [[None] * (len(c) - L + 1) for c in contexts]
    for m, i, k in zip(least, owner, offset):
        out[i][k] = m
    return out


def test_minima_of_one_bucket():
    rng = np.random.default_rng(0)
    base = rng.integers(97, 99, 140).astype(np.uint8)
    contexts = []
    for _ in range(30):
        c = base.copy()
        c[rng.integers(0, 140, 2)] = 120
        contexts.append(c[: rng.integers(60, 140)].tobytes())
    doc = rng.permutation(30)
    got = minima(contexts, np.full(30, 17), doc)
    for i, c in enumerate(contexts):
        for k in range(len(c) - L + 1):
            assert got[i][k] == min(doc[j] for j, o in enumerate(contexts) if o[k : k + L] == c[k : k + L])


def test_empty_and_repeated_rows(spark):
    assert sd.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    t = "0123456789" * 7
    got = sorted((r.doc_id, r.n_removed) for r in sd.without_repeats(spark.createDataFrame([(1, t), (1, t), (2, t)], "doc_id long, text string")).collect())
    assert got == [(1, 0), (1, 0), (2, 70)]


def test_split_anchors(spark, monkeypatch):
    """Anchors whose suffixes go alone, to blocks of the order of suffixes."""
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = {i: v[:4] for i, v in brute(rows).items()}
    for runs in (1, 12):
        monkeypatch.setattr(sd, "SPLIT_RUNS", runs)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.without_repeats(df, keep_text=False).collect()}
        assert got == want


def test_query_columns(spark, tmp_path):
    rows = corpus(4)
    spark.createDataFrame([(i, t, "de") for i, t in rows], "doc_id long, text string, anchor string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.op5_suffix_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: v[:4] for i, v in brute(rows).items()}


def test_cover_decides():
    """Suffixes that part only after V bytes, or only after LENGTH."""
    base = bytes(range(65, 65 + 60)) * 2
    contexts = [base[:80], base[:49] + b"!" + base[50:80], base[:50] + b"!" + base[51:80], base[:32] + b"?" + base[33:80]]
    got = minima(contexts, np.full(4, 20), np.array([3, 2, 1, 0]))
    for i, c in enumerate(contexts):
        for k in range(len(c) - L + 1):
            assert got[i][k] == min([3, 2, 1, 0][j] for j, o in enumerate(contexts) if o[k : k + L] == c[k : k + L])
