import random

from pyspark.sql import functions as F

from lodestrand.llm import digest_index as di


def test_rows(spark):
    rows = [(5, "a", 1), (3, "a", 1), (9, None, 1), (2, "", 1), (4, "b", 1), (4, "b", 1), (8, "é" * 50000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in di.exact_duplicates(df).collect())
    assert got == [(2, 9, 2, False), (3, 5, 2, False), (4, 4, 2, True), (4, 4, 2, True), (5, 5, 2, True), (8, 8, 1, True), (9, 9, 2, True)]
    kept = di.keep_rows(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [4, 5, 8, 9]
    assert di.exact_duplicates(df.limit(0)).count() == 0 and di.keep_rows(df.limit(0)).count() == 0


def test_batches_against_brute_force(spark, tmp_path):
    rnd, path = random.Random(2), str(tmp_path / "index")
    every = []
    for call in range(3):
        rows = [(rnd.randrange(1000), rnd.choice(["", None, *"abcdefgh"]) if rnd.random() < 0.7 else str(rnd.random())) for _ in range(120)]
        every += rows
        groups = {}
        for i, t in every:
            groups.setdefault(t or "", []).append(i)
        want = sorted((i, max(groups[t or ""]), len(groups[t or ""])) for i, t in rows)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        for batches in (1, 3):
            own = path if batches == 3 else None
            got = sorted((r.doc_id, r.keep_id, r.group_size) for r in di.exact_duplicates(df, own, 4, batches).collect())
            assert got == (want if own or not call else sorted((i, max(j for j, u in rows if (u or "") == (t or "")), sum((u or "") == (t or "") for _, u in rows)) for i, t in rows))


def test_later_batches_meet_the_index(spark):
    """The anti-join drops what the index holds."""
    path_of = di.fresh_path(spark, "test-index")
    index = di.DigestIndex(spark, path_of, 4)
    rows = spark.range(300).selectExpr("id as doc_id", "cast(id % 50 as string) as text").select("doc_id", di.text_digest().alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("batch"))
    assert index.ingest(rows.where("batch = 0")).count() > 0 and index.ingest(rows.where("batch = 1")).count() < 50
    assert index.rows().count() == 50 and index.rows().where("group_size = 6").count() == 50
    index.close()


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", "x", 1), (2, "a", "y", 2), (None, "b", None, 3), (None, "b", None, 4)], "doc_id long, text string, key string, digest int")
    kept = di.keep_rows(df)
    assert kept.columns == df.columns and sorted((r.doc_id is None, r.text) for r in kept.collect()) == [(False, "a"), (True, "b")]


def test_hot_digest(spark):
    df = spark.range(9000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same', cast(id as string)) as text")
    out = di.exact_duplicates(df)
    assert out.count() == 9000 and out.where("kept").count() == 6001
    assert out.where("group_size = 3000 and keep_id = 8997").count() == 3000


def test_persistent_index(spark, tmp_path):
    path = str(tmp_path / "index")
    first = di.DigestIndex(spark, path, 4)
    text = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", di.text_digest().alias("digest"))
    assert first.ingest(text((1, "a"), (2, "b"))).count() == 2
    first.close()
    again = di.DigestIndex(spark, path, 4)
    assert again.ingest(text((3, "b"), (4, "c"), (5, "c"))).select("keep_id", "group_size").collect() == [(5, 2)]
    # of equal texts the largest doc_id stays, over all batches
    assert sorted((r.keep_id, r.group_size) for r in again.rows().collect()) == [(1, 1), (3, 2), (5, 2)]
    plan = again.rows()._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.lower()


def test_the_anti_join_decides(spark, monkeypatch):
    """Without it a digest of two batches has two rows; keep_id is that of the row that passed."""
    rows = [(k, "abcdefgh"[k % 8]) for k in range(40)] + [(None, "a"), (None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.keep_id or -1, r.group_size) for r in di.exact_duplicates(df).collect()) == sorted([(-1, 1), *[(32, 6)] * 6, *[(32 + k, 5) for k in range(1, 8) for _ in range(5)]])
    plain = type(df).join
    monkeypatch.setattr(type(df), "join", lambda self, other, on=None, how=None: self if how == "left_anti" else plain(self, other, on, how))
    assert di.exact_duplicates(df).count() > len(rows)


def test_batches_fall(spark):
    df = spark.createDataFrame([(k // 3,) for k in range(90)] + [(None,)] * 3, "doc_id long")
    for batches in (1, 2, 5):
        parts = [[r.doc_id for r in df.where(c).collect()] for c in di.falling(df, batches)]
        assert len(parts) == batches and sum(map(len, parts)) == 93
        known = [[i for i in p if i is not None] for p in parts]
        assert all(min(a) > max(b) for a, b in zip(known, known[1:])) and None in parts[-1]
    assert [c is not None for c in di.falling(df.limit(0), 2)] == [True]
