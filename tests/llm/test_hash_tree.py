from collections import Counter

import zlib

from lodestrand.llm import hash_tree as ht


def test_slots_sizes_and_growth(spark):
    rows = [(i, "é" * (i % 5)) for i in range(3000)] + [(None, None), (7, "again"), (7, "again")]
    got = ht.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 16, slices=8).collect()
    assert len(got) == len(rows) and {r.shard for r in got} == set(range(16))
    for s in range(16):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 16) for r in got) and any(r.grown_shard == 16 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[3].size == 7 and by_id[3].text_crc32 == zlib.crc32("ééé".encode()) and by_id[None].size == 1


def test_growth_at_many_sizes(spark):
    ids = spark.range(800).selectExpr("cast(id as string) as k")
    from pyspark.sql import functions as F

    held = ids.select(*[ht.place(F.col("k"), ht.topology(n)).alias(f"n{n}") for n in range(15, 21)]).collect()
    for r in held:
        for n in range(16, 20):
            assert r[f"n{n + 1}"] in (r[f"n{n}"], n)


def test_movement_stays_in_changed_subtree(spark):
    from pyspark.sql import functions as F

    heavy = lambda w: ht.Node("root", tuple(ht.Node(f"g{g}", tuple(ht.Node(f"g{g}.s{s}", shard=g * 2 + s, own_weight=w if g == 1 and s == 0 else 1.0) for s in range(2))) for g in range(3)))
    k = F.col("id").cast("string")
    rows = spark.range(4000).select(ht.place(k, heavy(1.0)).alias("a"), ht.place(k, heavy(3.0)).alias("b")).collect()
    assert all(r.a == r.b or r.b // 2 == 1 for r in rows)
    share = Counter(r.b for r in rows)
    assert abs(share[2] / 4000 - 3 / 8) < 0.04


def test_empty(spark):
    assert ht.assign_shards(spark.createDataFrame([], "doc_id long, text string, slot int")).count() == 0
