import math
from collections import Counter, defaultdict

from lodestrand.llm import source_mix as sm


def totals(spark, **t):
    return spark.createDataFrame(list(t.items()), "src string, tokens long")


def test_entropy_and_limit(spark):
    t = {"a": 1000, "b": 100, "c": 10}
    rows = {r.src: r for r in sm.source_weights(totals(spark, **t), 0.8, 1000.0, 1.0).collect()}
    w = [rows[k].weight for k in t]
    assert abs(sum(w) - 1) < 1e-9 and abs(-sum(x * math.log(x) for x in w) - 0.8 * math.log(3)) < 1e-6
    rows = {r.src: r for r in sm.source_weights(totals(spark, **t), 1.0, 3.0, 1.0).collect()}
    assert max(r.quota / r.tokens for r in rows.values()) <= 3.0 and rows["c"].quota >= 29
    rows = sm.source_weights(totals(spark, **t), None, 2.0, None).collect()
    assert all(1 <= r.quota / r.tokens <= 2.000001 for r in rows) and min(r.quota / r.tokens for r in rows) < 1.001
    assert sm.source_weights(totals(spark, a=5), 0.5, 4.0, 1.0).collect()[0].quota == 5
    assert sm.source_weights(totals(spark, a=5).limit(0)).count() == 0


def test_copies(spark):
    rows = [(i, "big" if i < 400 else "small" if i < 450 else None, 1 + i % 7) for i in range(460)] + [(900, "empty", 0)]
    df = spark.createDataFrame(rows, "row_key long, source string, n_tokens long")
    got = sm.mixed(df, 0.9, 3.0, 1.0, block_rows=32, mix_tokens=200).collect()
    plan = {r.src: r for r in sm.source_weights(df.groupBy(sm.F.coalesce("source", sm.F.lit("")).alias("src")).agg(sm.F.sum("n_tokens").alias("tokens")).where("tokens > 0"), 0.9, 3.0, 1.0).collect()}
    drawn, spans = defaultdict(int), defaultdict(list)
    for r in got:
        drawn[r.src] += r.n_tokens
        spans[r.src].append((r.start_token, r.n_tokens))
    for s, p in plan.items():
        assert p.quota <= drawn[s] < p.quota + 7
        at = 0
        for start, n in sorted(spans[s]):  # without gaps or overlaps
            assert start == at
            at += n
    epochs = Counter((r.row_key, r.epoch) for r in got)
    assert max(epochs.values()) == 1 and (900, 0) in epochs
    share = defaultdict(lambda: defaultdict(int))
    for r in got:
        share[r.mix_block][r.src] += r.n_tokens
    for b in share.values():
        total = sum(b.values())
        assert abs(b["big"] / total - plan["big"].weight) < 0.12


def test_rows_keep_all(spark):
    rows = [(i, f"w{i} x y", "big" if i % 10 else "small", i) for i in range(300)] + [(7, "w7 x y", "big", 7), (500, None, "big", 0), (501, "", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, epoch long")
    out = sm.mix_rows(df)
    n = Counter((r.doc_id, r.text) for r in out.collect())
    assert out.columns == df.columns and set(n) == {(r[0], r[1]) for r in rows}
    assert all(c in ((2, 4) if k[0] == 7 else (1, 2)) for k, c in n.items())
    assert sm.mix_rows(df.limit(0)).count() == 0
