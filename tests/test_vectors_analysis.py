import numpy as np

from lodestrand.operators import analysis, vectors
from lodestrand.sources import readers, writers
from lodestrand.streaming import incremental


def test_similar_pairs(spark):  # V4
    v = {"p": [1.0, 0.0], "q": [1.0, 0.01], "z": [0.0, 0.0], "r": [1.0, 0.0]}
    rows = spark.createDataFrame([("p", v["p"], ["A", "B"]), ("q", v["q"], ["A"]), ("r", v["r"], ["B", "A"]), ("z", v["z"], ["C"])], "id string, vector array<double>, groups array<string>")
    got = {(r.a, r.b) for r in vectors.similar_pairs(rows, 0.9, cells=3).collect()}
    assert got == {("p", "q"), ("q", "r")}  # equal sets are left out, sets that overlap are not
    assert {(r.a, r.b) for r in vectors.similar_pairs(rows, 0.9, "overlap").collect()} == set()


def mmr_order(query, vectors, k, weight=0.5):
    """V3 as a plain loop: indexes of k vectors."""
    if not len(vectors):
        return []

    def unit(m):
        n = np.linalg.norm(m, axis=-1, keepdims=True)
        return m / np.where(n == 0, 1, n)

    v = unit(np.asarray(vectors, np.float64))
    to_query, worst, chosen = np.round(v @ unit(np.asarray(query, np.float64)), 9), np.full(len(v), -np.inf), []
    for _ in range(min(k, len(v))):
        value = np.round(weight * to_query - (1 - weight) * worst, 9) if chosen else to_query.copy()
        value[chosen] = -np.inf
        chosen.append(int(np.argmax(value)))
        worst = np.maximum(worst, np.round(v @ v[chosen[-1]], 9))
    return chosen


def test_mmr(spark):  # V3
    d = np.array([[1, 0], [0.99, 0.1], [0, 1.0]])
    assert mmr_order(np.array([1, 0.2]), d, 2) == [1, 2] and mmr_order(np.array([1, 0]), d, 9, 1.0) == [0, 1, 2]
    rnd = np.random.default_rng(1)
    rows, want = [], {}
    for g, n in (("a", 30), ("b", 3), ("c", 12)):
        v, q = rnd.normal(size=(n, 5)), rnd.normal(size=5)
        v[n // 2] = v[0]
        rows += [(g, 100 - k, float(k // 2), v[k].tolist(), q.tolist(), k) for k in range(n)]
        order = sorted(range(n), key=lambda k: (k // 2, 100 - k))
        want[g] = [order[i] for i in mmr_order(q, v[order], 8)]
    df = spark.createDataFrame(rows, "specie string, id long, distance double, vector array<double>, query array<double>, left int").repartition(3)
    got = {}
    for r in vectors.mmr(df, "specie", 8).orderBy("specie", "place").collect():
        got.setdefault(r.specie, []).append(r.left)
    assert got == want
    assert vectors.mmr(df.limit(0), "specie", 8).count() == 0
    none = spark.createDataFrame([("a", k, float(k), v, [1.0, 0.0]) for k, v in enumerate([None, [0.0, 1.0], None, [1.0, 0.0]])], "specie string, id long, distance double, vector array<double>, query array<double>")
    assert [r.id for r in vectors.mmr(none, "specie", 4).orderBy("place").collect()] == [3, 1, 0, 2]
    plan = vectors.mmr(df, "specie", 8)._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Arrow" not in plan and "Python" not in plan


def test_retrieval_steps(spark):  # D3, P11, W7, W8
    a = spark.createDataFrame([(1, "g", 0.5, "x")], "id int, grp string, distance double, c string")
    b = spark.createDataFrame([(1, "g", 0.2, "y"), (2, "g", 0.9, "z")], "id int, grp string, distance double, c string")
    both = vectors.united_candidates(a, b, ["id", "grp"])
    assert sorted((r.id, r.distance, r.c) for r in both.collect()) == [(1, 0.2, "y"), (2, 0.9, "z")]
    assert [r.id for r in vectors.within_margin(both, "grp").collect()] == [1]
    many = spark.range(12).selectExpr("id", "'d' as doc_id", "'g' as grp", "double(id) as distance")
    assert vectors.per_document(many, ["grp"]).count() == 10 and vectors.nearest_share(many, "grp").count() == 8
    keys = spark.createDataFrame([("d", "s", 1, "c"), (None, "s", 1, "c"), (None, None, None, "c")], "doc_id string, source_path string, chunk_index int, content string")
    assert [r.k.split("|")[0] for r in keys.select(vectors.candidate_key().alias("k")).collect()] == ["doc_id", "source_path", "content_hash"]


def test_drift(spark):  # A11, F16
    rows = spark.createDataFrame([(1, "t", "a"), (2, "t", "a"), (2, "t", "b"), (3, "t", None), (1, "one", "a"), (1, "none", None), (2, "none", None)], "run int, trait string, source string")
    got = {r.trait: (r.mean_pairwise_jaccard, r.mean_vs_union_jaccard) for r in analysis.citation_drift(rows).collect()}
    assert got == {"t": (0.167, 0.5), "one": (1.0, 1.0)}
    assert {r.trait: r.n_runs for r in analysis.trait_frequency(rows).collect()} == {"t": 3, "none": 2, "one": 1}


def test_drift_of_random_runs(spark):  # A11, J18
    import itertools
    import random

    rnd = random.Random(2)
    sets = {(t, r): {f"s{x}" for x in rnd.sample(range(6), rnd.choice([0, 0, 1, 2, 4]))} for t in "abcdefg" for r in range(rnd.randrange(1, 7))}
    rows = [(r, t, s) for (t, r), x in sets.items() for s in (x or {None})] * 2
    want = {}
    for t in "abcdefg":
        own = [x for (u, _), x in sets.items() if u == t]
        every = set().union(*own)
        if every:
            like = lambda x, y: 1.0 if not x | y else len(x & y) / len(x | y)
            pairs = [like(x, y) for x, y in itertools.combinations(own, 2)] or [1.0]
            want[t] = (len(own), len(every), sum(pairs) / len(pairs), sum(len(x) / len(every) for x in own) / len(own))
    got = {r.trait: tuple(r)[1:] for r in analysis.citation_drift(spark.createDataFrame(rows, "run int, trait string, source string")).collect()}
    assert got.keys() == want.keys() and all(abs(a - b) < 6e-4 for t in got for a, b in zip(got[t], want[t]))


def test_groups(spark):  # A12, U8
    g = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "b")], "group string, trait string")
    f = spark.createDataFrame([("a", 2), ("b", 3), ("c", 1)], "trait string, n int")
    assert {r.group: r.n for r in analysis.group_counts(g, f).collect()} == {"x": 5, "y": 3}
    assert {r.trait: r.n_groups for r in analysis.ungrouped(g, f).collect()} == {"b": 2, "c": 0}


def test_sources(spark, tmp_path):  # S1, S6, S18, S19, P14
    p = tmp_path / "species.json"
    p.write_text('[{"canonical": " Talpa ", "aliases": ["mole"]}, {"canonical": " ", "aliases": []}]')
    assert [(r.species_norm, r.aliases) for r in readers.species_file(spark, str(p)).collect()] == [("talpa", ["mole"])]
    p.write_text('{"a": 1}')
    try:
        readers.species_file(spark, str(p)).collect()
        raise AssertionError
    except Exception as e:
        assert "array" in str(e)
    xml = spark.createDataFrame([("<a><body><p>One</p> two</body></a>",), ("<html>",), (None,)], "x string")
    assert [r[0] for r in xml.select(readers.article_body("x")).collect()] == ["One two", None, None]
    run = tmp_path / "r1.json"
    run.write_text('```json\n{"strict_common_traits": [{"trait": "a", "sources": ["s"], "confidence": 1}], "subgroup_common_traits": [], "mechanism_hypotheses": [{"trait": "b"}]}\n```')
    assert sorted(r.trait for r in readers.run_files(spark, str(run)).collect()) == ["a", "b"]
    tsv = tmp_path / "c.tsv"
    tsv.write_text("Gene\tBirch #\tQn\tN insertions\tSpecies\nG\t1\t0.5\t2\ta, b, a\n")
    assert readers.candidate_sets(spark, str(tsv)).first().n_unique == 2
    good = '{"strict_common_traits": [{"trait": " x ", "sources": ["", "s"], "confidence": "7"}, {"trait": ""}], "subgroup_common_traits": [], "mechanism_hypotheses": []}'
    v = spark.createDataFrame([(good,), ('{"strict_common_traits": []}',)], "j string").select(readers.validated_synthesis("j").alias("v")).collect()
    assert [(t.trait, t.sources, t.confidence) for t in v[0].v.strict_common_traits] == [("x", ["s"], 1.0)] and v[1].v is None


def test_rest_source(spark):  # S4
    def fetch(query, page):
        return [{"id": f"{query}{page}", "title": "t"}] if page < 2 else {"error": 1}

    spark.dataSource.register(readers.rest_source("papers_test", "id string, title string", fetch))
    assert sorted(r.id for r in spark.read.format("papers_test").option("query", "q").option("pages", 3).load().collect()) == ["q0", "q1"]


def test_sinks(spark, tmp_path):  # K2, K6, K7, K11
    path = str(tmp_path / "t")
    writers.upsert(spark.createDataFrame([("a", 1, "r1")], "k string, v int, run_id string"), path, ["k"])
    writers.upsert(spark.createDataFrame([("a", 2, "r2"), ("b", 3, "r1")], "k string, v int, run_id string"), path, ["k"])
    assert sorted((r.k, r.v) for r in writers.read(spark, path).collect()) == [("a", 2), ("b", 3)]
    writers.clear_run(spark, path, "r1")
    assert [r.k for r in writers.read(spark, path).collect()] == ["a"]
    g = str(tmp_path / "g")
    writers.graphml(spark.createDataFrame([("n<1", "a&b")], "id string, label string"), spark.createDataFrame([("n<1", "n<1", "A"), ("n<1", "n<1", "B")], "src string, dst string, kind string"), g)
    import xml.dom.minidom

    text = "\n".join(r.value for r in spark.read.text(g).collect())
    doc = xml.dom.minidom.parseString(text)
    assert len(doc.getElementsByTagName("edge")) == 1 and doc.getElementsByTagName("node")[0].getAttribute("id") == "n<1"


def test_index_stream(spark, tmp_path):  # I1, A18
    src, table, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    text = "A mole digs. It lives under the old garden wall, and it sleeps there all winter long! Then it wakes up? Yes, in spring it does."
    one = spark.createDataFrame([("a", text), ("a", text), ("b", text), ("j", "Fig. 1"), ("n", None)], "chunk_id string, content string")

    def run(**kw):
        incremental.index_stream(spark.readStream.schema(one.schema).parquet(src), table, ck, **kw).awaitTermination()
        return {r.status: r.n for r in incremental.status_counts(spark.read.parquet(table)).collect()}

    one.coalesce(1).write.mode("append").parquet(src)
    assert run() == {"indexed": 2, "skipped": 1, "junk": 2}
    # a restart on its checkpoint knows what was indexed
    one.union(spark.createDataFrame([("c", text)], one.schema)).coalesce(1).write.mode("append").parquet(src)
    assert run() == {"indexed": 3, "skipped": 6, "junk": 2}
    assert run() == {"indexed": 3, "skipped": 6, "junk": 2}


def test_index_stream_tries_again(spark, tmp_path):  # I3
    src, table, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    text = " A mole digs. It lives under the old garden wall, and it sleeps there all winter long! Then it wakes up? Yes, in spring it does."
    rows = spark.createDataFrame([(k, k + text) for k in ("bad", "worse", "good")], "chunk_id string, content string")

    def run(*bad):
        def call(t):
            if t.startswith(bad):
                raise RuntimeError("no server")

        rows.coalesce(1).write.mode("append").parquet(src)
        incremental.index_stream(spark.readStream.schema(rows.schema).parquet(src), table, ck, call=call).awaitTermination()
        return {(r.chunk_id, r.status): r.n for r in spark.read.parquet(table).groupBy("chunk_id", "status").sum("n").withColumnRenamed("sum(n)", "n").collect()}

    first = run("bad", "worse")
    assert first == {("bad", "retry"): 1, ("worse", "retry"): 1, ("good", "indexed"): 1}
    assert run("worse") == first | {("bad", "indexed"): 1, ("worse", "failed"): 1, ("good", "skipped"): 1}


def test_flags(spark):  # I3
    e = spark.createDataFrame([("1", None, None), ("2", None, None), ("3", True, True)], "entity_id string, upheno_enriched boolean, upheno_mapped boolean")
    r = spark.createDataFrame([("1", True), ("2", False)], "entity_id string, mapped boolean")
    assert {x.entity_id: (x.upheno_enriched, x.upheno_mapped) for x in incremental.marked(e, r).collect()} == {"1": (True, True), "2": (True, False), "3": (True, True)}
