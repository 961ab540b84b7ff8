import json
import math
import random

from lodestrand.operators import extract, graph, mapping, reach, tiers
from lodestrand.plans import context


def df(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def edges(spark, *pairs):
    return df(spark, "child_id string, parent_id string", *(pairs or [("a", "b")]))


def test_closure_with_cycle(spark):  # H3, A2
    got = {(r.child_id, r.parent_id) for r in graph.transitive_closure(edges(spark, ("a", "b"), ("b", "c"), ("c", "b"), ("x", None))).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c"), ("c", "b"), ("b", "b"), ("c", "c")}
    fan = {r.term_id: r.fan_in for r in graph.fan_in(edges(spark, ("T1", "A"), ("T1", "ROOT"), ("T2", "A"), ("T2", "ROOT"))).collect()}
    assert fan == {"A": 2, "ROOT": 2}


def test_ancestors(spark):  # H1, H2
    up = edges(spark, ("HP:1", "HP:2"), ("HP:2", "HP:3"), ("HP:3", "HP:4"), ("HP:4", "HP:5"), ("HP:1", "CL:9"), ("CL:9", "HP:8"), ("HP:1", "HP:3"))
    start = df(spark, "term_id string", ("HP:1",))
    assert {(r.ancestor, r.depth) for r in graph.ancestors(up, start, 3).collect()} == {("HP:2", 1), ("HP:3", 1), ("HP:4", 2), ("HP:5", 3)}
    assert {r.ancestor for r in graph.closure_within(up, start, 1).collect()} == {"HP:1", "HP:2", "HP:3", "CL:9"}


def test_upserts(spark):  # K2, K4, K6
    old, new = df(spark, "k string, v string", ("a", "1"), ("b", "")), df(spark, "k string, v string", ("b", "2"), ("c", "3"))
    assert sorted((r.k, r.v) for r in graph.keep_latest(old, new, ["k"]).collect()) == [("a", "1"), ("b", "2"), ("c", "3")]
    newer = df(spark, "k string, v string", ("a", "9"), ("b", "2"))
    assert sorted((r.k, r.v) for r in graph.fill_blank(old, newer, "k", "v").collect()) == [("a", "1"), ("b", "2")]
    runs = df(spark, "run_id string, e int", ("r1", 1), ("r2", 2), (None, 3))
    assert sorted(r.e for r in graph.without_run(runs, "r1").collect()) == [2, 3]


def test_extraction(spark):  # U1, P3, P4, D1, F10, F11
    raw = "<think>x</think>```json\n" + json.dumps({"entities": [{"text": "ab", "type": "Gene"}, {"text": "eye", "type": "Anatomy"}, {"text": "Eye", "type": "Anatomy"}, {"text": "rock", "type": "Stone"}, {"text": "blind", "type": "Phenotype"}], "triples": [{"subj_idx": "1", "relation": "CAUSES", "obj_idx": 4}, {"subj_idx": 0, "relation": "CAUSES", "obj_idx": 1}, {"subj_idx": 1, "relation": "LIKES", "obj_idx": 4}, {"subj_idx": 1, "relation": "CAUSES", "obj_idx": 99}]}) + "\n```"
    out = extract.parsed(df(spark, "chunk_id string, species_norm string, raw string", ("c", "s", raw), ("d", "s", "no json"), ("e", "s", None)))
    ents = extract.valid_entities(out)
    assert sorted((r.chunk_id, r.surface_form) for r in ents.collect()) == [("c", "blind"), ("c", "eye")]
    ids = {r.surface_form: r.entity_id for r in ents.collect()}
    got = extract.valid_triples(out, ents).collect()
    assert [(r.subj_id, r.relation_type, r.obj_id) for r in got] == [(ids["eye"], "CAUSES", ids["blind"])]
    compat = extract.valid_triples(out, ents, "compat").collect()
    assert [(r.subj_id, r.obj_id) for r in compat] == [(ids["eye"], ids["blind"])]  # 0 and 1 of what is left


def test_collapse(spark):  # H6, J10
    counts = df(spark, "species_norm string, entity_id string, surface_form string, entity_type string, mention_count long", ("s", "1", "eye", "Anatomy", 2), ("s", "2", "eyes", "Gene", 3), ("s", "3", "ear", "Anatomy", 1), ("s", "4", "fin", "Anatomy", 1))
    mapped = df(spark, "entity_id string, term_id string, term_name string", ("1", "T", ""), ("2", "T", ""), ("3", "U", "Ear"))
    got = {r.surface_form: (r.entity_type, r.mention_count) for r in graph.collapsed_entities(counts, mapped).collect()}
    assert got == {"T  (merged 2 forms)": ("Gene", 5), "ear": ("Anatomy", 1), "fin": ("Anatomy", 1)}
    triples = df(spark, "species_norm string, subject string, relation string, object string", ("s", "eye", "r", "ear"), ("s", "eyes", "r", "ear"))
    assert [(r.subject, r.object) for r in graph.rewritten_triples(triples, counts, mapped).collect()] == [("T", "ear")]


def test_score(spark):  # W2, F17
    rows = df(spark, "term_id string, n_species long, n_forms long, fan_in long", ("a", 8, 1, 8000), ("b", 8, 1, 200), ("c", 4, 1, 5), ("d", 4, 1, -1))
    got = [(r.term_id, r.score) for r in tiers.tier1_ranked(rows, 8).collect()]
    want = {"a": 0.0, "b": math.log(8001 / 201), "c": 0.5 * math.log(8001 / 6), "d": 1.0}
    assert [t for t, _ in got] == ["b", "c", "d", "a"] and all(abs(s - want[t]) < 1e-5 for t, s in got)


def greedy_clusters(rows, min_species, limit=30):
    """H4 as a plain loop over the pairs in order."""
    home, clusters = {}, {}
    for n, r in enumerate(sorted(rows, key=lambda r: (-len(r["species"]), -r["score"], r["eid_a"], r["eid_b"]))):
        a, b = home.get(r["eid_a"]), home.get(r["eid_b"])
        if a is not None and b is not None:
            if a != b:  # unites two, and gives nothing
                keep, gone = min(a, b), max(a, b)
                other = clusters.pop(gone)
                clusters[keep] = tuple(x | y for x, y in zip(clusters[keep], other))
                home |= dict.fromkeys(other[0], keep)
            continue
        at = n if a is None and b is None else a if a is not None else b
        members, species, pairs = clusters.get(at, (set(), set(), set()))
        clusters[at] = members | {r["eid_a"], r["eid_b"]}, species | set(r["species"]), pairs | {(r["eid_a"], r["eid_b"])}
        home[r["eid_a"]] = home[r["eid_b"]] = at
    kept = [c for _, c in sorted(clusters.items()) if len(c[1]) >= min_species]
    return sorted(kept, key=lambda c: (-len(c[1]), -len(c[2])))[:limit]


def clustered(spark, rows, min_species, limit=30):
    edges = spark.createDataFrame([(r["eid_a"], r["eid_b"], r["score"], r["species"]) for r in rows], "eid_a string, eid_b string, score double, species array<string>")
    labels = tiers.components(edges)
    clusters = tiers.tier2_clusters(edges, labels, min_species, limit)
    members = {}
    for r in tiers.cluster_members(clusters, labels).collect():
        members.setdefault(r.cluster, set()).add(r.entity_id)
    return [(members[r.cluster], set(r.species), r.n_pairs, r.n_members) for r in clusters.orderBy("cluster").collect()]


def test_clusters(spark):  # H4
    pair = lambda a, b, s, sp="xy": {"eid_a": a, "eid_b": b, "score": s, "species": list(sp)}
    assert clustered(spark, [pair("a", "b", 0.9), pair("c", "d", 0.8), pair("b", "c", 0.7, "xz"), pair("f", "g", 0.9), pair("g", "h", 0.8), pair("f", "h", 0.7)], 2) == [(set("abcd"), {"x", "y"}, 2, 4), (set("fgh"), {"x", "y"}, 2, 3)]
    assert clustered(spark, [], 2) == []


def test_clusters_of_random_graphs(spark):  # H4, W5
    import random

    rnd = random.Random(8)
    for n, m, sp in ((60, 45, 3), (40, 120, 9)):
        seen = {tuple(sorted(rnd.sample(range(n), 2))) for _ in range(m)}
        rows = [{"eid_a": f"e{a:02}", "eid_b": f"e{b:02}", "score": rnd.randrange(78, 83) / 100, "species": sorted(rnd.sample("abcdefghi"[:sp], rnd.randrange(2, 4)))} for a, b in seen]
        for least, limit in ((2, 30), (4, 3)):
            want = [(c[0], c[1], len(c[2]), len(c[0])) for c in greedy_clusters(rows, least, limit)]
            assert clustered(spark, rows, least, limit) == want


def test_cluster_lines(spark):  # F21, W12
    edges = spark.createDataFrame([("a", "b", 0.9, ["x", "y"]), ("b", "c", 0.8, ["x", "y"])], "eid_a string, eid_b string, score double, species array<string>")
    labels = tiers.components(edges)
    names = spark.createDataFrame([(x, x * 2) for x in "abc"], "entity_id string, surface_form string")
    shown = tiers.with_shown_members(tiers.tier2_clusters(edges, labels, 2), labels, names, 2)
    assert [r.line for r in shown.select(context.tier2_line().alias("line")).collect()] == ["- aa, bb: 2 species, score 0.900"]


def test_components_agree(spark):  # H4 membership
    rows = df(spark, "eid1 string, sf1 string, eid2 string, sf2 string, score double, sp1 string, sp2 string", *[(a, a, b, b, 0.9, "x", "y") for a, b in (("a", "b"), ("b", "c"), ("d", "e"), ("bone", "bones"))])
    got = {r.entity_id: r.component for r in tiers.tier2_components(rows, 2).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}


def test_mapping(spark):  # V6, U2, U3, H7
    import numpy as np

    vec = {"same": [1, 0, 0], "near": [0.8, 0.6, 0], "low": [0.65, 0, 0.76], "far": [0, 0, -1.0], "term": [1, 0, 0], "parent": [0, 1, 0]}
    embed = lambda texts: np.array([vec[t] for t in texts], np.float32)
    terms = df(spark, "id string, name string, parents array<string>, embedding array<float>", ("HP:1", "term", ["HP:2", "HP:404"], [1.0, 0.0, 0.0]), ("HP:2", "parent", [], [0.0, 1.0, 0.0]))

    def verify(trait, candidates):
        if trait == "low" and candidates[0]["id"] == "HP:1":
            return {"confidence": "low", "term_id": "HP:1"}
        return {"confidence": "medium", "term_id": candidates[0]["id"]}

    forms = df(spark, "raw_trait string", ("same",), ("near",), ("low",), ("far",), (None,))
    got = {r.raw_trait: (r.confidence, r.term_id, r.mapped, r.broadened) for r in mapping.map_forms(forms, terms, embed, verify).collect()}
    assert got == {"same": ("high", "HP:1", True, False), "near": ("medium", "HP:1", True, False), "low": ("medium", "HP:2", True, True), "far": ("no_match", None, False, False)}

    def broken(trait, candidates):
        raise RuntimeError

    bad = {r.raw_trait: (r.confidence, r.clean) for r in mapping.map_forms(forms, terms, embed, broken).collect()}
    assert bad["near"] == ("no_match", False) and bad["same"] == ("high", True)


def test_fan_in_of_random_graphs(spark):  # A2, H3
    import random

    rnd = random.Random(5)
    for n, m in ((25, 30), (40, 110)):
        pairs = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)} | {(k, k - 1) for k in range(1, n // 2)}
        below = {k: set() for k in range(n)}
        for k in range(n):
            todo = [k]
            while todo:
                at = todo.pop()
                for c, p in pairs:
                    if p == at and c not in below[k]:
                        below[k].add(c)
                        todo.append(c)
        want = {f"t{k:02}": len(x - {k}) for k, x in below.items() if x - {k}}
        got = reach.descendant_counts(edges(spark, *[(f"t{c:02}", f"t{p:02}") for c, p in pairs], (None, "t01"), ("t01", None)))
        assert {r.term_id: r.fan_in for r in got.collect()} == want
        plain = graph.transitive_closure(edges(spark, *[(f"t{c:02}", f"t{p:02}") for c, p in pairs])).where("child_id <> parent_id").groupBy("parent_id").count()
        assert {r.parent_id: r["count"] for r in plain.collect()} == want
    assert reach.descendant_counts(edges(spark).limit(0)).count() == 0


def test_components_of_cycles(spark):  # H3
    rows = df(spark, "c string, p string", ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("x", "a"), ("f", "g"))
    got = {r.term: r.component for r in reach.cycle_components(rows).collect()}
    assert {t: {u for u in got if got[u] == got[t]} for t in got} == {**dict.fromkeys("abc", {"a", "b", "c"}), **dict.fromkeys("de", {"d", "e"})}


def test_memo_spares_calls(spark, tmp_path):  # I4, K10
    from lodestrand.sources.snapshots import SnapshotTable

    terms = df(spark, "id string, name string, parents array<string>, embedding array<float>", ("HP:1", "term", [], [1.0, 0.0]))
    embed = lambda texts: [[0.8, 0.6]] * len(texts)
    memo = SnapshotTable(spark, str(tmp_path / "memo"), ["raw_trait", "model"])
    forms = df(spark, "raw_trait string", ("a",), ("b",), ("b",), (None,))

    def broken(trait, candidates):
        if trait == "b":
            raise RuntimeError("no server")
        return {"confidence": "high", "term_id": "HP:1"}

    got = lambda out: {r.raw_trait: (r.confidence, r.from_memo) for r in out.collect()}
    assert got(mapping.map_with_memo(forms, terms, embed, broken, memo)) == {"a": ("high", False), "b": ("no_match", False)}

    def once(trait, candidates):
        if trait == "a":
            raise RuntimeError("asked again")
        return {"confidence": "medium", "term_id": "HP:1"}

    # what failed is asked again, what is known isn't
    assert got(mapping.map_with_memo(forms, terms, embed, once, memo)) == {"a": ("high", True), "b": ("medium", False)}

    def none(trait, candidates):
        raise RuntimeError("no calls")

    assert got(mapping.map_with_memo(forms, terms, embed, none, memo)) == {"a": ("high", True), "b": ("medium", True)}
    assert got(mapping.map_with_memo(forms, terms, embed, none, memo, model="other"))["a"] == ("no_match", False)
    assert memo.read().count() == 2


def joined_rows(df):
    """Rows that each join of a plan made, after df was computed."""
    plan, out = df._jdf.queryExecution(), []
    df._jdf.collectToPython()  # this plan itself runs, so that its figures are there

    def walk(node):
        if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
            out.append(node.metrics().apply("numOutputRows").value())
        inner = node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.plan() if "QueryStage" in node.nodeName() else None
        below = [inner] if inner is not None else [node.children().apply(k) for k in range(node.children().size())]
        for b in below:
            walk(b)

    walk(plan.executedPlan())
    return out


def members_of(rows):
    return {(x[3], y[3]) for x in rows for y in rows if None not in (*x[:3], *y[:3]) and x[0] == y[0] and x[1] != y[1] and x[2] != y[2]}


def test_synonym_pairs_of_repeated_members(spark):
    """rows that say the same of a trait meet once; traits in several groups, of several species, at one place."""
    rnd = random.Random(5)
    rows = [(rnd.choice([0, 1, None]), rnd.randrange(6), rnd.choice([0, 1, 2, None]), f"t{rnd.randrange(8)}") for _ in range(60)]
    rows += [(7, 1, 0, "a"), (7, 1, 1, "b"), (7, 2, 1, "c"), (7, 2, 1, "b"), (7, 3, 0, None)]
    got = graph.synonym_pairs(spark.createDataFrame(rows, "group_id int, pos int, species int, raw_trait string"))
    assert sorted(map(str, got.collect())) == sorted(f"Row(src={a!r}, dst={b!r})" for a, b in members_of(rows))
    copies = [(g, k, k % 3, f"s{g}-{k % 12}") for g in range(2) for k in range(480)]
    got = graph.synonym_pairs(spark.createDataFrame(copies, "group_id int, pos int, species int, raw_trait string"))
    assert got.count() == 2 * 12 * 8 and max(joined_rows(got)) <= 2 * 12 * 8


def test_synonym_pairs_in_blocks(spark, monkeypatch):
    """a group of many blocks is shared among tasks, and each pair comes once without comparing pairs."""
    monkeypatch.setattr(graph, "PAIR_BLOCK", 10)
    monkeypatch.setattr(graph, "TASK_PAIRS", 500)
    rows = [(0, k, k % 5, f"t{k}") for k in range(100)]
    got = graph.synonym_pairs(spark.createDataFrame(rows, "group_id int, pos int, species int, raw_trait string"))
    by_task = [len(p) for p in got.rdd.glom().collect()]
    assert sum(by_task) == 100 * 80 and max(by_task) < 4000
    assert {(r.src, r.dst) for r in got.collect()} == members_of(rows)


def test_components_of_thinned_edges(spark, monkeypatch):
    """Tasks pass on no more edges than ends, and components stay the same; ids are numbers or texts, one meets itself."""
    rnd = random.Random(1)
    rows = [(rnd.randrange(0, 60, 2), rnd.randrange(0, 60, 2)) for _ in range(3000)] + [(k, k + 2) for k in range(101, 161, 2)] + [(999, 999)]
    e = spark.createDataFrame(rows, "eid_a long, eid_b long").repartition(3)
    assert tiers.thinned(e).count() <= 3 * 62 and tiers.thinned(e.limit(0)).count() == 0
    monkeypatch.setattr(tiers, "HELD_EDGES", 7)
    for edges, of in ((e, int), (e.selectExpr("string(eid_a) eid_a", "string(eid_b) eid_b"), str)):
        got = {r.entity_id: r.component for r in tiers.components(edges).collect()}
        low = {of(k): min((of(j) for j in range(0, 60, 2)), default=0) for k in range(0, 60, 2)} | {of(k): min(of(j) for j in range(101, 163, 2)) for k in range(101, 163, 2)} | {of(999): of(999)}
        assert got == low


def test_limited_pairs_look_at_the_first_only(spark, monkeypatch):
    """rows by a limit are those of all pairs, also where the first pairs give too few rows."""
    sim = spark.createDataFrame([(k, k + 1, 0.9 - k // 4 / 100) for k in range(40)], "a long, b long, score double")
    ent = spark.createDataFrame([(k, f"f{k}", "Anatomy") for k in range(41)], "entity_id long, surface_form string, entity_type string")
    sp = spark.createDataFrame([(k, s) for k in range(41) for s in (["x"] if k < 20 else ["x", "y"])], "entity_id long, species_norm string")
    full = sorted((tuple(r) for r in tiers.tier2_pairs(sim, ent, sp, 0.5, limit=None).collect()), key=lambda r: (-r[4], r[0], r[2], r[5], r[6]))
    monkeypatch.setattr(tiers, "AHEAD", 2)
    for limit in (1, 5, 30, 1000):
        assert [tuple(r) for r in tiers.tier2_pairs(sim, ent, sp, 0.5, limit=limit).collect()] == full[:limit]
