"""What a task reads or holds doesn't grow with the tables."""

import glob
import os

import pytest

from lodestrand.operators import cells, extract, graph, reach
from lodestrand.places import shared_dir
from lodestrand.plans import bindings, catalog, flows, pipeline
from lodestrand.streaming import incremental

from .conftest import SMALL


def written(spark, since, pattern):
    return sorted(f for f in set(glob.glob(f"{shared_dir(spark)}/lodestrand/{pattern}")) - since if os.path.basename(f).startswith("part-"))


def test_owl_files_come_in_parts(spark, monkeypatch):
    pattern = "*.owl-*/part-*"
    before, whole = set(glob.glob(f"{shared_dir(spark)}/lodestrand/{pattern}")), sorted(map(str, catalog.QUERIES["owl_terms"](spark, SMALL).collect()))
    monkeypatch.setattr(flows, "PART_CLASSES", 20)
    before = set(glob.glob(f"{shared_dir(spark)}/lodestrand/{pattern}"))
    assert sorted(map(str, catalog.QUERIES["owl_terms"](spark, SMALL).collect())) == whole
    assert max(open(f).read().count("</owl:Class>") for f in written(spark, before, pattern)) < 60
    assert all(open(f).read().count("</rdf:RDF>") <= 1 for f in written(spark, before, pattern))


def test_run_files_are_of_bounded_size(spark, monkeypatch):
    pattern = "runs-*/run=*/part-*"
    monkeypatch.setattr(flows, "FILE_ORDERS", 20)
    before = set(glob.glob(f"{shared_dir(spark)}/lodestrand/{pattern}"))
    rows = catalog.QUERIES["run_files"](spark, SMALL).groupBy("run").count().collect()
    files = written(spark, before, pattern)
    assert len(rows) == 5 and len(files) > 25
    assert max(open(f).read().count('"0.5"') for f in files) < 200


def test_texts_of_a_small_table_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(flows, "TASK_TEXTS", 20)
    assert catalog.QUERIES["validated_answers"](spark, SMALL).rdd.getNumPartitions() >= 8


def test_levels_go_by_the_number_of_edges(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_EDGES", 8)
    edges = spark.createDataFrame([(f"GO:{k}", f"GO:{k // 2}") for k in range(1, 64)], "child_id string, parent_id string")
    out = graph.ancestors(edges, edges.selectExpr("child_id term_id"))
    assert out.rdd.getNumPartitions() == 8
    want = {(f"GO:{k}", f"GO:{k >> n}", n) for k in range(1, 64) for n in (1, 2, 3) if k >> n or k >> (n - 1) == 1}
    assert {tuple(r) for r in out.collect()} == want


@pytest.mark.parametrize("mode", ["original", "compat"])
def test_triples_of_a_row_need_no_shuffle_of_entities(spark, mode):
    raw = '{"entities":[{"text":" eye ","type":"Anatomy"},{"text":"","type":"Gene"},{"text":"EYE","type":"Anatomy"},{"text":"cave","type":"Habitat"},{"text":"pill","type":"Drug"}],"triples":[%s]}'
    triples = ",".join('{"subj_idx":"%s","relation":"PART_OF","obj_idx":"%s"}' % p for p in [(0, 3), (2, 3), (1, 3), (3, 4), (0, 1), ("x", 0), (-1, 0), (0, 9)])
    out = extract.parsed(spark.createDataFrame([("c", "s", raw % triples), ("d", "s", "no JSON")], "chunk_id string, species_norm string, raw string"))
    got = sorted(extract.valid_triples(out, index_mode=mode).collect())
    assert got == sorted(extract.valid_triples(out, extract.valid_entities(out), mode).collect())
    ids = {r.surface_form: r.entity_id for r in extract.valid_entities(out).collect()}
    assert {(r.subj_id, r.obj_id) for r in got} == {(ids["eye"], ids["cave"])}


def test_descendants_take_words_and_a_level_holds_what_goes_on(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(reach, "stored", lambda df, own=reach.stored: kept.append(own(df)) or kept[-1])
    # a chain of 12, and 130 terms under its lowest: words of 64 bits are full, part-filled and negative
    pairs = [(k, k + 1) for k in range(12)] + [(1000 + k, 0) for k in range(130)] + [(12, 11)]
    got = {r.term_id: r.fan_in for r in reach.descendant_counts(spark.createDataFrame(pairs, "child_id long, parent_id long")).collect()}
    assert got == {0: 130, **{k: 130 + k for k in range(1, 11)}, 11: 142, 12: 142}
    assert not [df for df in kept if "binary" in dict(df.dtypes).values()]
    levels = [df.count() for df in kept if df.columns == ["component"]]
    assert levels == list(range(12, -1, -1))


def test_whole_flow_cuts_texts_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(f"c{k}", "s", "p", k, "the eye", "The eye of the blind fish is small. " * 9) for k in range(5)], "chunk_id string, species_norm string, source_path string, chunk_index int, text_snippet string, content string")
    tables = pipeline.index_chunks(rows.mapInArrow(counted, rows.schema), pipeline.Models(extract.dictionary_extractor({"eye": "Anatomy", "fish": "Habitat"})))
    assert tables["doc_chunk"].count() == 5 and tables["mentions"].count() == 10 and tables["related_to"].count() > 0
    assert made.value == 5


def test_rows_meet_pivots_in_slices(spark, monkeypatch):
    v = catalog.B.vectors(spark, SMALL).select("id", "vector")
    asked = v.where("id % 9 = 0").select(catalog.F.col("id").alias("query_id"), "vector")
    monkeypatch.setattr(cells, "BLOCK", 16)
    want = [sorted(map(tuple, cells.nearest(asked, v, 5, m).collect())) for m in ("l2", "cosine")]
    monkeypatch.setattr(cells, "HELD_DISTANCES", 40)
    assert [sorted(map(tuple, cells.nearest(asked, v, 5, m).collect())) for m in ("l2", "cosine")] == want
    batch = v.limit(10).toArrow().combine_chunks().to_batches()
    assert [b.num_rows for b in cells._slices(iter(batch), 4)] == [4, 4, 2]


def test_stream_without_a_call_sends_no_texts(spark):
    rows = spark.readStream.schema(catalog.B.load(spark, SMALL, "documents").schema).parquet(f"{SMALL}/documents.parque[t]")
    rows = rows.select(catalog.F.col("doc_id").alias("chunk_id"), catalog.F.col("text").alias("content"))
    sent = lambda df: df._jdf.queryExecution().analyzed().children().head().output().toString()
    assert "text" not in sent(incremental.index_states(rows)) and "text" in sent(incremental.index_states(rows, call=len))


@pytest.mark.parametrize("held", [0, 1 << 21])
def test_lines_and_parts_go_by_their_number(spark, monkeypatch, held):
    F = catalog.F
    want = [sorted(map(str, catalog.QUERIES[q](spark, SMALL).collect())) for q in ("tier1_relational", "mention_counts", "entity_collapse")]
    for name, n in (("TASK_ROWS", 100), ("HELD_ROWS", held)):
        monkeypatch.setattr(bindings, name, n, raising=False)
    most = lambda df: df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    n, lines = bindings.load(spark, SMALL, "lineitem").count(), bindings.lines(spark, SMALL, together=True)
    assert n > 5000 and most(lines) < 250
    places = lines.select("chunk_id", F.spark_partition_id().alias("at")).collect()
    assert len({r.chunk_id for r in places}) == len({(r.chunk_id, r["at"]) for r in places})
    assert most(bindings.parts(spark, SMALL)) < 250
    assert [sorted(map(str, catalog.QUERIES[q](spark, SMALL).collect())) for q in ("tier1_relational", "mention_counts", "entity_collapse")] == want


def test_tasks_first_stay_few_then_of_bounded_size():
    class Table:
        def __init__(self, n):
            self.count = lambda: n

    assert [bindings.tasks(Table(n)) for n in (0, 1, 1 << 17, (1 << 17) + 1, 36_000_000, 216_000_000, 1 << 30)] == [1, 1, 1, 2, 200, 200, 512]
    assert bindings.tasks(Table(5), Table(1 << 20)) == 8
