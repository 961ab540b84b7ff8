"""Sources, retries and texts on small fixtures."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from .test_vectors_analysis import mmr_order
from lodestrand.operators import chunking, vectors
from lodestrand.plans import context, runs
from lodestrand.sources import fetch, readers, terms, writers


def answers(*responses):
    left = list(responses)

    def call(url):
        r = left.pop(0)
        if isinstance(r, Exception):
            raise r
        return r

    return call


def test_waits_double_within_the_budget():
    waits = []
    bad = fetch.Response(500)
    with pytest.raises(fetch.FetchError):
        fetch.fetched(answers(*[bad] * 9), "u", sleep=waits.append)
    assert waits == [1.5, 3.0, 6.0, 12.0, 7.5] and sum(waits) == fetch.BUDGET


def test_what_a_server_asks_for():
    waits = []
    got = fetch.fetched(answers(fetch.Response(429, headers={"Retry-After": "4"}), OSError("gone"), fetch.Response(503, headers={"retry-after": "soon"}), fetch.Response(200, b"x")), "u", sleep=waits.append)
    assert got.body == b"x" and waits == [4.0, 3.0, 6.0]
    waits.clear()
    with pytest.raises(fetch.FetchError):
        fetch.fetched(answers(fetch.Response(429, headers={"Retry-After": "83291"}), fetch.Response(429)), "u", sleep=waits.append)
    assert waits == [30.0]


def test_other_errors_are_not_retried():
    for status in (400, 403, 404):
        with pytest.raises(fetch.FetchError) as e:
            fetch.fetched(answers(fetch.Response(status)), "u", sleep=lambda s: pytest.fail("slept"))
        assert e.value.status == status


def test_an_outage_is_no_empty_source(spark):
    def down(text, page):
        raise OSError("down")

    spark.dataSource.register(readers.rest_source("down_pages", "id long", down))
    with pytest.raises(Exception, match="down"):
        spark.read.format("down_pages").load().collect()
    assert spark.read.format("down_pages").option("on_error", "skip").load().collect() == []


OWL = """<?xml version="1.0"?>
<rdf:RDF xmlns:owl="o" xmlns:rdf="r" xmlns:rdfs="s" xmlns:obo="b" xmlns:oboInOwl="i">
<owl:Class rdf:about="http://purl.obolibrary.org/obo/GO_0000001">
  <owl:equivalentClass><owl:Class><owl:unionOf rdf:parseType="Collection"/></owl:Class></owl:equivalentClass>
  <rdfs:subClassOf rdf:resource="http://purl.obolibrary.org/obo/GO_0000002"/>
  <rdfs:subClassOf><owl:Restriction><owl:someValuesFrom rdf:resource="http://purl.obolibrary.org/obo/GO_7"/></owl:Restriction></rdfs:subClassOf>
  <rdfs:subClassOf rdf:resource="http://purl.obolibrary.org/obo/CL_3"/>
  <oboInOwl:hasRelatedSynonym>related</oboInOwl:hasRelatedSynonym>
  <oboInOwl:hasExactSynonym xml:lang="en">exact</oboInOwl:hasExactSynonym>
  <rdfs:comment>not this</rdfs:comment><obo:IAO_0000115 rdf:datatype="string">a &amp; b.</obo:IAO_0000115>
  <rdfs:label>first</rdfs:label><rdfs:label>second</rdfs:label>
</owl:Class>
<owl:Class rdf:about="http://purl.obolibrary.org/obo/GO_0000002"/>
<owl:Class rdf:about="http://purl.obolibrary.org/obo/CL_9"><rdfs:label>other namespace</rdfs:label></owl:Class>
</rdf:RDF>"""


def test_owl_files(spark, tmp_path):
    (tmp_path / "a.owl").write_text(OWL)
    (tmp_path / "b.owl").write_text(OWL.replace("first", "later").replace("GO_0000002", "HP_0000005"))
    rows = {r.id: r for r in terms.load_terms(spark, [str(tmp_path / x) for x in ("a.owl", "none.owl", "b.owl")]).collect()}
    assert sorted(rows) == ["GO:0000001", "GO:0000002", "HP:0000005"]
    one = rows["GO:0000001"]
    assert (one.name, one.ontology, one.synonyms, one.definition, one.parents) == ("first", "GO", ["exact", "related"], "a & b.", ["GO:0000002"])
    assert one.rich_text == "first. exact | related. a & b" and rows["GO:0000002"].rich_text == "GO:0000002"
    with pytest.raises(FileNotFoundError):
        terms.load_terms(spark, [str(tmp_path / "none.owl")])


def plain_split(text, size, overlap, seps):
    at = next(k for k, s in enumerate(seps) if s == "" or s in text)
    sep, finer = seps[at], seps[at + 1 :]
    pieces = list(text) if sep == "" else [p if i == 0 else sep + p for i, p in enumerate(text.split(sep))]
    out, held = [], []

    def close(keep):
        if "".join(held).strip():
            out.append("".join(held).strip())
        while held and len("".join(held)) > keep:
            held.pop(0)

    for p in pieces:
        if not p:
            continue
        if len(p) > size and finer:
            close(0)
            out += plain_split(p, size, overlap, finer)
            continue
        if held and len("".join(held)) + len(p) > size:
            close(min(overlap, size - len(p)) if len(p) < size else 0)
        held.append(p)
    close(0)
    return out


def test_splitter_against_a_plain_version():
    rnd = random.Random(1)
    for _ in range(200):
        text = "".join(rnd.choice(["ab", " ", "\n", "\n\n", "c", "longword" * 3]) for _ in range(rnd.randint(0, 80)))
        assert chunking.split_text(text, 30, 8) == plain_split(text, 30, 8, chunking.SEPARATORS)
    assert len(chunking.split_text("x" * 300_000)) == 375
    for size, overlap in ((1, 0), (3, 5), (7, 6)):
        for _ in range(60):
            text = "".join(rnd.choice(["a", "bc", " ", "\n", "\n\n"]) for _ in range(rnd.randint(0, 30)))
            assert chunking.split_text(text, size, overlap) == plain_split(text, size, overlap, chunking.SEPARATORS)


def test_long_text_is_split_in_little_memory():
    """10 MB of short words: places of pieces are held, not the pieces."""
    import tracemalloc

    text = "word " * 2_000_000
    tracemalloc.start()
    n = sum(1 for _ in chunking.split_spans(text))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 12_500 and peak < 100 << 20


def test_flat_retrieval_against_a_plain_version(spark):
    rnd = random.Random(3)
    rows = [(k, f"s{k % 3}", f"d{k % 11}", f"p{k % 9}", k % 4, [rnd.gauss(0, 1) for _ in range(4)]) for k in range(90)]
    asked = {f"s{k}": [rnd.gauss(0, 1) for _ in range(4)] for k in range(3)}
    df = spark.createDataFrame(rows, "id long, specie string, doc_id string, source_path string, chunk_index int, vector array<double>")
    q = spark.createDataFrame(list(asked.items()), "specie string, vector array<double>")
    got = sorted((r.specie, r.id) for r in context.species_candidates(df, q, 20, 8, 0.6).collect())
    kept = []
    for name, query in asked.items():
        dist = lambda r, query=query: round(sum((a - b) ** 2 for a, b in zip(r[5], query)), 6)
        near = sorted((r for r in rows if r[1] == name), key=lambda r: (dist(r), r[0]))[:20]
        chosen = [near[i] for i in mmr_order(query, [r[5] for r in near], 8)]
        kept += [(name, dist(r), r) for r in sorted(chosen, key=lambda r: (dist(r), r[0]))[:5]]
    first = {}
    for name, x, r in sorted(kept, key=lambda k: (k[0], k[1], k[2][0])):
        first.setdefault((r[3], r[4]), (name, r[0]))
    assert got == sorted(first.values())


def test_synthesis_gives_up_empty():
    calls = []
    assert context.cross_species("{a}", {"a": "x"}, lambda p: calls.append(p) or "[]") == {"communities": [], "gene_function_hypothesis": ""}
    assert calls == ["x"] * 3
    with pytest.raises(ValueError):
        context.answered(lambda p: "", "p", int, otherwise=ValueError("no synthesis"))


def test_run_plan():
    at = datetime(2026, 1, 2, 4, 4, 5, tzinfo=timezone(timedelta(hours=1)))
    first, second = runs.planned_runs(2, "out", at)
    assert first.steps == ("ingest", "index", "enrich", "synthesize") and second.steps == ("enrich", "synthesize")
    assert first.started == "2026-01-02T03:04:05+00:00" and second.directory == "out/run_20260102_030405_02"
    assert runs.planned_runs(2, "out", at, skip_after_first=False)[1].steps == first.steps


def test_empty_chain(spark):
    none = spark.createDataFrame([], "specie string, source string")
    assert context.counts_line(none, none).first().line == "Counts: none"
    raw = spark.createDataFrame([(1, "nothing here"), (2, "NO TRAIT FOUND"), (3, '[{"trait": "a", "combined_sources": ["t"]}]'), (4, None)], "id int, raw string")
    got = {r.id: r.text for r in context.answer_text(context.parsed_bullets(raw), spark.createDataFrame([("t",)], "tag string")).collect()}
    assert got == {2: "No trait found", 3: "- a t"}


def test_graphml_escapes(spark, tmp_path):
    nodes = spark.createDataFrame([("a<b>", None), ('q"&', "x")], "id string, label string")
    writers.graphml(nodes, spark.createDataFrame([], "src string, dst string, kind string"), str(tmp_path / "g"))
    import xml.etree.ElementTree as ET

    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "g")).collect())
    ids = [e.get("id") for e in ET.fromstring(text.split("?>", 1)[1]).iter() if e.tag.endswith("node")]
    assert sorted(ids) == ["a<b>", 'q"&']
