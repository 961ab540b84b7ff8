import pytest
from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.operators.chunking import capped, numbered, split_text


def values(spark, column, *rows):
    df = spark.createDataFrame([(k, *(r if isinstance(r, tuple) else (r,))) for k, r in enumerate(rows)], "k int, x string" + ", y string" * (isinstance(rows[0], tuple)))
    return [r.v for r in df.withColumn("v", column).orderBy("k").collect()]


def test_ids(spark):  # F1, F2, F3
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert values(spark, T.chunk_id("x", "y", F.lit(0)), ("a", "b")) == [sha("a|b|0")[:16]]
    assert values(spark, T.entity_id(F.lit("Gene"), "x"), "  MöLe ", "möle") == [sha("GENE:möle")[:16]] * 2
    got = values(spark, T.canonical_doc_id("x", F.lit(""), "y"), ("10.1/AB", "t"), ("", " A  Title "), ("", "  "), (None, None))
    assert got == ["doi:10.1/ab", "title:" + sha("a title"), None, None]
    assert values(spark, T.canonical_doc_id(F.lit(None).cast("string"), "x", F.lit("t")), "W1") == ["oa:W1"]


def test_junk_chunks(spark):  # P1, from the rules
    texts = ["Figure 1", "Moles dig. They live underground.", "Skull length", " ".join(["word"] * 25), "\n".join(["[1] " + " ".join(["name"] * 20) for _ in range(3)]), "1234567890 " * 3 + "ab", ""]
    assert values(spark, T.is_junk_chunk("x"), *texts) == [True, False, True, False, False, True, True]


def test_junk_entities(spark):  # P2
    forms = ["ab", "Park et al. 2017", "Park 2017", "Park and Smith 2017", "13-28 C", "XM_038812782.1", "Müller cell", "low body temperature (32-34 C)"]
    assert values(spark, T.junk_entity_reason("x"), *forms) == ["too_short", "citation_et_al", "author_year", "author_year", "starts_with_digit", "accession_id", "non_ascii", None]


def test_references(spark):  # F4
    assert values(spark, T.strip_references("x"), "body\n\nReferences\nx", "see References\n", "a\n Literature  Cited \nb\nReferences\nc", None) == ["body", "see References\n", "a", None]


def test_model_output(spark):  # F10, F11, F12, F13
    assert values(spark, T.unfence(T.without_thoughts("x")), "<think>a\nb</think>```json\n[1]\n```", " [2] ") == ["[1]", "[2]"]
    assert values(spark, T.relation_key("x"), " Has - Phenotype ", "PART_OF") == ["has_phenotype", "part_of"]
    assert values(spark, T.trait_key("x"), "  Low \n Light ") == ["low light"]
    assert values(spark, T.fill_template(F.lit("{a}-{b}"), {"a": F.col("x"), "b": F.lit("{a}")}), "1") == ["1-{a}"]


def test_terms(spark):  # F6, F7, F8, P6
    iris = ["http://x/obo/HP_0001", "http://x/GO/12", "http://x/obo/CL_1", "HP_7"]
    assert values(spark, T.iri_to_curie("x"), *iris) == ["HP:0001", "GO:12", None, "HP:7"]
    assert values(spark, T.term_prefix("x"), "HP:1", "none") == ["HP", "UNKNOWN"]
    assert values(spark, T.rich_text("x", F.array(F.lit("s"), F.lit("t")), F.lit("d."), F.lit("c")), "l") == ["l. s | t. d"]
    assert values(spark, T.rich_text("x", F.lit(None).cast("array<string>"), F.lit(None).cast("string"), F.lit("HP:1")), "") == ["HP:1"]


def test_citations(spark):  # F15
    got = values(spark, T.parse_citation("x"), "[source: a/b|chunk:3]", "source: q | chunk: 4", "no tag")
    assert [(g.doc_id, g.chunk_index) if g else None for g in got] == [("a/b", 3), ("q", 4), None]


def test_names(spark):  # F9, F14, S2, P10
    assert values(spark, T.slug("x"), "_Homo sapiens! ", "Ünï-Code") == ["homo_sapiens", "ünï_code"]
    assert values(spark, T.scientific_name("x"), "Homo__sapiens ") == ["homo sapiens"]
    assert values(spark, T.comma_list("x"), "a, ,b ,") == [["a", "b"]]
    assert values(spark, T.plural_pair("x", "y"), ("bone", " Bones"), ("bone", "bone")) == [True, False]


def test_hits(spark):  # W6
    assert values(spark, T.hit_score(F.lit("Mus musculus"), "x", "y"), ("Mus musculus", ""), ("Mus (genus)", "mus musculus"), ("", "")) == [10, -1, 0]


def test_pdf_url(spark):  # G5
    row = spark.sql("select named_struct('pdf_url', '') best, named_struct('pdf_url', 'p') prim, array(named_struct('is_oa', false, 'pdf_url', 'c'), named_struct('is_oa', true, 'pdf_url', 'o')) loc")
    assert row.select(T.best_pdf_url("best", "prim", "loc")).first()[0] == "o"
    assert row.select(T.best_pdf_url("best", "prim", F.filter("loc", lambda x: ~x["is_oa"]))).first()[0] == "p"
    none = row.withColumn("prim", F.struct(F.lit("").alias("pdf_url")))
    assert none.select(T.best_pdf_url("best", "prim", F.filter("loc", lambda x: ~x["is_oa"]))).first()[0] == "c"


def test_splitter():  # F5
    text = "\n\n".join(" ".join(f"word{i}" for i in range(n)) for n in (10, 200, 3)) + "x" * 2500
    chunks = split_text(text)
    assert all(0 < len(c) <= 1000 for c in chunks) and len(chunks) > 4
    for w in ("word0", "word199", "x" * 900):
        assert any(w in c for c in chunks)
    assert split_text("") == [] and split_text("short") == ["short"]
    assert any(a[-40:].split()[-1] in b for a, b in zip(chunks[1:], chunks[2:]))


@pytest.mark.parametrize("n, ratio, kept", [(10, 0.15, 4), (50, 0.05, 4), (3, 0.5, 3), (3, 0.1, 2)])
def test_cap(spark, n, ratio, kept):  # W9, W10
    df = numbered(spark.range(n).selectExpr("'d' as doc", "id * 2 as pos"), ["doc"])
    out = capped(df, ["doc"], ratio).orderBy("pos").collect()
    assert [r.chunk_index for r in out] == list(range(kept))
    assert out[0].pos == 0 and out[-1].pos == 2 * (n - 1)
