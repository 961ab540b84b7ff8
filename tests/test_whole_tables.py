"""The catalogue reads all rows and whole texts of its tables, and so does its SQL."""

from lodestrand.plans import bindings, catalog

from .conftest import SMALL


def test_all_orders_and_lines(spark):
    assert bindings.chunks(spark, SMALL).count() == bindings.load(spark, SMALL, "orders").count()
    assert bindings.lines(spark, SMALL).count() == bindings.load(spark, SMALL, "lineitem").count()


def test_no_filter_in_the_sql():
    """The tables that queries share are whole. (Some queries deal their rows into cases, such as answers that can't be read, by a remainder.)"""
    assert "%" not in bindings.SQL
    for name in ("junk_chunk", "run_status"):
        assert "substr(text" not in catalog.SQL[name]


def test_junk_after_150_characters(spark, tmp_path):
    good = "Moles dig long tunnels in the soil. They live there. " * 20
    late = "Moles dig long tunnels in the soil and live there " * 4 + "\n[1] a\n[2] b\n(3) c\n" + "17 " * 400
    texts = {0: good, 1: "x" * 150 + " " + good, 2: late, 3: "Figure 3", 10: "Figure 10", 20: good}
    spark.createDataFrame([(k, t, "en", "src0") for k, t in texts.items()], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in catalog.junk_chunk(spark, str(tmp_path)).collect()}
    assert {k for k, r in rows.items() if r.junk} == {2, 3, 10}
    assert rows[2].s3 and rows[2].s4
    assert rows[3].s1 and rows[3].s2 and rows[3].s5 and not rows[1].s1 and not rows[1].s5
    assert {r.status: r.n for r in catalog.run_status(spark, str(tmp_path)).collect()} == {"skipped": 3, "junk": 2, "indexed": 1}
