"""Queries of sources, sinks, validation, texts and runs over the driver's tables, and their SQL.

Where an operator reads files, a query first writes them, from a driver's
table, into the shared folder.
"""

from __future__ import annotations

import math
from datetime import datetime, timezone

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extract, graph, mapping, tiers, vectors
from ..places import fresh_path
from ..sources import fetch, readers, terms, writers
from ..sources.snapshots import SnapshotTable
from ..streaming import incremental
from . import bindings as B
from . import context, runs
from .catalog import query


#: Classes in one part of an OWL file, orders in one result file of a run, and rows of whose texts one task takes care; about so many.
PART_CLASSES, FILE_ORDERS, TASK_TEXTS = 20_000, 40_000, 25_000


def _file(df, name: str, rows: int = 0) -> str:
    """df's one column as text in the shared folder, at most so many rows a file if that is given."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", rows).text(path)
    return path


# ---- sources ---------------------------------------------------------------


@query("""
SELECT CASE WHEN n_nationkey % 5 = 0 THEN ' ' || n_name ELSE n_name END AS canonical, n_name || '|' || n_regionkey AS aliases, lower(n_name) AS species_norm FROM nation WHERE n_nationkey % 7 <> 6
""")
def species_file(spark, d):
    """A JSON array of species, some with a blank name."""
    n = B.load(spark, d, "nation")
    name = F.when(F.col("n_nationkey") % 7 == 6, F.lit("  ")).when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit(" "), "n_name")).otherwise(F.col("n_name"))
    rows = n.agg(F.to_json(F.collect_list(F.struct(name.alias("canonical"), F.array("n_name", F.col("n_regionkey").cast("string")).alias("aliases")))).alias("value"))  # 25 rows
    return readers.species_file(spark, _file(rows, "species")).select("canonical", F.array_join("aliases", "|").alias("aliases"), "species_norm")


@query("SELECT doc_id, lang || '+' || source AS names, CAST(2 AS INT) AS n FROM documents")
def species_argument(spark, d):
    """A comma list with blanks and empty names."""
    names = T.comma_list(F.concat(F.lit(" "), "lang", F.lit(" ,, "), "source", F.lit("  ,")))
    return B.documents(spark, d).select("doc_id", F.array_join(names, "+").alias("names"), F.size(names).alias("n"))


@query("""
WITH v AS (SELECT s_nationkey AS k, s_suppkey AS pos, CASE WHEN s_suppkey % 4 = 0 THEN upper(n_name) ELSE 'v' || s_suppkey % 5 END AS a, CASE s_suppkey % 3 WHEN 0 THEN 'EN' WHEN 1 THEN 'english' ELSE 'deu' END AS l FROM supplier JOIN nation ON s_nationkey = n_nationkey),
e AS (SELECT 'C ' || n_name AS canonical, pos, a FROM nation JOIN v ON k = n_nationkey WHERE lower(l) IN ('en', 'eng', 'english') UNION ALL SELECT 'C ' || n_name, 2147483647, 'C ' || n_name FROM nation),
o AS (SELECT canonical, pos, a, row_number() OVER (PARTITION BY canonical, lower(a) ORDER BY pos, a) AS r FROM e)
SELECT canonical, string_agg(a, '|' ORDER BY pos, a) AS aliases FROM o WHERE r = 1 GROUP BY canonical
""")
def taxon_entries(spark, d):
    """Names matched to taxa, with their English vernaculars, each once regardless of case."""
    n = B.load(spark, d, "nation")
    names = n.select(F.concat(F.lit("  "), F.lower("n_name")).alias("name"))
    taxa = n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key"), F.concat(F.lit("C "), "n_name").alias("canonical"))
    s = B.load(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    common = s.select(F.col("s_nationkey").alias("key"), k.cast("int").alias("pos"), F.when(k % 4 == 0, F.upper("n_name")).otherwise(F.concat(F.lit("v"), (k % 5).cast("string"))).alias("name"), F.when(k % 3 == 0, "EN").when(k % 3 == 1, "english").otherwise("deu").alias("lang"))
    return readers.species_entries(names, taxa, common).select("canonical", F.array_join("aliases", "|").alias("aliases"))


@query("SELECT n_name AS name, n_nationkey % 4 AS page FROM nation WHERE n_nationkey % 4 < 3")
def rest_pages(spark, d):
    """Pages of a call as partitions; a page that is no list is empty."""
    rows = [(r.n_nationkey, r.n_name) for r in B.load(spark, d, "nation").select("n_nationkey", "n_name").collect()]  # 25 rows

    def pages(text: str, page: int):
        return [{"name": n, "page": k % 4} for k, n in rows if k % 4 == page] if text == "all" and page < 3 else {"error": "no list"}

    spark.dataSource.register(readers.rest_source("nation_pages", "name string, page int", pages))
    return spark.read.format("nation_pages").option("query", "all").option("pages", "4").load()


@query("SELECT CAST(unnest([o_orderkey, o_custkey, o_orderkey + 1]) AS VARCHAR) AS pmcid FROM orders WHERE o_orderkey % 3 <> 0")
def search_ids(spark, d):
    """The first three ids of nested results; results that can't be read have none."""
    k = F.col("o_orderkey")
    listed = F.to_json(F.struct(F.struct(F.array(*[c.cast("string") for c in (k, F.col("o_custkey"), k + 1, k + 2)]).alias("idlist")).alias("esearchresult")))
    return readers.search_ids(B.load(spark, d, "orders").select(F.when(k % 3 == 0, F.lit("<html>")).otherwise(listed).alias("payload")))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || ' & ' || p_type || ' ' || p_brand WHEN 1 THEN p_brand END AS body FROM part")
def article_bodies(spark, d):
    """The text of every body of an article; null without one and for what is no XML."""
    k = F.col("p_partkey") % 3
    two = F.concat(F.lit("<article><front>x</front><body><p>"), "p_name", F.lit("  &amp;\n"), "p_type", F.lit("</p></body><body>"), "p_brand", F.lit("</body></article>"))
    one = F.concat(F.lit("<article><body>"), "p_brand", F.lit("</body></article>"))
    xml = F.when(k == 0, two).when(k == 1, one).otherwise(F.concat(F.lit("<html>"), "p_name"))
    return B.load(spark, d, "part").select("p_partkey", readers.article_body(xml).alias("body"))


@query("""
WITH h AS (SELECT n_name AS name, s_suppkey AS rank, s_name AS title, row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'page of ' || n_name ELSE 'found ' || h.title END AS text FROM nation LEFT JOIN h ON h.name = n_name AND r = 1
""")
def wiki_pages(spark, d):
    """The page of a name's title, else the text of its best search hit, else nothing."""
    n = B.load(spark, d, "nation")
    hits = B.load(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("name"), F.col("s_suppkey").cast("int").alias("rank"), F.col("s_name").alias("title"), F.lit(None).cast("string").alias("snippet"), F.concat(F.lit("found "), "s_name", F.lit(" ")).alias("extract"))
    titles = n.where("n_nationkey % 3 < 2").select(F.upper("n_name").alias("title"), F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit(" page of "), "n_name")).otherwise(" ").alias("extract"))
    return readers.resolved_pages(n.select(F.col("n_name").alias("name")), titles, hits)


def _papers(spark, d):
    """Papers with links of all kinds, from the suppliers."""
    k, link = F.col("s_suppkey"), lambda kind: F.concat(F.lit(f"http://{kind}/"), F.col("s_suppkey"))
    loc = lambda is_oa, url: F.struct(is_oa.alias("is_oa"), url.alias("pdf_url"))
    none = F.lit(None).cast("string")
    return B.load(spark, d, "supplier").select(
        F.concat(F.lit("https://openalex.org/W"), k).alias("id"), F.when(k % 2 == 0, F.concat(F.lit("https://doi.org/10.1/"), k)).otherwise(F.lit("")).alias("doi"),
        F.when(k % 6 != 5, loc(F.lit(True), F.when(k % 6 == 0, link("best")).otherwise(none))).alias("best_oa_location"), loc(F.lit(False), F.when(k % 6 == 1, link("primary")).otherwise(F.lit(""))).alias("primary_location"),
        F.array(loc(F.lit(False), F.when(k % 6 == 2, link("closed")).otherwise(none)), loc(k % 6 == 3, F.when(k % 6 == 3, link("open")).otherwise(none))).alias("locations"),
    )


_LINKS = "CASE s_suppkey % 6 WHEN 0 THEN 'http://best/' || s_suppkey WHEN 1 THEN 'http://primary/' || s_suppkey WHEN 2 THEN 'http://closed/' || s_suppkey WHEN 3 THEN 'http://open/' || s_suppkey END"


@query(f"SELECT 'W' || s_suppkey AS paper_id, CASE WHEN s_suppkey % 2 = 0 THEN '10.1/' || s_suppkey END AS doi, {_LINKS} AS url FROM supplier")
def paper_links(spark, d):
    """The best link of a paper."""
    return fetch.paper_urls(_papers(spark, d))


@query(f"""
WITH p AS (SELECT s_suppkey AS k, {_LINKS} AS u, s_suppkey % 2 = 0 AS doi FROM supplier WHERE s_suppkey % 10 <> 9)
SELECT 'W' || k AS paper_id, CASE WHEN u IS NULL AND doi OR u IS NOT NULL AND k % 5 = 2 AND doi THEN 'http://doi/' || k ELSE u END AS url,
  CASE WHEN u IS NULL AND NOT doi THEN 'no_url' WHEN u IS NULL OR k % 5 = 2 AND doi THEN 'ok' WHEN k % 5 = 1 THEN 'not_pdf' WHEN k % 5 = 2 THEN 'failed: status 403' WHEN k % 5 = 3 THEN 'failed: status 503' ELSE 'ok' END AS outcome FROM p
""")
def paper_files(spark, d):
    """Files fetched with retries; papers on hand are not fetched, a forbidden link is tried once more by DOI."""

    def call(url: str) -> fetch.Response:
        k = int(url.rsplit("/", 1)[1]) % 5
        if url.startswith("http://doi/") or k in (0, 4):
            return fetch.Response(200, b"%PDF", {"Content-Type": "application/pdf"})
        return {1: fetch.Response(200, b"<html>", {"content-type": "text/html"}), 2: fetch.Response(403), 3: fetch.Response(503, headers={"Retry-After": "20"})}[k]

    papers = fetch.paper_urls(_papers(spark, d))
    have = papers.where("paper_id rlike '9$'").select("paper_id")
    out = fetch.paper_files(papers, call, lambda doi: "http://doi/" + doi.split("/")[1], have, sleep=lambda s: None)
    return out.select("paper_id", "url", "outcome")


@query("""
SELECT "query", doc_id FROM (SELECT o_custkey AS "query", o_orderkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS r FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderstatus <> 'P') WHERE r <= 3
""")
def new_papers(spark, d):
    """The first usable papers of each query that are not on hand."""
    o = B.load(spark, d, "orders")
    found = o.select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("rank"), (F.col("o_orderstatus") != "P").alias("usable"))
    return readers.fresh_papers(found, o.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("doc_id")), 3).select("query", "doc_id")


@query("SELECT n_name AS species, CAST(min(s_suppkey) AS INT) AS rank FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 <> 0 GROUP BY 1")
def first_texts(spark, d):
    """The first of a species' names that has a text."""
    s = B.load(spark, d, "supplier").join(B.load(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    rows = s.select(F.col("n_name").alias("species"), k.cast("int").alias("rank"), F.when(k % 6 == 0, F.lit("")).when(k % 3 != 0, F.col("s_name")).alias("text"))
    return readers.first_success(rows).select("species", "rank")


@query("SELECT source AS doc_id, sum(CASE WHEN doc_id % 5 < 3 THEN len(regexp_extract_all(coalesce(text, ''), '\\S+')) ELSE 0 END) >= 10 AS has_text FROM documents WHERE doc_id % 5 < 3 GROUP BY 1")
def pages_with_text(spark, d):
    """Whether the first three pages of a file hold ten words."""
    return readers.has_text(B.documents(spark, d).select(F.col("source").alias("doc_id"), (F.col("doc_id") % 5).alias("page"), "text"))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, string_agg(DISTINCT l_linenumber, ',' ORDER BY l_linenumber) AS numbers, CAST(count(*) FILTER (WHERE l_linenumber = 2) AS BIGINT) AS hits FROM lineitem WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem WHERE l_linenumber = 2) GROUP BY 1")
def chunk_lookups(spark, d):
    """One chunk by document and number, and the numbers that the document has."""
    li = B.load(spark, d, "lineitem")
    key = li.where("l_linenumber = 2").agg(F.min("l_orderkey")).first()[0]
    chunks = li.select(F.col("l_orderkey").cast("string").alias("doc_id"), F.col("l_linenumber").alias("chunk_index"))
    one = readers.chunk_lookup(chunks, str(key), 2).groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"))
    return readers.available_chunks(chunks, str(key)).join(one, "doc_id").select("doc_id", F.array_join(F.transform("chunk_indexes", lambda c: c.cast("string")), ",").alias("numbers"), "hits")


_TERM = "'GO:' || lpad(CAST({} AS VARCHAR), 7, '0')"


@query(f"""
WITH t AS (SELECT p_partkey AS k, p_name, p_type, p_brand, CASE WHEN p_partkey % 4 = 0 THEN 'HP:' || p_partkey ELSE {_TERM.format('p_partkey')} END AS id FROM part WHERE p_partkey % 5 <> 4)
SELECT id, split_part(id, ':', 1) AS ontology, p_name AS name, p_type || '|' || p_brand AS synonyms, CASE WHEN k % 2 = 0 THEN 'def <' || k || '>' ELSE 'comment' END AS definition,
  {_TERM.format('k // 2')} || '|' || {_TERM.format('k // 3')} AS parents, rtrim(p_name || '. ' || p_type || ' | ' || p_brand || '. ' || CASE WHEN k % 2 = 0 THEN 'def <' || k || '>' ELSE 'comment' END, '. ') AS rich_text FROM t
UNION ALL SELECT {_TERM.format('p_partkey')}, 'GO', 'other', '', '', '', 'other' FROM part WHERE p_partkey % 5 = 4 AND p_partkey % 4 <> 0
UNION ALL SELECT {_TERM.format('p_partkey')}, 'GO', 'other', '', '', '', 'other' FROM part WHERE p_partkey % 4 = 0
""")
def owl_terms(spark, d):
    """The classes of two OWL files; the first file's row of an id stays, other namespaces go, and the file that isn't there is skipped."""
    p, k = B.load(spark, d, "part"), F.col("p_partkey")
    iri = lambda key: F.concat(F.lit("http://purl.obolibrary.org/obo/GO_"), F.lpad(F.floor(key).cast("string"), 7, "0"))
    about = F.when(k % 5 == 4, F.concat(F.lit("http://purl.obolibrary.org/obo/XX_"), k)).when(k % 4 == 0, F.concat(F.lit("http://purl.obolibrary.org/HP/"), k)).otherwise(iri(k))
    up = lambda i: F.concat(F.lit('<rdfs:subClassOf rdf:resource="'), i, F.lit('"/>'))
    text = F.concat(
        F.lit('<owl:Class rdf:about="'), about, F.lit('">'), up(iri(k / 2)), F.lit('<rdfs:subClassOf><owl:Restriction><owl:someValuesFrom rdf:resource="http://x/GO_1"/></owl:Restriction></rdfs:subClassOf>'), up(iri(k / 3)), up(F.lit("http://x/CL_1")),
        F.lit("<oboInOwl:hasRelatedSynonym>"), "p_brand", F.lit('</oboInOwl:hasRelatedSynonym><oboInOwl:hasExactSynonym xml:lang="en">'), "p_type", F.lit("</oboInOwl:hasExactSynonym>"),
        F.when(k % 2 == 0, F.concat(F.lit('<obo:IAO_0000115 rdf:datatype="string">def &lt;'), k, F.lit("&gt;</obo:IAO_0000115>"))).otherwise(F.lit("")), F.lit("<rdfs:comment>comment</rdfs:comment><rdfs:label>"), "p_name", F.lit("</rdfs:label><rdfs:label>second</rdfs:label></owl:Class>"),
    )
    other = F.concat(F.lit('<owl:Class rdf:about="'), iri(k), F.lit('"><rdfs:label>other</rdfs:label></owl:Class>'))
    # each part of a file is a document of its own, so that no task holds a whole file
    head = '<rdf:RDF xmlns:rdf="r" xmlns:rdfs="s" xmlns:owl="o" xmlns:obo="b" xmlns:oboInOwl="i">'
    n = max(1, math.ceil(p.count() / PART_CLASSES))
    part = F.pmod(F.xxhash64(k), F.lit(n)).alias("part")
    whole = lambda c: p.groupBy(part).agg(F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list(c)), "\n"), F.lit("</rdf:RDF>")).alias("value")).select("value")
    paths = [_file(whole(text), "first.owl", 1), fresh_path(spark, "missing.owl"), _file(whole(other), "second.owl", 1)]
    out = terms.load_terms(spark, paths)
    return out.select("id", "ontology", "name", F.array_join("synonyms", "|").alias("synonyms"), "definition", F.array_join("parents", "|").alias("parents"), "rich_text")


@query("SELECT p_partkey AS id, true AS fresh, false AS fresh_before FROM part")
def index_rows(spark, d):
    """A stored index of terms and vectors, and whether it is fresh before and after it is written."""
    path = fresh_path(spark, "index")
    before = readers.index_is_fresh(spark, path)
    p = B.load(spark, d, "part")
    empty = F.array().cast("array<string>")
    p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.lit("GO").alias("ontology"), empty.alias("synonyms"), F.lit("").alias("definition"), empty.alias("parents"), F.col("p_name").alias("rich_text"), F.array(F.lit(1.0)).cast("array<float>").alias("embedding")).write.parquet(path)
    return readers.term_index(spark, path).select(F.col("id").cast("long").alias("id"), F.lit(readers.index_is_fresh(spark, path)).alias("fresh"), F.lit(before).alias("fresh_before"))


@query("""
SELECT o_orderpriority AS run, o_orderstatus || k AS trait, CAST(o_custkey AS VARCHAR) AS source FROM orders, (SELECT unnest(range(3)) AS k) WHERE k = 0 OR substr(o_orderpriority, 1, 1) IN ('2', '4')
""")
def run_files(spark, d):
    """Result files of runs, as lists or as objects with three lists, some of them fenced."""
    o = B.load(spark, d, "orders")
    item = lambda k: F.struct(F.concat("o_orderstatus", F.lit(str(k))).alias("trait"), F.array(F.col("o_custkey").cast("string")).alias("sources"), F.lit("0.5").alias("confidence"))
    # each of the five runs has files of bounded size in a folder of its own
    n = max(1, math.ceil(o.count() / 5 / FILE_ORDERS))
    lists = o.groupBy("o_orderpriority", F.pmod(F.xxhash64("o_orderkey"), F.lit(n)).alias("file")).agg(*[F.collect_list(item(k)).alias(f"l{k}") for k in range(3)])
    three = F.to_json(F.struct(F.col("l0").alias("strict_common_traits"), F.col("l1").alias("subgroup_common_traits"), F.col("l2").alias("mechanism_hypotheses")))
    is_object = F.substring("o_orderpriority", 1, 1).isin("2", "4")
    text = F.concat(F.lit("```json\n"), F.when(is_object, three).otherwise(F.to_json("l0")), F.lit("\n```"))
    path = fresh_path(spark, "runs")
    lists.select(F.hex(F.encode("o_orderpriority", "utf-8")).alias("run"), F.when(is_object, three).otherwise(text).alias("value")).write.partitionBy("run").option("maxRecordsPerFile", 1).text(path)
    out = readers.run_files(spark, f"{path}/*")
    return out.select(F.decode(F.unhex(F.regexp_extract("run", "run=([0-9A-F]+)", 1)), "utf-8").alias("run"), "trait", F.explode("sources").alias("source"))


@query("SELECT 'runs/' || n_name AS run FROM nation")
def run_lists(spark, d):
    """A list of run directories, written and read; comments and blank lines are skipped."""
    n = B.load(spark, d, "nation")
    lines = n.select(F.concat(F.lit(" runs/"), "n_name", F.lit("  ")).alias("run")).union(n.limit(1).select(F.lit("# a comment"))).union(n.limit(1).select(F.lit(" ")))
    path = fresh_path(spark, "list")
    writers.run_list(lines, path)
    return readers.run_list(spark, path)


@query("SELECT n_name AS \"Gene\", CAST(n_nationkey AS INT) AS birch, n_nationkey / 4 AS Qn, 4 AS n_raw, CASE WHEN n_nationkey % 2 = 0 THEN 3 ELSE 4 END AS n_unique FROM nation")
def candidate_sets(spark, d):
    """Candidate sets of a tab-separated file, and how many different species they name."""
    n, path = B.load(spark, d, "nation"), fresh_path(spark, "sets")
    last = F.when(F.col("n_nationkey") % 2 == 0, "a").otherwise("d")
    rows = n.select(F.col("n_name").alias("Gene"), F.col("n_nationkey").alias("Birch #"), (F.col("n_nationkey") / 4).alias("Qn"), F.lit(7).alias("N insertions"), F.concat(F.lit("a, b ,c,,"), last).alias("Species"))
    rows.write.option("sep", "\t").option("header", True).csv(path)
    return readers.candidate_sets(spark, path).select("Gene", F.col("Birch #").alias("birch"), "Qn", F.size("species_list").alias("n_raw"), "n_unique")


@query("SELECT 'case' || n_regionkey AS testcase, n_name AS species, CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey END AS docs, CASE WHEN n_nationkey % 4 <> 0 THEN 10 * n_nationkey END AS chunks FROM nation")
def run_directories(spark, d):
    """Result files in nested folders; what can't be read has nulls."""
    k, path = F.col("n_nationkey"), fresh_path(spark, "nested")
    body = F.when(k % 4 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(k.cast("long").alias("docs"), (k * 10).cast("long").alias("chunks"))))
    rows = B.load(spark, d, "nation").select(F.concat(F.lit("case"), "n_regionkey").alias("t"), F.col("n_name").alias("s"), body.alias("value"))
    rows.repartition("t", "s").write.partitionBy("t", "s").text(path)
    out = readers.run_directories(spark, f"{path}/*/*")
    return out.select(F.regexp_replace("testcase", "^t=", "").alias("testcase"), F.regexp_replace(F.replace("species", F.lit("%20"), F.lit(" ")), "^s=", "").alias("species"), "docs", "chunks")


# ---- sinks -----------------------------------------------------------------


@query("SELECT o_orderkey AS id, count(*) AS n FROM (SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0) GROUP BY 1")
def appended_rows(spark, d):
    """K1: rows appended in two batches."""
    o, path = B.load(spark, d, "orders").select(F.col("o_orderkey").alias("id")), fresh_path(spark, "appended")
    writers.append(o, path)
    writers.append(o.where("id % 2 = 0"), path)
    return spark.read.parquet(path).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT 'term' AS kind, CAST(p_partkey AS VARCHAR) AS a, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE p_name END AS b FROM part
UNION ALL SELECT DISTINCT 'edge', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR) FROM lineitem
""")
def pushed_graph(spark, d):
    """Node and edge tables pushed twice; nodes have the later name, edges are once."""
    p, li, root = B.load(spark, d, "part"), B.load(spark, d, "lineitem"), fresh_path(spark, "graph")
    nodes = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    edges = li.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    writers.push_graph({"term": nodes}, {"maps": edges}, root)
    writers.push_graph({"term": nodes.where("id % 3 = 0").withColumn("name", F.lit("new"))}, {"maps": edges.where("src % 2 = 0")}, root)
    t = writers.read(spark, f"{root}/nodes/term").select(F.lit("term").alias("kind"), F.col("id").cast("string").alias("a"), F.col("name").alias("b"))
    return t.union(writers.read(spark, f"{root}/edges/maps").select(F.lit("edge"), F.col("src").cast("string"), F.col("dst").cast("string")))


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 3 THEN p_name ELSE 'new' END AS name FROM part WHERE p_partkey % 4 <> 3 OR p_partkey % 8 = 3")
def filled_names(spark, d):
    """K4: a name is replaced only if it is null or empty."""
    p, k = B.load(spark, d, "part"), F.col("p_partkey")
    old = p.where("p_partkey % 4 in (0, 1) or p_partkey % 8 = 3").select(k.alias("id"), F.when(k % 4 == 1, F.lit("")).otherwise(F.col("p_name")).alias("name"))
    new = p.where("p_partkey % 4 <> 3").select(k.alias("id"), F.lit("new").alias("name"))
    return graph.fill_blank(old, new, "id", "name")


@query("SELECT o_orderkey AS id, o_orderpriority AS run_id FROM orders WHERE o_orderpriority <> '1-URGENT'")
def cleared_run(spark, d):
    """K6: a stored table without the rows of a run."""
    path = fresh_path(spark, "tagged")
    writers.upsert(B.load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("run_id")), path, ["id"])
    writers.clear_run(spark, path, "1-URGENT")
    return writers.read(spark, path)


@query("""
SELECT 1 AS version, o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey % 5 <> 1
UNION ALL SELECT 2, o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1) THEN 'late' ELSE o_orderstatus END FROM orders
UNION ALL SELECT 3, o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1) THEN 'late' ELSE o_orderstatus END FROM orders WHERE NOT (o_orderkey % 5 = 2)
""")
def table_snapshots(spark, d):
    """K2, K5, K6: all snapshots of a table: as first written, after an upsert, after a deletion."""
    o = B.load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    table = SnapshotTable(spark, fresh_path(spark, "snapshots"), ["id"])
    table.upsert(o.where("id % 5 <> 1"))
    table.upsert(o.where("id % 5 in (0, 1)").withColumn("status", F.lit("late")))
    table.delete(F.col("id") % 5 == 2)
    first, second, third = (table.read(k).select(F.lit(k).alias("version"), "id", "status") for k in table.versions())
    return first.union(second).union(third)


@query("""
SELECT line FROM (
  SELECT '<node id="' || n_name || '"><data key="label">a &lt;' || n_regionkey || '&gt; &amp; &quot;b&quot;</data></node>' AS line FROM nation
  UNION ALL SELECT '<edge source="' || n_name || '" target="' || r_name || '"><data key="kind">z' || '</data></edge>' FROM nation JOIN region ON n_regionkey = r_regionkey)
""")
def graphml_lines(spark, d):
    """K7: nodes and edges of a GraphML file, escaped; of equal edges one stays."""
    n, path = B.load(spark, d, "nation"), fresh_path(spark, "graphml")
    nodes = n.select(F.col("n_name").alias("id"), F.concat(F.lit("a <"), "n_regionkey", F.lit('> & "b"')).alias("label"))
    edges = n.join(B.load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("src"), F.col("r_name").alias("dst"), F.explode(F.array(F.lit("a"), F.lit("z"))).alias("kind"))
    writers.graphml(nodes, edges, path)
    return spark.read.text(path).where("startswith(value, '<node') or startswith(value, '<edge')").select(F.col("value").alias("line"))


@query("SELECT o_orderkey, o_orderpriority FROM orders")
def json_sink(spark, d):
    """K8: JSON lines, written and read."""
    path = fresh_path(spark, "lines")
    writers.json_lines(B.load(spark, d, "orders").select("o_orderkey", "o_orderpriority"), path)
    return spark.read.schema("o_orderkey long, o_orderpriority string").json(path)


@query("SELECT CAST(count(DISTINCT lower(n_name)) AS VARCHAR) AS n_species, CAST(greatest(2, count(DISTINCT lower(n_name)) // 2) AS VARCHAR) AS min_species, '3' AS runs, '2026-01-02T03:04:05+00:00' AS started FROM nation")
def bundle_meta(spark, d):
    """What a bundle says of itself, written and read."""
    path = fresh_path(spark, "bundle")
    plan = runs.planned_runs(3, "out", datetime(2026, 1, 2, 3, 4, 5, tzinfo=timezone.utc))
    writers.bundle(spark, runs.bundle_meta(plan, B.load(spark, d, "nation").select(F.col("n_name").alias("canonical"))), path)
    return spark.read.json(path).select("n_species", "min_species", "runs", "started")


# ---- validation ------------------------------------------------------------

_KINDS = ["Species", "Anatomy", "Phenotype", "Habitat", "Process", "Gene", "Cell", "Drug"]


def _answers(spark, d):
    """An extractor's raw output for every order: its parts as entities, its lines as triples, with thoughts and fences."""
    rows = B.lines(spark, d).join(B.load(spark, d, "part").select(F.col("p_partkey").alias("_k"), "p_name", "p_size"), F.col("l_partkey") == F.col("_k"))
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), F.col("p_size") % 8 + 1)
    name = F.when(F.col("p_size") % 11 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "p_name"))
    item = F.struct(name.alias("text"), kind.alias("type")).alias("e")
    triple = F.struct((F.col("pos") - 1).cast("string").alias("subj_idx"), F.when(F.col("l_returnflag") == "A", "LIVES_IN").when(F.col("l_returnflag") == "N", "PART_OF").otherwise("EATS").alias("relation"), F.col("pos").cast("string").alias("obj_idx")).alias("t")
    # dealt by chunk once: the groups and all that is made of them stay where they are
    one = rows.select(F.col("l_orderkey").cast("string").alias("chunk_id"), "l_orderkey", "species_norm", F.struct("pos", item, triple).alias("x")).repartition("chunk_id").groupBy("chunk_id", "l_orderkey", "species_norm").agg(F.sort_array(F.collect_list("x")).alias("x"))
    body = F.to_json(F.struct(F.col("x.e").alias("entities"), F.col("x.t").alias("triples")))
    k = F.col("l_orderkey")
    raw = F.when(k % 7 == 0, F.lit("no JSON {")).when(k % 3 == 0, F.concat(F.lit("<think>\n{}</think>```json\n"), body, F.lit("\n```"))).otherwise(body)
    return extract.parsed(one.select("chunk_id", "species_norm", raw.alias("raw")))


_ANSWERS = f"""
, a AS (SELECT CAST(l_orderkey AS VARCHAR) AS chunk_id, species_norm, pos - 1 AS pos, trim(p.p_name) AS surface_form, {_KINDS}[p.p_size % 8 + 1] AS entity_type, p.p_size % 11 = 0 AS blank, l_returnflag FROM lines l JOIN part p ON l_partkey = p_partkey WHERE l_orderkey % 7 <> 0),
ok AS (SELECT *, substr(sha256(upper(entity_type) || ':' || lower(surface_form)), 1, 16) AS entity_id FROM a WHERE NOT blank AND entity_type NOT IN ('Cell', 'Drug') AND length(surface_form) >= 3),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, entity_id ORDER BY pos) AS r FROM ok) WHERE r = 1)
"""


@query(_ANSWERS + "SELECT chunk_id, entity_id, surface_form, entity_type, CAST(pos AS INT) AS pos FROM once", graph_tables=True)
def valid_entities(spark, d):
    """Entities of raw output with a text and a known type; in a chunk the first of each id."""
    return extract.valid_entities(_answers(spark, d)).select("chunk_id", "entity_id", "surface_form", "entity_type", "pos")


@query(_ANSWERS + """
SELECT DISTINCT x.entity_id AS subj_id, CASE a.l_returnflag WHEN 'A' THEN 'LIVES_IN' ELSE 'PART_OF' END AS relation_type, y.entity_id AS obj_id, a.chunk_id
FROM a JOIN ok x ON x.chunk_id = a.chunk_id AND x.pos = a.pos JOIN ok y ON y.chunk_id = a.chunk_id AND y.pos = a.pos + 1 WHERE a.l_returnflag IN ('A', 'N')
""", graph_tables=True)  # fmt: skip
def valid_triples(spark, d):
    """Triples with a known relation whose text indexes point at entities that stayed."""
    return extract.valid_triples(_answers(spark, d)).select("subj_id", "relation_type", "obj_id", "chunk_id")


@query(_ANSWERS + """
, left_over AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY pos) - 1 AS i FROM once)
SELECT DISTINCT x.entity_id AS subj_id, CASE a.l_returnflag WHEN 'A' THEN 'LIVES_IN' ELSE 'PART_OF' END AS relation_type, y.entity_id AS obj_id, a.chunk_id
FROM a JOIN left_over x ON x.chunk_id = a.chunk_id AND x.i = a.pos JOIN left_over y ON y.chunk_id = a.chunk_id AND y.i = a.pos + 1 WHERE a.l_returnflag IN ('A', 'N')
""", graph_tables=True)  # fmt: skip
def valid_triples_compat(spark, d):
    """P4, as it is done where indexes point into the list that is left."""
    return extract.valid_triples(_answers(spark, d), index_mode="compat").select("subj_id", "relation_type", "obj_id", "chunk_id")


@query("""
WITH p AS (SELECT p_partkey, p_partkey % 4 <> 0 AS ok, p_size % 3 <> 0 AS has_trait, p_name, p_brand, p_size FROM part)
SELECT p_partkey, CASE WHEN ok THEN CASE WHEN has_trait THEN p_name ELSE '' END || '/' || CASE WHEN has_trait THEN p_brand ELSE '' END END AS strict,
  CASE WHEN ok AND has_trait THEN CASE WHEN p_size % 5 = 0 THEN 0.0 ELSE least(1.0, greatest(0.0, (p_size - 10) / 20)) END END AS confidence FROM p
""")
def validated_answers(spark, d):
    """Lists of traits with text; confidence as a number or 0, between 0 and 1; null if a list is missing."""
    p = B.load(spark, d, "part")
    conf = F.when(F.col("p_size") % 5 == 0, F.lit("sure")).otherwise(((F.col("p_size") - 10) / 20).cast("string"))
    trait = F.struct(F.when(F.col("p_size") % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit("  "), "p_name")).alias("trait"), F.array("p_brand", F.lit("  "), F.lit(None).cast("string")).alias("sources"), conf.alias("confidence"))
    none = F.array().cast("array<struct<trait:string,sources:array<string>,confidence:string>>")
    full = F.to_json(F.struct(F.array(trait).alias("strict_common_traits"), none.alias("subgroup_common_traits"), none.alias("mechanism_hypotheses")))
    raw = F.when(F.col("p_partkey") % 4 == 0, F.to_json(F.struct(F.array(trait).alias("strict_common_traits")))).otherwise(F.concat(F.lit("```\n"), full, F.lit("```")))
    # a small table of keys makes many long texts
    texts = p.repartition(max(1, math.ceil(p.count() / TASK_TEXTS))).select("p_partkey", raw.alias("raw"))
    out = texts.select("p_partkey", readers.validated_synthesis("raw").alias("v"))
    traits = F.col("v.strict_common_traits")
    first = F.get(traits, F.lit(0))
    return out.select("p_partkey", F.when(F.col("v").isNotNull(), F.concat(F.coalesce(first["trait"], F.lit("")), F.lit("/"), F.coalesce(F.array_join(first["sources"], ","), F.lit("")))).alias("strict"), first["confidence"].alias("confidence"))


@query("SELECT p_name AS label, CASE WHEN p_size % 5 = 0 THEN 'merged' ELSE 'llm' END AS tier, p_size % 3 AS species_count FROM part WHERE p_partkey % 6 <> 0")
def validated_communities(spark, d):
    """Communities with a label; unknown tiers are `llm`."""
    p = B.load(spark, d, "part")
    rows = p.select(F.when(F.col("p_partkey") % 6 == 0, F.lit(" ")).otherwise(F.col("p_name")).alias("label"), F.when(F.col("p_size") % 5 == 0, "merged").otherwise("own").alias("tier"), F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), F.col("p_size") % 3).alias("species_coverage"), F.array("p_brand").alias("supporting_entities"))
    return readers.validated_communities(rows).select("label", "tier", "species_count")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, min(l_quantity) OVER (PARTITION BY l_orderkey) AS b FROM lineitem) WHERE l_quantity <= b + 10 AND l_quantity <= 20")
def margin_and_threshold(spark, d):
    """Rows at most so far beyond the best of their group, and below a bound."""
    return vectors.within_margin(B.load(spark, d, "lineitem").withColumnRenamed("l_quantity", "distance"), "l_orderkey", 10.0, threshold=20.0).select("l_orderkey", "l_linenumber", "l_partkey")


# ---- graph -----------------------------------------------------------------


def _tree(spark, d):
    """Terms of a binary tree over the parts; some edges lead out of the allowed namespaces."""
    name = lambda c: F.concat(F.when(c % 5 == 4, F.lit("XX:")).otherwise(F.lit("GO:")), c)
    k = F.col("p_partkey")
    up = lambda n: F.floor(k / n).cast("long")
    return B.load(spark, d, "part").select(name(k).alias("child_id"), F.explode(F.array(name(up(2)), name(up(3)))).alias("parent_id"))


_TREE = """
WITH RECURSIVE e AS (SELECT DISTINCT CASE WHEN p_partkey % 5 = 4 THEN 'XX:' ELSE 'GO:' END || p_partkey AS c, CASE WHEN u % 5 = 4 THEN 'XX:' ELSE 'GO:' END || u AS p FROM (SELECT p_partkey, unnest([p_partkey // 2, p_partkey // 3]) AS u FROM part)),
r(t, a, depth) AS (SELECT c, p, 1 FROM e WHERE p LIKE 'GO:%' UNION SELECT t, p, depth + 1 FROM r JOIN e ON a = c WHERE depth < 3 AND p LIKE 'GO:%')
"""


@query(_TREE + "SELECT t AS term_id, a AS ancestor, min(depth) AS depth FROM r WHERE t <> a GROUP BY 1, 2")
def ancestor_levels(spark, d):
    """H1: ancestors within three levels, through allowed terms only, at their least depth."""
    e = _tree(spark, d)
    return graph.ancestors(e, e.select(F.col("child_id").alias("term_id")).distinct())


@query("""
SELECT p_partkey AS term_id, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY pos) - 1 AS INT) AS pos, u AS parent_id FROM (
  SELECT p_partkey, unnest([p_partkey // 3, p_partkey * 2, p_partkey // 2]) AS u, unnest([0, 1, 2]) AS pos FROM part) WHERE u IN (SELECT p_partkey FROM part)
""")
def direct_parents(spark, d):
    """Parents that the index has, in their order."""
    k = F.col("p_partkey")
    t = B.load(spark, d, "part").select(k.alias("id"), F.array(F.floor(k / 3).cast("long"), k * 2, F.floor(k / 2).cast("long")).alias("parents"))
    return mapping.parents_of(t, t.select(F.col("id").alias("term_id"))).select("term_id", F.col("pos").cast("int").alias("pos"), "parent_id")


_COLLAPSED = """
, half AS (SELECT * FROM mapped WHERE brand < 'Brand#3'),
counts AS (SELECT species_norm, entity_id, surface_form, entity_type, count(*) AS n FROM mentions JOIN entities USING (entity_id) GROUP BY ALL),
merged AS (
  SELECT species_norm, min(entity_id) AS entity_id, CASE WHEN count(*) > 1 THEN min(term_name) || '  (merged ' || count(*) || ' forms)' ELSE min(surface_form) END AS surface_form,
         arg_max(entity_type, (n, entity_id)) AS entity_type, CAST(sum(n) AS BIGINT) AS mention_count, count(*) AS n_forms
  FROM counts LEFT JOIN half USING (entity_id) GROUP BY species_norm, coalesce(term_id, 'entity:' || entity_id))
"""


def _collapsed(spark, d):
    counts = graph.mention_counts(B.mentions(spark, d), B.chunks(spark, d), B.entities(spark, d))
    return graph.collapsed_entities(counts, B.mapped(spark, d).where("brand < 'Brand#3'"))


@query(_COLLAPSED + "SELECT * FROM merged", graph_tables=True)
def collapse_with_unmapped(spark, d):
    """Entities that share a term become one; unmapped ones stay as they are."""
    return _collapsed(spark, d)


_OWN_TRIPLES = """
, t AS (SELECT DISTINCT species_norm, a.surface_form AS subject, relation_type AS relation, b.surface_form AS object FROM related JOIN entities a ON a.entity_id = subj_id JOIN entities b ON b.entity_id = obj_id)
"""


def _own_triples(spark, d):
    return graph.surface_triples(B.related(spark, d), B.mentions(spark, d), B.chunks(spark, d), B.entities(spark, d), cross_species=False)


@query(_COLLAPSED + _OWN_TRIPLES + """
SELECT species_norm, (SELECT count(*) FROM merged m WHERE m.species_norm = s.species_norm) AS n_entities, least(100, (SELECT count(*) FROM t WHERE t.species_norm = s.species_norm)) AS n_triples, least(50, n) AS n_chunks, first_entity
FROM (SELECT species_norm, count(*) AS n FROM chunks GROUP BY 1) s JOIN (SELECT species_norm, arg_min(surface_form, (-mention_count, entity_id)) AS first_entity FROM merged GROUP BY 1) USING (species_norm)
""", graph_tables=True)  # fmt: skip
def subgraph_sizes(spark, d):
    """A species' entities by mentions, its first triples and chunks."""
    chunks = B.chunks(spark, d).select("chunk_id", "species_norm", F.lit("s").alias("source_path"), F.col("chunk_id").alias("chunk_index"), F.col("o_orderpriority").alias("text_snippet"))
    g = graph.subgraphs(_collapsed(spark, d), _own_triples(spark, d), chunks, 50, 100)
    return g.select("species_norm", F.col("n_entities").cast("long").alias("n_entities"), F.col("n_triples").cast("long").alias("n_triples"), F.size("chunk_texts").cast("long").alias("n_chunks"), F.col("entities")[0]["surface_form"].alias("first_entity"))


@query(_COLLAPSED + _OWN_TRIPLES + """
, e AS (SELECT species_norm, string_agg('  [' || entity_type || '] ' || surface_form || '  (×' || mention_count || ' chunks)', chr(10) ORDER BY entity_type, mention_count DESC, entity_id) AS x FROM merged GROUP BY 1),
k AS (SELECT species_norm, string_agg('  (' || subject || ') -[' || relation || ']-> (' || object || ')', chr(10) ORDER BY subject, relation, object) AS y FROM (SELECT *, row_number() OVER (PARTITION BY species_norm ORDER BY subject, relation, object) AS r FROM t) WHERE r <= 150 GROUP BY 1)
SELECT species_norm, '=== ENTITY SUMMARY ===' || chr(10) || x || chr(10) || chr(10) || '=== KNOWLEDGE GRAPH TRIPLES ===' || chr(10) || coalesce(y, '(no triples extracted)') || chr(10) AS text FROM e LEFT JOIN k USING (species_norm)
""", graph_tables=True)  # fmt: skip
def subgraph_context(spark, d):
    """A species' subgraph as text for a model."""
    return context.subgraph_text(_collapsed(spark, d), _own_triples(spark, d))


@query("""
WITH s AS (SELECT s_suppkey AS k, n_name AS species, s_name AS trait, s_suppkey % 3 <> 0 AS mapped, 'GO:' || s_suppkey % 10 AS term, s_suppkey % 10 AS t, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 8 / 8 END AS score FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT DISTINCT * FROM (
  SELECT 'HAS_TRAIT' AS kind, species AS src, trait AS dst, coalesce(score, 0) AS score FROM s
  UNION ALL SELECT 'MAPPED_TO', trait, term, coalesce(score, 0) FROM s WHERE mapped AND t <> 9
  UNION ALL SELECT 'IS_A', term, 'ROOT', NULL FROM s WHERE mapped AND t <> 9
  UNION ALL SELECT 'SIMILAR_TO', trait, trait || 'x', 0.9 FROM s WHERE k % 7 = 0
  UNION ALL SELECT 'SYNONYM_OF', x.trait, y.trait, NULL FROM s x JOIN s y ON x.t = y.t AND x.k <> y.k AND x.species <> y.species)
""")
def legacy_graph(spark, d):
    """Species, traits and terms in one graph, each edge once."""
    s, k = B.load(spark, d, "supplier").join(B.load(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")), F.col("s_suppkey")
    rows = s.select(k.alias("k"), F.col("n_name").alias("species"), F.col("s_name").alias("raw_trait"), (k % 3 != 0).alias("mapped"), F.when(k % 10 != 9, F.concat(F.lit("GO:"), (k % 10).cast("string"))).alias("term_id"), F.when(k % 4 != 0, k % 8 / 8).alias("cosine_score"), (k % 10).alias("group_id"))
    is_a = rows.where("term_id is not null").select(F.col("term_id").alias("child_id"), F.lit("ROOT").alias("parent_id")).distinct()
    alike = rows.where("k % 7 = 0").select(F.col("raw_trait").alias("src"), F.concat("raw_trait", F.lit("x")).alias("dst"), F.lit(0.9).alias("score"))
    return graph.legacy_edges(rows, is_a, alike, graph.synonym_pairs(rows.select("group_id", F.col("k").alias("pos"), "species", "raw_trait")))


@query("""
WITH s AS (SELECT n_name AS species, s_name AS trait, s_suppkey % 3 <> 0 AS mapped, s_suppkey % 10 AS t FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT DISTINCT * FROM (SELECT 'Species' AS kind, species AS id FROM s UNION ALL SELECT 'Trait', trait FROM s UNION ALL SELECT 'Term', 'GO:' || t FROM s WHERE mapped UNION ALL SELECT 'Term', 'ROOT' FROM s WHERE mapped)
""")
def legacy_nodes(spark, d):
    """The nodes of that graph, each once."""
    s, k = B.load(spark, d, "supplier").join(B.load(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")), F.col("s_suppkey")
    rows = s.select(F.col("n_name").alias("species"), F.col("s_name").alias("raw_trait"), (k % 3 != 0).alias("mapped"), F.concat(F.lit("GO:"), (k % 10).cast("string")).alias("term_id"))
    return graph.legacy_nodes(rows, rows.select(F.col("term_id").alias("child_id"), F.lit("ROOT").alias("parent_id")).distinct())


@query("""
WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector, CASE WHEN vec_id % 4 = 0 THEN ['A', 'B'] ELSE ['A'] END AS sp FROM embeddings)
SELECT x.id AS a, y.id AS b, round(list_cosine_similarity(x.vector, y.vector), 4) AS score FROM v x JOIN v y ON x.id < y.id AND x.sp <> y.sp WHERE list_cosine_similarity(x.vector, y.vector) >= 0.35
""")
def trait_pairs(spark, d):
    """Similar traits of species that are not the same; {A, B} and {A} are not."""
    g = F.when(F.col("vec_id") % 4 == 0, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("A")))
    return vectors.similar_pairs(B.load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), g.alias("groups")), 0.35)


@query("""
WITH f AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN p_name || 's' ELSE upper(p_name) END AS sf, p_partkey // 3 AS g FROM part),
p AS (SELECT x.k AS a, y.k AS b FROM f x JOIN f y ON x.g = y.g AND x.k < y.k WHERE lower(x.sf) || 's' <> lower(y.sf) AND lower(y.sf) || 's' <> lower(x.sf))
SELECT a AS eid_a, b AS eid_b, 0.5 AS score, 2 AS n_species FROM p
""")
def unordered_without_plurals(spark, d):
    """Pairs regrouped without order; forms that differ by a final s go."""
    p, k = B.load(spark, d, "part"), F.col("p_partkey")
    # every third part has its neighbour's name in the plural
    f = p.select(k.alias("k"), F.when(k % 3 == 0, F.concat("p_name", F.lit("s"))).otherwise(F.upper("p_name")).alias("sf"), F.floor(k / 3).alias("g"))
    x, y = f.toDF("eid1", "sf1", "g"), f.toDF("eid2", "sf2", "g")
    pairs = x.join(y, "g").where("eid1 <> eid2").select("eid1", "sf1", "eid2", "sf2", F.lit(0.5).alias("score"), F.when(F.col("eid1") < F.col("eid2"), "A").otherwise("B").alias("sp1"), F.when(F.col("eid1") < F.col("eid2"), "B").otherwise("A").alias("sp2"))
    return tiers.unordered_pairs(pairs, 2).select("eid_a", "eid_b", "score", F.size("species").alias("n_species"))


# ---- texts -----------------------------------------------------------------


@query("""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN source ELSE lang || ' ' || source END AS a, lower(lang) || ' x' AS b FROM documents
""")
def fences_and_thoughts(spark, d):
    """text without fences and thoughts, and traits as keys."""
    k, s = F.col("doc_id") % 4, F.col("source")
    raw = F.when(k == 0, F.concat(F.lit("said: ```json\n"), s, F.lit(" \n``` more"))).when(k == 1, F.concat(F.lit("<think>a\n```b```</think>\n"), s, F.lit(" "))).otherwise(F.concat("lang", F.lit(" "), s))
    return B.documents(spark, d).select("doc_id", T.unfence(T.without_thoughts(raw)).alias("a"), T.trait_key(F.concat(F.lit(" "), F.upper("lang"), F.lit(" \t\nX "))).alias("b"))


@query("""
SELECT p_partkey, 'p=' || p_name || ' ' || p_brand || ' {other}' AS filled, '1. GO:' || p_partkey || ' ' || p_name || ': ' || substr(repeat(p_type || ' ', 20), 1, 120) || chr(10) || '2. HP:1 x: ' AS listed, substr(repeat(p_type, 40), 1, 300) AS snippet FROM part
""")
def prompts(spark, d):
    """templates filled literally, numbered candidates, snippets."""
    c = F.array(F.struct(F.concat(F.lit("GO:"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.repeat(F.concat("p_type", F.lit(" ")), F.lit(20)).alias("definition")), F.struct(F.lit("HP:1").alias("id"), F.lit("x").alias("name"), F.lit(None).cast("string").alias("definition")))
    filled = T.fill_template(F.lit("p={a} {b} {other}"), {"a": F.col("p_name"), "b": F.col("p_brand")})
    return B.load(spark, d, "part").select("p_partkey", filled.alias("filled"), context.candidate_lines(c).alias("listed"), F.substring(F.repeat("p_type", F.lit(40)), 1, context.SNIPPET_CHARS).alias("snippet"))


@query("""
SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'HP:' || n_nationkey WHEN 1 THEN 'GO:' || n_nationkey WHEN 2 THEN 'ENVO:' || n_nationkey WHEN 3 THEN 'MP:a_' || n_nationkey END AS curie, 'lives_in_the_' || lower(n_name) AS rel, CAST(greatest(2, n_nationkey // 2) AS INT) AS least FROM nation
""")
def curies_and_relations(spark, d):
    """IRIs by underscore, by slash and by their tails; relations with blanks and hyphens; the default number of species."""
    k = F.col("n_nationkey")
    forms = {0: "http://x.org/obo/HP_", 1: "http://x.org/GO/", 2: "ENVO_", 3: "http://x_y.org/MP:a_", 4: "http://x.org/CL_"}
    iri = F.concat(F.when(k % 5 == 0, forms[0]).when(k % 5 == 1, forms[1]).when(k % 5 == 2, forms[2]).when(k % 5 == 3, F.lit("http://x.org/MP/a_")).otherwise(forms[4]), k)
    rel = F.concat(F.lit(" Lives  in - the-"), "n_name", F.lit(" "))
    return B.load(spark, d, "nation").select("n_nationkey", T.iri_to_curie(iri).alias("curie"), T.relation_key(rel).alias("rel"), tiers.default_min_species(k).cast("int").alias("least"))


@query("""
SELECT key, min(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'doc_id|' || source || '|' || doc_id % 10 WHEN 1 THEN 'source_path|' || lang || '|' || doc_id % 10 ELSE 'content_hash|' || sha256(coalesce(text, '')) END AS key FROM documents) GROUP BY 1
""")
def chunk_keys(spark, d):
    """D3: chunks are the same by document and number, else by source and number, else by content; the nearest stays."""
    k = F.col("doc_id")
    rows = B.documents(spark, d).select(k.alias("id"), F.when(k % 3 == 0, F.col("source")).alias("doc_id"), F.when(k % 3 < 2, F.col("lang")).alias("source_path"), F.when(k % 3 < 2, k % 10).alias("chunk_index"), F.coalesce("text", F.lit("")).alias("content"), k.alias("distance"))
    rows = rows.withColumn("key", vectors.candidate_key())
    least = vectors.united_candidates(rows.where("id % 2 = 0").select("key", "id", "distance"), rows.where("id % 2 = 1").select("key", "id", "distance"), ["key"])
    return least.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key").select("key", F.col("id").alias("doc_id"), "n")


@query("SELECT source AS source_path, doc_id % 50 AS chunk_index, arg_min(doc_id, (lang, doc_id)) AS id FROM documents GROUP BY 1, 2")
def chunks_across_species(spark, d):
    """A chunk that several species have counts for the first."""
    rows = B.documents(spark, d).select("lang", F.col("source").alias("source_path"), (F.col("doc_id") % 50).alias("chunk_index"), F.col("doc_id").alias("id"))
    return graph.first_of(rows, ["source_path", "chunk_index"], ["lang", "id"]).select("source_path", "chunk_index", "id")


@query("SELECT p_brand AS surface_form, arg_min(p_type, p_partkey) AS entity_type FROM part GROUP BY 1")
def forms_once(spark, d):
    """A surface form is mapped once, with the type that it had first."""
    return graph.first_of(B.load(spark, d, "part"), ["p_brand"], ["p_partkey"]).select(F.col("p_brand").alias("surface_form"), F.col("p_type").alias("entity_type"))


@query("SELECT p_partkey, length(p_name) AS a, length(p_name) - length(replace(p_name, ' ', '')) + 1 AS b FROM part")
def embedded_once(spark, d):
    """Vectors of texts, each different text embedded once."""
    import numpy as np

    out = extract.embedded(B.load(spark, d, "part").select("p_partkey", "p_name"), "p_name", lambda texts: np.array([[len(t), len(t.split(" "))] for t in texts], np.float32))
    return out.select("p_partkey", F.col("vector")[0].cast("long").alias("a"), F.col("vector")[1].cast("long").alias("b"))


@query("SELECT n_nationkey AS species, CASE WHEN n_nationkey % 4 IN (0, 1) THEN CAST(n_nationkey AS VARCHAR) ELSE n_name END AS name FROM nation")
def display_names(spark, d):
    """Display names, or the key where there is none."""
    n = B.load(spark, d, "nation")
    names = n.where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("species"), F.when(F.col("n_nationkey") % 4 == 1, F.lit("")).otherwise(F.col("n_name")).alias("name"))
    return context.named(n.select(F.col("n_nationkey").alias("species")), "species", names)


@query("""
SELECT '- name ' || n_regionkey || ' [' || n_regionkey || ']: ' || count(*) || ' species (' || string_agg(n_name, ', ' ORDER BY n_name) || '); forms: ' || array_to_string(list_sort(list(lower(n_name)))[1:8], ', ') AS line FROM nation GROUP BY n_regionkey
UNION ALL SELECT '- a -[in]-> b' || n_regionkey || ': ' || count(*) || ' species (' || array_to_string(list_sort(list(n_name))[1:5], ', ') || ')' FROM nation GROUP BY n_regionkey
UNION ALL SELECT '- ' || array_to_string(list_sort(list(n_name))[1:6], ', ') || ': ' || count(*) || ' species, score 0.500' FROM nation GROUP BY n_regionkey
""")
def tier_lines(spark, d):
    """Tier 1, relations and tier 2 as lines, with so many items shown."""
    g = B.load(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("species"), F.array_sort(F.collect_list(F.lower("n_name"))).alias("forms"))
    g = g.select(F.concat(F.lit("name "), "n_regionkey").alias("name"), F.col("n_regionkey").cast("string").alias("term_id"), "species", "forms", F.lit("a").alias("anc1_id"), F.lit("in").alias("rel_type"), F.concat(F.lit("b"), "n_regionkey").alias("anc2_id"), F.size("species").alias("n_species"), F.col("species").alias("species_list"), F.col("species").alias("members"), F.lit(0.5).alias("score"))
    return g.select(F.explode(F.array(context.tier1_line(F.col("species"), F.col("forms")), context.relational_line(), context.tier2_line())).alias("line"))


# ---- answers and runs ------------------------------------------------------


def _said(spark, d):
    """Raw answers, one for each customer: its orders as bullets."""
    o, k = B.load(spark, d, "orders"), F.col("o_custkey")
    tag = T.citation("o_orderpriority", "o_orderkey")
    empty = F.array().cast("array<string>")
    own, sub = F.when(F.col("o_orderkey") % 2 == 0, F.array(tag, F.lit("[source: x|chunk:1]"))).otherwise(empty), F.array(F.struct(F.array(tag).alias("sources")))
    b = F.struct("o_orderkey", F.struct(F.when(F.col("o_orderstatus") == "P", F.lit(" ")).otherwise(F.concat(F.lit(" t"), "o_orderkey")).alias("trait"), sub.alias("subclaims"), own.alias("combined_sources")).alias("b"))
    g = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(b)).alias("l")).withColumn("l", F.transform("l", lambda x: x["b"]))
    raw = F.when(k % 5 == 0, F.lit("```\nNo trait found\n```")).when(k % 5 == 1, F.lit("no JSON")).when(k % 5 == 2, F.to_json(F.struct(F.col("l").alias("bullets")))).otherwise(F.concat(F.lit("```json\n"), F.to_json("l"), F.lit("\n```")))
    return g.select(k.alias("id"), raw.alias("raw")), o.where("o_orderkey % 3 <> 0").select(tag.alias("tag"))


@query("""
WITH b AS (SELECT o_custkey AS id, string_agg('- t' || o_orderkey || ' [source: ' || o_orderpriority || '|chunk:' || o_orderkey || ']', chr(10) ORDER BY o_orderkey) AS t FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderstatus <> 'P' GROUP BY 1)
SELECT DISTINCT o_custkey AS id, CASE WHEN o_custkey % 5 = 0 THEN 'No trait found' ELSE coalesce(t, '') END AS text FROM orders LEFT JOIN b ON id = o_custkey WHERE o_custkey % 5 <> 1
""")
def bullet_answers(spark, d):
    """Bullets of answers with the citations that were retrieved; answers that can't be read have no row."""
    raw, allowed = _said(spark, d)
    return context.answer_text(context.parsed_bullets(raw), allowed)


@query("""
WITH i AS (SELECT lang, CASE WHEN doc_id % 3 = 0 THEN 'wikipedia:' || source ELSE source END AS s, doc_id % 2 = 0 AS used FROM documents),
c AS (SELECT lang || ': PDFs ' || count(DISTINCT s) FILTER (WHERE s NOT LIKE 'wikipedia:%') || ' ingested / ' || count(DISTINCT s) FILTER (WHERE used AND s NOT LIKE 'wikipedia:%') || ' used; Wikipedia ' || count(DISTINCT s) FILTER (WHERE s LIKE 'wikipedia:%') || ' ingested / ' || count(DISTINCT s) FILTER (WHERE used AND s LIKE 'wikipedia:%') || ' used' AS x FROM i GROUP BY lang)
SELECT 'Counts: ' || string_agg(x, '; ' ORDER BY x) AS line FROM c
""")
def source_counts_line(spark, d):
    """How many sources of each kind were ingested and used."""
    rows = B.documents(spark, d).select(F.col("lang").alias("specie"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("wikipedia:"), "source")).otherwise(F.col("source")).alias("source"), "doc_id")
    return context.counts_line(rows, rows.where("doc_id % 2 = 0"))


@query("""
WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings),
h AS (SELECT q.id AS query_id, v.id, round(list_distance(q.vector, v.vector) ** 2, 6) AS x, row_number() OVER (PARTITION BY q.id ORDER BY round(list_distance(q.vector, v.vector) ** 2, 6), v.id) AS r FROM v q, v WHERE q.id % 100 = 0)
SELECT query_id, id FROM h WHERE r <= 20 AND x <= 100
""")
def notebook_hits(spark, d):
    """The 20 nearest of all, within a distance, without diversity."""
    v = B.vectors(spark, d)
    return context.notebook_candidates(v.select("id", "vector"), v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector"), most=100.0).select("query_id", "id")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || '|' || p_brand WHEN 1 THEN p_type ELSE '' END AS traits FROM part")
def inventories(spark, d):
    """Traits of inventory answers, as texts or objects; an empty list for what is none."""
    k = F.col("p_partkey") % 3
    raw = F.when(k == 0, F.concat(F.lit("```json\n"), F.to_json(F.array("p_name", F.lit(" "), "p_brand")), F.lit("```"))).when(k == 1, F.to_json(F.array(F.struct(F.col("p_type").alias("trait"), F.lit(1).alias("n"))))).otherwise(F.lit('{"traits": 1}'))
    return B.load(spark, d, "part").select("p_partkey", F.array_join(context.trait_inventory(raw), "|").alias("traits"))


@query("SELECT p_type AS trait, CASE WHEN length(p_type) % 3 = 0 THEN p_type ELSE 'g' || length(p_type) % 3 END AS \"group\" FROM (SELECT DISTINCT p_type FROM part)")
def trait_groups(spark, d):
    """U8: each trait of the list exactly once, in the first group that has it or in its own."""
    p = B.load(spark, d, "part")
    n = F.length("p_type") % 3
    proposed = p.where(n != 0).select(F.concat(F.lit(" "), F.upper("p_type")).alias("trait"), F.explode(F.array(F.concat(F.lit("g"), n), F.lit("z"))).alias("group")).union(p.limit(1).select(F.lit("unknown"), F.lit("g1")))
    return context.grouped_traits(p.select(F.col("p_type").alias("trait")), proposed)


@query("SELECT n_name AS species_norm, CASE WHEN n_nationkey % 2 = 0 THEN 'sum ' || n_name ELSE 'context of ' || n_name END AS text FROM nation")
def summaries(spark, d):
    """Contexts summed up by a model, or as they are where its call fails."""
    n = B.load(spark, d, "nation")
    even = {r.n_name for r in n.where("n_nationkey % 2 = 0").collect()}  # 25 rows at most

    def call(prompt: str) -> str:
        name = prompt.split(": ")[0]
        if name not in even:
            raise RuntimeError("no answer")
        return f" sum {name}\n"

    return context.summarized(n.select(F.col("n_name").alias("species_norm"), F.concat(F.lit("context of "), "n_name").alias("text")), "{species_name}: {subgraph_context}", call)


@query("SELECT n_name AS label, 'llm' AS tier, CAST(2 AS BIGINT) AS species_count, 'h' AS hypothesis FROM nation WHERE n_nationkey % 3 <> 0")
def synthesis(spark, d):
    """Communities of a model that answers at its third attempt."""
    import json

    names = [(r.n_nationkey, r.n_name) for r in B.load(spark, d, "nation").orderBy("n_nationkey").collect()]  # 25 rows
    asked = []

    def call(prompt: str) -> str:
        asked.append(prompt)
        if len(asked) < 3:
            return "not yet" if len(asked) == 1 else "[]"
        rows = [{"label": f" {n} " if k % 3 else " ", "tier": "own", "species_coverage": ["a", "b"]} for k, n in names]
        return f"```json\n{json.dumps({'communities': rows, 'gene_function_hypothesis': 'h'})}\n```"

    got = context.cross_species("{n} of {x}", {"n": str(len(names)), "x": "y"}, call)
    return spark.createDataFrame([(c["label"], c["tier"], c["species_count"], got["gene_function_hypothesis"]) for c in got["communities"]], "label string, tier string, species_count long, hypothesis string")


@query("SELECT chunk_id FROM (SELECT o_orderkey AS chunk_id FROM orders) WHERE chunk_id % 3 <> 0")
def not_indexed(spark, d):
    """Chunks that are not in the index yet."""
    c = B.load(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"))
    return incremental.not_indexed(c, c.where("chunk_id % 3 = 0"))


@query("SELECT p_partkey AS entity_id, p_partkey % 4 <> 3 OR p_partkey % 8 = 3 AS upheno_enriched, p_partkey % 4 = 0 OR p_partkey % 8 = 3 AS upheno_mapped FROM part")
def enrich_flags(spark, d):
    """Entities after a round; those without a match count as enriched, too."""
    k = F.col("p_partkey")
    e = B.load(spark, d, "part").select(k.alias("entity_id"), (k % 8 == 3).alias("upheno_enriched"), (k % 8 == 3).alias("upheno_mapped"))
    return incremental.marked(e, e.where("entity_id % 4 <> 3").select("entity_id", (F.col("entity_id") % 4 == 0).alias("mapped"))).select("entity_id", "upheno_enriched", "upheno_mapped")


@query("""
SELECT r AS number, CASE WHEN r = 1 THEN 'ingest,index,enrich,synthesize' ELSE 'enrich,synthesize' END AS steps, 'out/run_20260102_030405_0' || r AS directory, '2026-01-02T03:04:05+00:00' AS started FROM (SELECT r_regionkey + 1 AS r FROM region)
""")
def run_plan(spark, d):
    """The runs of a batch; from the second on, ingest and index are skipped."""
    plan = runs.planned_runs(B.load(spark, d, "region").count(), "out", datetime(2026, 1, 2, 3, 4, 5, tzinfo=timezone.utc))
    return spark.createDataFrame([(r.number, ",".join(r.steps), r.directory, r.started) for r in plan], "number int, steps string, directory string, started string")


@query("SELECT n_name AS specie, 'first' AS trait FROM nation")
def reused_traits(spark, d):
    """I8: traits that an earlier run left are taken instead of new ones."""
    n, path = B.load(spark, d, "nation"), fresh_path(spark, "traits")
    make = lambda word: lambda: n.select(F.col("n_name").alias("specie"), F.lit(word).alias("trait"))
    runs.reused_traits(spark, path, make("first"))
    return runs.reused_traits(spark, path, make("second"))


@query("SELECT count(*) AS seen, count(*) FILTER (WHERE l_returnflag = 'R') AS triggered, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 4) AS trigger_rate FROM lineitem")
def stage_stats(spark, d):
    """How often a stage was triggered, observed while its rows are written."""
    rows, seen = runs.stage_stats(B.load(spark, d, "lineitem").select("l_returnflag"), "stage", F.col("l_returnflag") == "R")
    rows.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["seen"], seen.get["triggered"], seen.get["trigger_rate"])], "seen long, triggered long, trigger_rate double")


def _letters(texts):
    """How often each letter from a to z is in a text: a vector that SQL can state."""
    return [[t.lower().count(chr(97 + k)) for k in range(26)] for t in texts]


def _by_score(trait, candidates):
    """A verifier by steps of the score; of parents, which have none, by the form's length."""
    top = candidates[0]
    s = top["cosine_score"]
    if s is None or s != s:
        return {"confidence": "medium" if len(trait) % 2 == 0 else "low", "term_id": top["id"]}
    return {"confidence": "high" if s >= 0.85 else "medium" if s >= 0.78 else "low", "term_id": top["id"]}


@query("""
WITH forms AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS f, ascii(p_name) % 2 = 0 AS first FROM part),
words AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part),
terms AS (SELECT DISTINCT 'HP:' || p_name AS id, p_name AS name, 'HP:~' || split_part(p_name, ' ', 1) AS parent FROM part UNION ALL SELECT 'HP:~' || w, w, NULL FROM words),
fv AS (SELECT f, first, list_transform(range(26), lambda k: CAST(length(f) - length(replace(f, chr(CAST(97 + k AS INT)), '')) AS DOUBLE)) AS v FROM forms),
tv AS (SELECT *, list_transform(range(26), lambda k: CAST(length(name) - length(replace(name, chr(CAST(97 + k AS INT)), '')) AS DOUBLE)) AS v FROM terms),
top AS (SELECT * FROM (
  SELECT f, first, id, parent, round(list_inner_product(fv.v, tv.v) / ((sqrt(list_inner_product(fv.v, fv.v)) + 1e-10) * (sqrt(list_inner_product(tv.v, tv.v)) + 1e-10)), 6) AS s,
         row_number() OVER (PARTITION BY f ORDER BY round(list_inner_product(fv.v, tv.v) / ((sqrt(list_inner_product(fv.v, fv.v)) + 1e-10) * (sqrt(list_inner_product(tv.v, tv.v)) + 1e-10)), 6) DESC, id) AS r FROM fv, tv) WHERE r = 1),
judged AS (
  SELECT f, first, s, CASE WHEN s >= 0.78 THEN id WHEN s >= 0.5 AND parent IS NOT NULL AND length(f) % 2 = 0 THEN parent END AS term_id,
         CASE WHEN s >= 0.85 THEN 'high' WHEN s >= 0.78 THEN 'medium' WHEN s >= 0.5 AND parent IS NOT NULL AND length(f) % 2 = 0 THEN 'medium' ELSE 'no_match' END AS confidence FROM top)
SELECT run, f AS raw_trait, term_id, confidence, CASE WHEN s >= 0.78 THEN s END AS cosine_score, s < 0.78 AND term_id IS NOT NULL AS broadened, run = 2 AND first AS from_memo
FROM judged, (SELECT unnest([1, 2]) AS run) WHERE run = 2 OR first
""")
def mapped_twice(spark, d):
    """Forms mapped in two runs with one memo: the second needs calls only for forms that the first didn't have."""
    p = B.load(spark, d, "part")
    forms = p.select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("raw_trait"), (F.ascii("p_name") % 2 == 0).alias("first")).distinct()
    words = F.split("p_name", " ")
    of = lambda w: F.concat(F.lit("HP:~"), w)
    named = p.select(F.concat(F.lit("HP:"), "p_name").alias("id"), F.col("p_name").alias("name"), F.transform(words, of).alias("parents")).distinct()
    single = p.select(F.explode(words).alias("name")).distinct().select(of(F.col("name")).alias("id"), "name", F.array().cast("array<string>").alias("parents"))
    terms = graph.settled(extract.embedded(named.union(single), "name", _letters, "embedding"))
    memo = SnapshotTable(spark, fresh_path(spark, "memo"), ["raw_trait", "model"])
    runs = [mapping.map_with_memo(f, terms, _letters, _by_score, memo).withColumn("run", F.lit(k)) for k, f in ((1, forms.where("first")), (2, forms))]
    return runs[0].unionByName(runs[1]).select("run", "raw_trait", "term_id", "confidence", "cosine_score", "broadened", "from_memo")
