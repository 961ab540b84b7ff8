"""Sources: species files, papers, full texts, term indexes, runs and chunk stores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schemas as S
from ..functions import text as T
from ..operators.graph import first_of


def species_file(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of species; an error if the top level is no array. Blank names are left out."""
    raw = spark.read.text(path, wholetext=True)
    rows = raw.select(F.when(F.ltrim(F.regexp_replace("value", r"^\s+", "")).startswith("["), F.from_json("value", "array<struct<canonical:string,aliases:array<string>>>")).otherwise(F.raise_error(F.lit("a species file must hold a JSON array"))).alias("r"))
    return rows.select(F.explode("r").alias("s")).select("s.*").where(F.coalesce(T.strip("canonical"), F.lit("")) != "").withColumn("species_norm", F.lower(T.strip("canonical")))


def species_entries(names: DataFrame, taxa: DataFrame, vernaculars: DataFrame) -> DataFrame:
    """Names matched to taxa (name, key, canonical), with their English vernaculars (key, pos, name, lang); each name once regardless of case, the canonical one last if it is new."""
    known = names.select(T.scientific_name("name").alias("name")).distinct().join(taxa.select(T.scientific_name("name").alias("name"), "key", F.col("canonical").alias("_c")), "name", "left").withColumn("canonical", F.coalesce("_c", "name")).drop("_c")
    eng = vernaculars.where(F.lower("lang").isin("eng", "en", "english")).select("key", "pos", F.col("name").alias("alias"))
    every = known.select("canonical", "key").join(eng, "key").select("canonical", "pos", "alias").unionByName(known.select("canonical", F.lit(2**31 - 1).alias("pos"), F.col("canonical").alias("alias")))
    once = first_of(every.withColumn("_l", F.lower("alias")), ["canonical", "_l"], ["pos", "alias"])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "alias"))), lambda x: x["alias"])
    return once.groupBy("canonical").agg(listed.alias("aliases"))


class CallReader(DataSourceReader):
    """Pages of a function call as partitions.

    A page that is no list of rows is empty. A call that fails is retried by
    Spark and then fails the read; with the option `on_error` of `skip` it
    gives no rows.
    """

    def __init__(self, schema, options: dict, fetch: Callable[[str, int], list[dict]] | None):
        self.fields, self.options, self.fetch = schema.fieldNames(), options, fetch

    def partitions(self):
        return [InputPartition(k) for k in range(int(self.options.get("pages", "1")))]

    def read(self, partition):
        try:
            rows = self.fetch(self.options.get("query", ""), partition.value) if self.fetch else []
        except Exception:
            if self.options.get("on_error") != "skip":
                raise
            rows = []
        for r in rows if isinstance(rows, list) else []:
            yield tuple(r.get(f) for f in self.fields)


def rest_source(name: str, schema, fetch: Callable[[str, int], list[dict]]) -> type[DataSource]:
    """A Data Source over fetch(query, page); register it and read with options `query` and `pages`. Offline, fetch is any function."""
    from pyspark.sql.types import StructType

    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return kind

        def reader(self, schema):
            return CallReader(schema, self.options, fetch)

    return Source


def search_ids(payloads: DataFrame, column: str = "payload", first: int = 3) -> DataFrame:
    """The first ids of a search result's nested list; none if it can't be read."""
    ids = F.from_json(F.get_json_object(column, "$.esearchresult.idlist"), "array<string>")
    return payloads.select(F.explode(F.slice(ids, 1, first)).alias("pmcid"))


def article_body(xml: Column | str) -> Column:
    """The text of all bodies of an article; null if there is none or it is no XML."""
    x = F.col(xml) if isinstance(xml, str) else xml
    has = x.rlike(r"(?s)<body[\s>].*</body>")
    text = F.array_join(F.xpath(F.when(has, x), F.lit("//body//text()")), " ")
    return T.falsy_null(T.collapse(text))


def html_text(html: Column | str) -> Column:
    """The text of a page: scripts, styles and tags out, common entities in, white space collapsed."""
    x = F.col(html) if isinstance(html, str) else html
    out = F.regexp_replace(x, r"(?is)<(script|style)\b.*?</\1>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->|<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return T.collapse(out)


def resolved_pages(names: DataFrame, by_title: DataFrame, searched: DataFrame) -> DataFrame:
    """Each name's text: the page of that title, else its best search hit. searched: (name, rank, title, snippet, extract)."""
    from ..operators.vectors import best_hits

    hit = best_hits(searched).join(searched.select("name", "rank", "extract"), ["name", "rank"]).select("name", F.col("extract").alias("_hit"))
    exact = by_title.select(F.lower("title").alias("_t"), F.col("extract").alias("_exact")).dropDuplicates(["_t"])
    return names.join(exact, F.lower("name") == F.col("_t"), "left").join(hit, "name", "left").select("name", F.coalesce(T.falsy_null(T.strip("_exact")), T.falsy_null(T.strip("_hit"))).alias("text"))


def first_success(texts: DataFrame) -> DataFrame:
    """Of a species' names (species, rank, text) the first, by rank, that has a text."""
    return first_of(texts.where(F.coalesce("text", F.lit("")) != ""), ["species"], ["rank"])


def fresh_papers(found: DataFrame, ingested: DataFrame, first_new: int = 10, order: str = "rank") -> DataFrame:
    """The first papers of each query that are usable and not ingested yet."""
    new = found.join(ingested.select("doc_id"), "doc_id", "left_anti").where("usable")
    return new.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(order, "doc_id"))).where(F.col("_r") <= first_new).drop("_r")


def binary_documents(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """Files as rows; whether a file is a PDF at all is told by its first bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", "length", "content", F.coalesce(F.substring("content", 1, 4) == F.lit(b"%PDF"), F.lit(False)).alias("is_pdf"))


def has_text(pages: DataFrame, words: int = 10, first_pages: int = 3) -> DataFrame:
    """Documents with enough words on their first pages; pages: (doc_id, page, text), page from 0."""
    return pages.where(F.col("page") < first_pages).groupBy("doc_id").agg((F.sum(T.word_count(F.coalesce("text", F.lit("")))) >= words).alias("has_text"))


def chunk_lookup(chunks: DataFrame, doc_id: str, index: int) -> DataFrame:
    """One chunk by document and number."""
    return chunks.where((F.col("doc_id") == doc_id) & (F.col("chunk_index") == index))


def available_chunks(chunks: DataFrame, doc_id: str) -> DataFrame:
    """The numbers that a document has, for when a lookup finds nothing."""
    return chunks.where(F.col("doc_id") == doc_id).groupBy("doc_id").agg(F.array_sort(F.collect_set("chunk_index")).alias("chunk_indexes"))


def merged_terms(tables: list[DataFrame]) -> DataFrame:
    """Terms of several ontologies in order of precedence; the first row of an id stays. Each table has (pos, iri, name, ontology, synonyms, definition, parents of IRIs)."""
    every = None
    for k, t in enumerate(tables):
        t = t.withColumn("_src", F.lit(k))
        every = t if every is None else every.unionByName(t)
    rows = every.withColumn("id", T.iri_to_curie("iri")).where("id is not null")
    rows = rows.withColumn("parents", F.filter(F.transform("parents", T.iri_to_curie), lambda p: p.isNotNull()))
    return first_of(rows, ["id"], ["_src", "pos"]).select("id", "name", "ontology", "synonyms", "definition", "parents", T.rich_text("name", "synonyms", "definition", "id").alias("rich_text"))


def term_index(spark: SparkSession, path: str) -> DataFrame:
    """Terms and vectors, in one table so that they can't be out of step."""
    return spark.read.schema(S.ONTOLOGY_TERM).parquet(path)


def index_is_fresh(spark: SparkSession, path: str) -> bool:
    """Whether an index is there and not empty."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p)) and not term_index(spark, path).isEmpty()


def run_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(run, trait, sources, confidence) of result files: a list of traits, or an object whose three lists are taken together."""
    one = "array<struct<trait:string,sources:array<string>,confidence:string>>"
    raw = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("run"), T.unfence("value").alias("j"))
    three = F.from_json("j", f"struct<strict_common_traits:{one},subgroup_common_traits:{one},mechanism_hypotheses:{one}>")
    empty = F.array().cast(one)
    listed = F.when(F.col("j").startswith("["), F.from_json("j", one)).otherwise(F.concat(*[F.coalesce(three[k], empty) for k in ("strict_common_traits", "subgroup_common_traits", "mechanism_hypotheses")]))
    return raw.select("run", F.explode(listed).alias("t")).select("run", "t.*")


def run_list(spark: SparkSession, path: str) -> DataFrame:
    """Run directories, one a line, without comments and blanks."""
    return spark.read.text(path).select(T.strip("value").alias("run")).where("run <> '' and not startswith(run, '#')")


def candidate_sets(spark: SparkSession, path: str) -> DataFrame:
    """Candidate sets with their species, and how many different ones."""
    t = spark.read.option("sep", "\t").option("header", True).schema(S.CANDIDATE_SETS).csv(path)
    return t.withColumn("species_list", T.comma_list("Species")).withColumn("n_unique", F.size(F.array_distinct("species_list")))


def run_directories(spark: SparkSession, glob: str) -> DataFrame:
    """(testcase, species, docs, chunks) of result files in nested folders; unreadable ones have nulls."""
    raw = spark.read.option("recursiveFileLookup", True).text(glob, wholetext=True).select(F.input_file_name().alias("path"), "value")
    j = F.from_json("value", "struct<docs:long,chunks:long>")
    return raw.select(F.element_at(F.split("path", "/"), -3).alias("testcase"), F.element_at(F.split("path", "/"), -2).alias("species"), j["docs"].alias("docs"), j["chunks"].alias("chunks"))


def validated_synthesis(raw: Column | str) -> Column:
    """Three lists of traits with text, sources with text, and confidence between 0 and 1; null if a list is missing."""

    def clean(items):
        kept = F.filter(items, lambda t: F.coalesce(T.strip(t["trait"]), F.lit("")) != "")
        return F.transform(kept, lambda t: F.struct(T.strip(t["trait"]).alias("trait"), F.filter(F.coalesce(t["sources"], F.array().cast("array<string>")), lambda s: F.coalesce(T.strip(s), F.lit("")) != "").alias("sources"), T.clamp(F.coalesce(t["confidence"].try_cast("double"), F.lit(0.0))).alias("confidence")))

    names = ["strict_common_traits", "subgroup_common_traits", "mechanism_hypotheses"]
    whole = lambda x: F.when(x[names[0]].isNotNull() & x[names[1]].isNotNull() & x[names[2]].isNotNull(), F.struct(*[clean(x[n]).alias(n) for n in names]))
    return T.bound(F.from_json(T.unfence(raw), S.SYNTHESIS), whole)


def validated_communities(rows: DataFrame) -> DataFrame:
    """Communities with a label; an unknown tier is `llm`, the count is that of the species as listed."""
    return rows.where(F.coalesce(T.strip("label"), F.lit("")) != "").select("label", F.when(F.col("tier").isin(S.TIERS), F.col("tier")).otherwise("llm").alias("tier"), "species_coverage", F.coalesce(F.size("species_coverage"), F.lit(0)).cast("long").alias("species_count"), "supporting_entities")
