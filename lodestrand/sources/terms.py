"""Ontology files as tables of terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .readers import merged_terms

# The elements and attributes of a class that are read.
CLASS = "owl:Class"
ELEMENTS = {
    "iri": "`_rdf:about` string",
    "labels": "`rdfs:label` array<string>",
    "definitions": "`obo:IAO_0000115` array<string>",
    "comments": "`rdfs:comment` array<string>",
    "exact": "`oboInOwl:hasExactSynonym` array<string>",
    "related": "`oboInOwl:hasRelatedSynonym` array<string>",
    "above": "`rdfs:subClassOf` array<struct<`_rdf:resource`:string>>",
}


def owl_classes(spark: SparkSession, path: str) -> DataFrame:
    """The classes of OWL files in RDF/XML, one row each: pos, iri, name, ontology, synonyms, definition, parents (IRIs).

    Files are split and read in parallel. Exact synonyms come before related
    ones; a class without a definition has its first comment; parents are
    named classes only, in their order. Anonymous classes are left out.
    """
    raw = spark.read.format("xml").option("rowTag", CLASS).schema(", ".join(ELEMENTS.values())).load(path)
    rows = raw.toDF(*ELEMENTS).where("iri is not null")
    listed = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    first = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit(""))
    return rows.select(
        F.monotonically_increasing_id().alias("pos"), "iri", first("labels").alias("name"), T.term_prefix(F.coalesce(T.iri_to_curie("iri"), F.lit(""))).alias("ontology"),
        F.filter(F.concat(listed("exact"), listed("related")), lambda s: s != "").alias("synonyms"),
        F.coalesce(T.falsy_null(first("definitions")), first("comments")).alias("definition"),
        F.filter(listed(F.transform("above", lambda a: a["_rdf:resource"])), lambda p: p.isNotNull()).alias("parents"),
    )


def load_terms(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Terms of several files in order of precedence; the first row of an id stays. Files that aren't there are skipped."""
    from .writers import exists

    there = [p for p in paths if exists(spark, p)]
    if not there:
        raise FileNotFoundError(f"none of {paths}")
    return merged_terms([owl_classes(spark, p) for p in there])
