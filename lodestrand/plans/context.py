"""Texts for a model, calls with fallbacks, and answers made of what comes back."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as T
from ..operators import vectors
from ..operators.graph import first_of

# How many items a text shows.
FORMS_SHOWN, SPECIES_SHOWN, EDGES_SHOWN, MEMBERS_SHOWN = 8, 5, 6, 5
CHUNKS_IN_CONTEXT, DEFINITION_CHARS, SNIPPET_CHARS, LOG_CHARS = 40, 120, 300, 500
TRIPLES_FOR_SUMMARY, TRIPLES_FOR_SYNTHESIS = 50, 150
NOTEBOOK_K, NOTEBOOK_DISTANCE = 20, 0.5


def _lines(rows: DataFrame, group: list[str], order: list, line: Column, out: str, limit: int | None = None) -> DataFrame:
    """The lines of each group in order, joined by line feeds; at most `limit` of them are gathered."""
    if limit is not None:
        rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= limit)
        order = ["_r"]
    listed = F.array_sort(F.collect_list(F.struct(*[c if isinstance(c, str) else c.alias(f"_o{k}") for k, c in enumerate(order)], line.alias("_line"))))
    return rows.groupBy(*group).agg(F.array_join(F.transform(listed, lambda x: x["_line"]), "\n").alias(out))


def candidate_lines(candidates: Column | str) -> Column:
    """numbered candidates (id, name, definition) with the first part of their definitions."""
    c = F.col(candidates) if isinstance(candidates, str) else candidates
    line = lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["id"], F.lit(" "), x["name"], F.lit(": "), F.substring(F.coalesce(x["definition"], F.lit("")), 1, DEFINITION_CHARS))
    return F.array_join(F.transform(c, line), "\n")


def subgraph_text(entities: DataFrame, triples: DataFrame, max_triples: int = TRIPLES_FOR_SYNTHESIS) -> DataFrame:
    """(species_norm, text) with an entity and a triple section.

    entities: species_norm, entity_id, surface_form, entity_type,
    mention_count: types in a fixed order, others after them by name, then by
    mentions. triples: species_norm, subject, relation, object. A species
    without triples says so.
    """
    place = F.coalesce(F.array_position(F.array(*map(F.lit, ["Species", "Phenotype", "Anatomy", "Process", "Habitat", "Gene"])), F.col("entity_type")), F.lit(0))
    place = F.when(place == 0, 99).otherwise(place)
    e = _lines(entities, ["species_norm"], [place, F.col("entity_type"), -F.col("mention_count"), "entity_id"], F.format_string("  [%s] %s  (×%d chunks)", "entity_type", "surface_form", "mention_count"), "_e")
    t = _lines(triples, ["species_norm"], ["subject", "relation", "object"], F.format_string("  (%s) -[%s]-> (%s)", "subject", "relation", "object"), "_t", max_triples)
    both = e.join(t, "species_norm", "full")
    return both.select("species_norm", F.concat(F.lit("=== ENTITY SUMMARY ===\n"), F.coalesce("_e", F.lit("(no entities extracted)")), F.lit("\n\n=== KNOWLEDGE GRAPH TRIPLES ===\n"), F.coalesce("_t", F.lit("(no triples extracted)")), F.lit("\n")).alias("text"))


def _shown(c: Column, n: int) -> Column:
    return F.array_join(F.slice(c, 1, n), ", ")


def tier1_line(species: Column, forms: Column) -> Column:
    """One tier 1 community: term, species and the first of its forms."""
    return F.concat(F.lit("- "), F.col("name"), F.lit(" ["), F.col("term_id"), F.lit("]: "), F.size(species).cast("string"), F.lit(" species ("), F.array_join(species, ", "), F.lit("); forms: "), _shown(forms, FORMS_SHOWN))


def relational_line() -> Column:
    """One relation that several species share."""
    return F.concat(F.lit("- "), F.col("anc1_id"), F.lit(" -["), F.col("rel_type"), F.lit("]-> "), F.col("anc2_id"), F.lit(": "), F.col("n_species").cast("string"), F.lit(" species ("), _shown(F.col("species_list"), SPECIES_SHOWN), F.lit(")"))


def tier2_line() -> Column:
    """One cluster of similar forms."""
    return F.concat(F.lit("- "), _shown(F.col("members"), EDGES_SHOWN), F.lit(": "), F.size("species").cast("string"), F.lit(" species, score "), F.format_number("score", 3))


def named(rows: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """Rows with the display name (key, name) of their key, or the key itself."""
    return rows.join(names.select(key, F.col("name").alias("_n")), key, "left").withColumn("name", F.coalesce(T.falsy_null("_n"), F.col(key).cast("string"))).drop("_n")


# calls
def answered(call: Callable[[str], str], prompt: str, check: Callable[[str], object], attempts: int = 3, otherwise: object = None) -> object:
    """The checked answer of a call; after so many failures `otherwise`, which is raised if it is an exception."""
    for _ in range(attempts):
        try:
            return check(call(prompt))
        except Exception:  # noqa: S112  a model's answer can fail in any way
            continue
    if isinstance(otherwise, Exception):
        raise otherwise
    return otherwise


def summarized(contexts: DataFrame, template: str, call: Callable[[str], str] | None) -> DataFrame:
    """(species_norm, text) with each text summed up; the text itself where there is no model or its call fails."""
    import pandas as pd

    prompts = contexts.select("species_norm", "text", T.fill_template(F.lit(template), {"species_name": F.col("species_norm"), "subgraph_context": F.col("text")}).alias("prompt"))

    def run(frames):
        def one(prompt, text):
            try:
                return call(prompt).strip()
            except Exception:
                return text

        for f in frames:
            yield pd.DataFrame({"species_norm": f["species_norm"], "text": [one(p, t) for p, t in zip(f["prompt"], f["text"])]})

    return contexts.select("species_norm", "text") if call is None else prompts.mapInPandas(run, "species_norm string, text string")


def _object(raw: str) -> dict:
    inner = re.search(r"(?is)```(?:json)?\s*(.*?)```", raw)
    out = json.loads((inner[1] if inner else raw).strip())
    if not isinstance(out, dict):
        raise ValueError("an object is wanted")
    return out


def cross_species(template: str, sections: dict[str, str], call: Callable[[str], str], attempts: int = 3) -> dict:
    """Communities and hypothesis of a model; both empty after so many failures."""
    for name, value in sections.items():
        template = template.replace("{" + name + "}", value)

    def checked(raw: str) -> dict:
        data = _object(raw)
        rows = data.get("communities", [])
        if not isinstance(rows, list):
            raise ValueError("communities must be a list")
        listed = lambda c, k: [str(x) for x in c.get(k, [])] if isinstance(c.get(k, []), list) else []
        kept = [c for c in rows if isinstance(c, dict) and isinstance(c.get("label"), str) and c["label"].strip()]
        out = [{"label": c["label"].strip(), "tier": c.get("tier") if c.get("tier") in S.TIERS else "llm", "species_coverage": listed(c, "species_coverage"), "species_count": len(listed(c, "species_coverage")), "supporting_entities": listed(c, "supporting_entities")} for c in kept]
        return {"communities": out, "gene_function_hypothesis": str(data.get("gene_function_hypothesis", ""))}

    return answered(call, template, checked, attempts, {"communities": [], "gene_function_hypothesis": ""})


def trait_inventory(raw: Column | str) -> Column:
    """The traits of an inventory answer, a JSON list of texts or of objects with `trait`; an empty list if it is none."""
    x = T.unfence(raw)
    texts = F.from_json(x, "array<string>")  # an object comes as its own text
    either = F.transform(texts, lambda t: F.when(t.startswith("{"), F.get_json_object(t, "$.trait")).otherwise(t))
    clean = F.filter(F.transform(F.coalesce(either, F.array().cast("array<string>")), T.strip), lambda t: F.coalesce(t, F.lit("")) != "")
    return F.when(x.startswith("["), clean).otherwise(F.array().cast("array<string>"))


def grouped_traits(freq: DataFrame, proposed: DataFrame) -> DataFrame:
    """U8: (trait, group): each trait of the frequency list exactly once: in the first group that lists it, by name; in one of its own if none does. What groups list beyond the list is dropped."""
    first = first_of(proposed.select(T.trait_key("trait").alias("_k"), "group"), ["_k"], ["group"])
    return freq.select("trait").distinct().join(first, T.trait_key("trait") == F.col("_k"), "left").select("trait", F.coalesce("group", "trait").alias("group"))


# flat retrieval
def species_candidates(chunks: DataFrame, queries: DataFrame, fetch: int = S.FETCH_K, final: int = S.FINAL_K, share: float = 0.6, threshold: float | None = None) -> DataFrame:
    """For each species the nearest chunks, of these a diverse choice, of this the nearest share; a chunk that several species have counts once.

    chunks: (id, specie, doc_id, source_path, chunk_index, vector).
    queries: (specie, vector), one each.
    """
    q = queries.select(F.col("specie").alias("query_id"), "specie", "vector")
    hits = vectors.nearest(q, chunks.select("id", "vector", "specie"), fetch, "l2", by="specie")
    rows = hits.join(chunks, "id").join(queries.select("specie", F.col("vector").alias("query")), "specie").withColumnRenamed("score", "distance")
    chosen = vectors.mmr(rows.select("specie", "id", "doc_id", "source_path", "chunk_index", "distance", "vector", "query"), "specie", final)
    kept = vectors.nearest_share(chosen, "specie", share)
    once = first_of(kept, ["source_path", "chunk_index"], ["specie", "distance", "id"])
    once = once if threshold is None else once.where(F.col("distance") <= threshold)
    return once.select("specie", "id", "doc_id", "source_path", "chunk_index", "distance")


def notebook_candidates(chunks: DataFrame, queries: DataFrame, k: int = NOTEBOOK_K, most: float = NOTEBOOK_DISTANCE) -> DataFrame:
    """The k nearest chunks over all species, within a distance; (query_id, id, distance, rank)."""
    return vectors.nearest(queries, chunks.select("id", "vector"), k, "l2").withColumnRenamed("score", "distance").where(F.col("distance") <= most)


def parsed_bullets(raw: DataFrame) -> DataFrame:
    """(id, pos, trait, tags, nothing) of answers (id, raw): a list of bullets or an object with `bullets`; tags are a bullet's own sources or else those of its subclaims. An answer that can't be read has no rows; one that says there is no trait has one row with `nothing`."""
    one = "array<struct<trait:string,subclaims:array<struct<sources:array<string>>>,combined_sources:array<string>>>"
    x = raw.select("id", T.unfence("raw").alias("j"))
    listed = F.when(F.col("j").startswith("["), F.from_json("j", one)).otherwise(F.from_json("j", f"struct<bullets:{one}>")["bullets"])
    no = F.lower("j") == "no trait found"
    rows = x.where(~no).select("id", F.posexplode(listed).alias("pos", "b"))
    empty = F.array().cast("array<string>")
    own = F.coalesce("b.combined_sources", empty)
    sub = F.flatten(F.transform(F.coalesce("b.subclaims", F.array().cast("array<struct<sources:array<string>>>")), lambda s: F.coalesce(s["sources"], empty)))
    out = rows.select("id", "pos", T.strip("b.trait").alias("trait"), F.when(F.size(own) > 0, own).otherwise(sub).alias("tags"), F.lit(False).alias("nothing"))
    return out.unionByName(x.where(no).select("id", F.lit(0).alias("pos"), F.lit(None).cast("string").alias("trait"), empty.alias("tags"), F.lit(True).alias("nothing")))


def answer_text(bullets: DataFrame, allowed: DataFrame) -> DataFrame:
    """(id, text): the bullets that have a trait and tags that were retrieved, a line each, in order. allowed: (tag)."""
    tags = bullets.where(F.coalesce("trait", F.lit("")) != "").select("id", "pos", "trait", F.posexplode("tags").alias("at", "tag")).join(allowed.select("tag").distinct(), "tag", "left_semi")
    lines = tags.groupBy("id", "pos", "trait").agg(F.array_sort(F.collect_list(F.struct("at", "tag"))).alias("_t"))
    lines = lines.withColumn("_line", F.concat(F.lit("- "), F.col("trait"), F.lit(" "), F.array_join(F.transform("_t", lambda t: t["tag"]), " ")))
    said = _lines(lines, ["id"], ["pos"], F.col("_line"), "_a")
    every = bullets.groupBy("id").agg(F.max("nothing").alias("_no"))
    return every.join(said, "id", "left").select("id", F.when(F.col("_no"), "No trait found").otherwise(F.coalesce("_a", F.lit(""))).alias("text"))


def counts_line(ingested: DataFrame, used: DataFrame) -> DataFrame:
    """One row: how many different PDFs and articles of each species were ingested and used; both (specie, source)."""
    rows = ingested.select("specie", "source", F.lit("ingested").alias("k")).unionByName(used.select("specie", "source", F.lit("used").alias("k")))
    wiki = F.col("source").startswith("wikipedia:")
    n = lambda k, cond: F.count_distinct(F.when((F.col("k") == k) & cond, F.col("source"))).cast("string")
    per = rows.groupBy("specie").agg(F.concat(F.lit(": PDFs "), n("ingested", ~wiki), F.lit(" ingested / "), n("used", ~wiki), F.lit(" used; Wikipedia "), n("ingested", wiki), F.lit(" ingested / "), n("used", wiki), F.lit(" used")).alias("_c"))
    listed = F.array_sort(F.collect_list(F.concat("specie", "_c")))  # a row for each species
    return per.agg(F.when(F.count(F.lit(1)) > 0, F.concat(F.lit("Counts: "), F.array_join(listed, "; "))).otherwise("Counts: none").alias("line"))
