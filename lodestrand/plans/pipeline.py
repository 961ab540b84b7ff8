"""The whole flow: chunks, extraction, graph, mapping, similarity, tiers, synthesis."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as T
from ..operators import extract, graph, mapping, tiers, vectors


@dataclass
class Models:
    """The calls that a model would answer; the defaults work offline."""

    extractor: extract.Extractor
    embedder: extract.Embedder = field(default_factory=extract.hashing_embedder)
    verifier: extract.Verifier = field(default_factory=extract.top_candidate_verifier)
    normalizer: extract.Normalizer = extract.keep_as_is
    summarizer: extract.Synthesizer | None = None


def index_chunks(chunks: DataFrame, models: Models, triple_index_mode: str = "original") -> dict[str, DataFrame]:
    """chunks: (chunk_id, species_norm, content, ...) to entity, mention and relation tables. What is read more than once is stored: texts are cut once."""
    chunks = graph.settled(chunks.select("chunk_id", "species_norm", "source_path", "chunk_index", "text_snippet", "content"))
    out = extract.parsed(extract.extracted(chunks.where(~T.is_junk_chunk("content")), models.extractor))
    out = graph.settled(out)
    ent = graph.settled(extract.valid_entities(out))
    entities = graph.first_of(ent, ["entity_id"], ["chunk_id", "pos"]).select("entity_id", "surface_form", "entity_type", "species_norm", F.lower("surface_form").alias("canonical"))
    known = chunks.select("chunk_id", "species_norm", "source_path", "chunk_index", "text_snippet")
    return {"doc_chunk": known, "doc_entity": graph.settled(entities), "mentions": graph.settled(ent.select("chunk_id", "entity_id", "species_norm").distinct()), "related_to": extract.valid_triples(out, ent, triple_index_mode)}


def enrich(tables: dict[str, DataFrame], terms: DataFrame, models: Models, threshold: float = S.SIMILAR) -> dict[str, DataFrame]:
    """Maps entities to terms, lays IS_A flat, counts fan-in and pairs similar entities."""
    terms = graph.settled(terms)
    e = tables["doc_entity"].withColumn("upheno_enriched", F.lit(False))
    todo = graph.entities_to_map(tables["mentions"], tables["doc_chunk"], e)
    done = mapping.fan_out(todo, mapping.map_forms(todo.select(F.col("surface_form").alias("raw_trait")), terms, models.embedder, models.verifier, models.normalizer))
    done = graph.settled(done)
    mapped = done.where("mapped").select("entity_id", "term_id", "term_name", "cosine_score", "confidence", "broadened")
    parents = terms.select(F.col("id").alias("child_id"), F.explode("parents").alias("parent_id"))
    is_a = graph.settled(graph.flattened(mapped.select("term_id").distinct(), parents))
    sets = graph.entity_species(tables["mentions"], tables["doc_chunk"]).groupBy("entity_id").agg(F.array_sort(F.collect_set("species_norm")).alias("groups"))
    similar_in = extract.embedded(e.where(F.col("entity_type").isin(S.SIMILARITY_TYPES)).select("entity_id", "surface_form"), "surface_form", models.embedder).join(sets, "entity_id").select(F.col("entity_id").alias("id"), "vector", "groups")
    return tables | {"mapping": done, "doc_mapped_to": mapped, "is_a": is_a, "fan_in": graph.fan_in(is_a), "doc_similar_to": vectors.both_directions(vectors.similar_pairs(similar_in, threshold))}


def converge(t: dict[str, DataFrame], n_species: int, min_species: int | None = None, tier2_threshold: float = S.SIMILAR) -> dict[str, DataFrame]:
    """Tier 1, its relations and tier 2, with the subgraphs of all species."""
    least = min_species or max(2, n_species // 2)
    cand = tiers.tier1_candidates(t["mentions"], t["doc_chunk"], t["doc_entity"], t["doc_mapped_to"], t["is_a"], t["fan_in"], least)
    has_fan_in = not cand.where("fan_in >= 0").isEmpty()
    species_of = graph.entity_species(t["mentions"], t["doc_chunk"])
    counts = graph.mention_counts(t["mentions"], t["doc_chunk"], t["doc_entity"])
    triples = graph.surface_triples(t["related_to"], t["mentions"], t["doc_chunk"], t["doc_entity"])
    edges = graph.settled(tiers.unordered_pairs(tiers.tier2_pairs(t["doc_similar_to"], t["doc_entity"], species_of, tier2_threshold), least))
    labels = tiers.components(edges)
    clusters = tiers.tier2_clusters(edges, labels, least)
    return {
        "tier1": tiers.tier1_ranked(cand, n_species) if has_fan_in else tiers.tier1_fallback(cand),
        "tier1_relational": tiers.tier1_relational(t["related_to"], t["doc_entity"], t["doc_mapped_to"], t["is_a"], least),
        "tier2": clusters,
        "tier2_members": tiers.cluster_members(clusters, labels),
        "subgraphs": graph.subgraphs(graph.collapsed_entities(counts, t["doc_mapped_to"]), graph.rewritten_triples(triples, counts, t["doc_mapped_to"]), t["doc_chunk"]),
    }


def tier1_text(rows: DataFrame, names: DataFrame | None = None, limit: int = 8) -> DataFrame:
    """One line per community, in order of score, with display names where there are any."""
    line = F.format_string("- %s (%d species, score %.3f)", F.col("term_id"), F.col("n_species"), F.col("score"))
    if names is not None:
        rows = rows.join(names, "term_id", "left")
        line = F.format_string("- %s (%d species, score %.3f)", F.coalesce("name", "term_id"), F.col("n_species"), F.col("score"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k"), "term_id", line.alias("line"))))
    return rows.agg(F.array_join(F.transform(F.slice(listed, 1, limit), lambda x: x["line"]), "\n").alias("text"))


def synthesize(template: str, sections: dict[str, str], call: extract.Synthesizer, attempts: int = 3) -> str | None:
    """The answer to a filled template; null after so many failures."""
    for name, value in sections.items():
        template = template.replace("{" + name + "}", value)
    for _ in range(attempts):
        try:
            return call(template)
        except Exception:
            continue
    return None
