"""Tables of the knowledge graph, closed domains and default settings."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

# Closed domains. Rows outside them are filtered, never fatal.
ENTITY_TYPES = ["Species", "Anatomy", "Phenotype", "Habitat", "Process", "Gene"]
MAPPED_TYPES = ["Anatomy", "Phenotype", "Habitat", "Process", "Gene"]
SIMILARITY_TYPES = ["Anatomy", "Phenotype", "Process"]
RELATION_TYPES = ["HAS_ANATOMY", "HAS_PHENOTYPE", "LIVES_IN", "PART_OF", "CONTAINS", "INVOLVED_IN", "CAUSES", "ASSOCIATED_WITH"]
TERM_PREFIXES = ["UPHENO", "HP", "MP", "GO", "ENVO", "UBERON", "ZP", "XPO"]
CONFIDENCES = ["high", "medium", "low", "no_match"]
TIERS = ["upheno", "embedding", "merged", "llm"]
#: Roots and near-roots of the term hierarchies, too general to be of interest (fixed values).
GENERIC_TERMS = [
    "HP:0000001", "HP:0000118", "HP:0012823", "UPHENO:0001001", "UPHENO:0001002", "GO:0008150", "GO:0003674", "GO:0005575",
    "GO:0065007", "GO:0008152", "GO:0009987", "GO:0044699", "GO:0071840", "ENVO:00000000", "ENVO:01000254",
]

# Default settings.
CHUNK_SIZE, CHUNK_OVERLAP, MIN_CHUNK = 1000, 200, 80
FETCH_K, FINAL_K, MMR_LAMBDA, SCORE_MARGIN, PER_DOC = 100, 50, 0.5, 0.3, 10
SIMILAR, TIER2_SIMILAR, ACCEPT, REJECT, CANDIDATES = 0.78, 0.80, 0.95, 0.50, 10
MAX_TIER1, MAX_TIER1_FORMS, MAX_RELATIONAL, MAX_CLUSTERS, MAX_PAIRS, MAX_TRIPLES = 20, 200, 50, 30, 500, 5000
NO_FAN_IN_IC = 2.0


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


_S, _I, _L, _D, _B = StringType(), IntegerType(), LongType(), DoubleType(), BooleanType()

SPECIES = _struct(canonical=_S, aliases=ArrayType(_S))
LOCATION = _struct(is_oa=_B, pdf_url=_S)
PAPER = _struct(id=_S, title=_S, publication_year=_I, doi=_S, best_oa_location=LOCATION, primary_location=LOCATION, locations=ArrayType(LOCATION))
CHUNK = _struct(source_path=_S, chunk_index=_I, specie=_S, doc_id=_S, title=_S, publication_year=_I, source=_S, content=_S)
DOC_CHUNK = _struct(chunk_id=_S, species_norm=_S, source_path=_S, doc_id=_S, chunk_index=_I, title=_S, publication_year=_I, text_snippet=_S)
DOC_ENTITY = _struct(entity_id=_S, surface_form=_S, entity_type=_S, species_norm=_S, canonical=_S)
MENTIONS = _struct(chunk_id=_S, entity_id=_S, species_norm=_S)
RELATED_TO = _struct(subj_id=_S, relation_type=_S, obj_id=_S, chunk_id=_S, species_norm=_S)
ONTOLOGY_TERM = _struct(id=_S, name=_S, ontology=_S, synonyms=ArrayType(_S), definition=_S, parents=ArrayType(_S), rich_text=_S, embedding=ArrayType(FloatType()))
IS_A = _struct(child_id=_S, parent_id=_S)
MAPPING = _struct(raw_trait=_S, normalized_trait=_S, term_id=_S, term_name=_S, confidence=_S, cosine_score=_D, reasoning=_S, mapped=_B, broadened=_B)
EXTRACTION = _struct(
    entities=ArrayType(_struct(text=_S, type=_S)),
    triples=ArrayType(_struct(subj_idx=_S, relation=_S, obj_idx=_S)),
)
TRAIT = _struct(trait=_S, sources=ArrayType(_S), confidence=_S)
SYNTHESIS = _struct(strict_common_traits=ArrayType(TRAIT), subgroup_common_traits=ArrayType(TRAIT), mechanism_hypotheses=ArrayType(TRAIT))
COMMUNITY = _struct(label=_S, tier=_S, species_coverage=ArrayType(_S), species_count=_L, supporting_entities=ArrayType(_S), tier3_interpretation=_S)
CANDIDATE_SETS = "`Gene` STRING, `Birch #` INT, `Qn` DOUBLE, `N insertions` INT, `Species` STRING"
