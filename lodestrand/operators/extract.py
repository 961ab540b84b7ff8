"""Model calls as functions that are handed in, and what is made of their output.

Every protocol has a deterministic offline default. They make no claim to
agree with a real model; they make the pipeline whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as T

Extractor = Callable[[str, str], str]  # chunk, species -> JSON text
Normalizer = Callable[[list[str]], list[str]]
Embedder = Callable[[list[str]], np.ndarray]
Verifier = Callable[[str, list[dict]], dict]
Synthesizer = Callable[[str], str]


def dictionary_extractor(terms: dict[str, str], relation: str = "ASSOCIATED_WITH") -> Extractor:
    """Finds the words of a dictionary {form: type}; forms that follow each other in a sentence are related."""
    found = re.compile("|".join(rf"\b{re.escape(t)}\b" for t in sorted(terms, key=len, reverse=True)) or r"(?!)", re.IGNORECASE)
    low = {k.lower(): v for k, v in terms.items()}

    def extract(chunk: str, species: str) -> str:
        hits = [(m[0], m.start()) for m in found.finditer(chunk)]
        sentence = [chunk.count(".", 0, at) for _, at in hits]
        triples = [{"subj_idx": i, "relation": relation, "obj_idx": i + 1} for i in range(len(hits) - 1) if sentence[i] == sentence[i + 1]]
        return json.dumps({"entities": [{"text": t, "type": low[t.lower()]} for t, _ in hits], "triples": triples})

    return extract


def hashing_embedder(dim: int = 64) -> Embedder:
    """Sums a signed unit for every word and three-letter string; texts that share them are near."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            low = f" {t.lower()} "
            for part in [*low.split(), *(low[k : k + 3] for k in range(len(low) - 2))]:
                h = int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "big")
                out[i, h % dim] += 1 if h >> 32 & 1 else -1
        return out

    return embed


def keep_as_is(texts: list[str]) -> list[str]:
    return list(texts)


def top_candidate_verifier(least: float = 0.6) -> Verifier:
    """Accepts the first candidate at medium from a set cosine on, below it at low."""

    def verify(trait: str, candidates: list[dict]) -> dict:
        if not candidates:
            return {"confidence": "no_match", "term_id": None, "reasoning": "no candidates"}
        top = candidates[0]
        return {"confidence": "medium" if (top.get("cosine_score") or 0.0) >= least else "low", "term_id": top["id"], "term_name": top.get("name"), "reasoning": "first candidate"}

    return verify


def embedded(rows: DataFrame, text: str, embedder: Embedder, out: str = "vector", batch: int = 256) -> DataFrame:
    """V5, U4: rows with the vectors of their texts; each distinct text is embedded once. A failed batch gives zeros."""
    import pyspark.sql.types as PT

    distinct = rows.select(F.col(text).alias("_t")).where("_t is not null").distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dim = 0
        for frame in frames:
            texts, vectors = frame["_t"].tolist(), []
            for k in range(0, len(texts), batch):
                part = texts[k : k + batch]
                try:
                    got = np.asarray(embedder(part), dtype=np.float32)
                except Exception:
                    got = np.zeros((len(part), dim or 1024), np.float32)
                dim = got.shape[1]
                vectors += got.tolist()
            yield pd.DataFrame({"_t": texts, out: vectors})

    schema = PT.StructType([PT.StructField("_t", PT.StringType()), PT.StructField(out, PT.ArrayType(PT.FloatType()))])
    return rows.join(distinct.mapInPandas(run, schema), rows[text] == F.col("_t"), "left").drop("_t")


def extracted(chunks: DataFrame, extractor: Extractor, text: str = "content", attempts: int = 2) -> DataFrame:
    """chunk_id, species_norm and the extractor's raw output; null after so many failures."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def call(chunk, species):
            for _ in range(attempts):
                try:
                    return extractor(chunk, species)
                except Exception:
                    continue
            return None

        for frame in frames:
            yield pd.DataFrame({"chunk_id": frame["chunk_id"], "species_norm": frame["species_norm"], "raw": [call(c, s) for c, s in zip(frame["text"], frame["species_norm"])]})

    return chunks.select("chunk_id", "species_norm", F.col(text).alias("text")).mapInPandas(run, "chunk_id string, species_norm string, raw string")


def parsed(raw: DataFrame) -> DataFrame:
    """The JSON of raw output, without thoughts and fences; empty lists if it can't be read."""
    read = raw.select("chunk_id", "species_norm", F.from_json(T.unfence(T.without_thoughts("raw")), S.EXTRACTION).alias("_j"))
    empty = lambda c: F.coalesce(f"_j.{c}", F.array())
    return read.select("chunk_id", "species_norm", empty("entities").alias("entities"), empty("triples").alias("triples"))


def _stays(e: Column) -> Column:
    """Whether an entity (surface_form, entity_type) has a text and a known type."""
    form = e["surface_form"]
    return (F.coalesce(form, F.lit("")) != "") & e["entity_type"].isin(S.ENTITY_TYPES) & T.junk_entity_reason(form).isNull()


def _stripped(entities: str = "entities") -> Column:
    """The list's entities as (surface_form, entity_type); stripped before they become rows, as each rule would do it anew after."""
    return F.transform(entities, lambda e: F.struct(T.strip(e["text"]).alias("surface_form"), e["type"].alias("entity_type")))


def valid_entities(extractions: DataFrame) -> DataFrame:
    """chunk_id, species_norm, pos, entity_id, surface_form, entity_type; in a chunk the first of each id stays."""
    rows = extractions.select("chunk_id", "species_norm", F.posexplode(_stripped()).alias("pos", "e")).where(_stays(F.col("e"))).select("chunk_id", "species_norm", "pos", "e.*")
    rows = rows.withColumn("entity_id", T.entity_id("entity_type", "surface_form"))
    first = Window.partitionBy("chunk_id", "entity_id").orderBy("pos")
    return rows.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def valid_triples(extractions: DataFrame, entities: DataFrame | None = None, index_mode: str = "original") -> DataFrame:
    """subj_id, relation_type, obj_id, chunk_id, species_norm.

    index_mode `original`: indexes point into the model's own list, and a
    triple goes if an end was dropped. `compat`: they point into the list that
    is left after validation. entities: valid_entities(), or those of them that
    stay; without them they are found in each row's own list, and nothing is
    shuffled for them. A chunk is one row.
    """
    if index_mode not in ("original", "compat"):
        raise ValueError(index_mode)
    each = F.transform(_stripped(), lambda e: F.struct(T.entity_id(e["entity_type"], e["surface_form"]).alias("id"), _stays(e).alias("stays")))
    rows = extractions.select("chunk_id", "species_norm", each.alias("_each"), F.filter("triples", lambda t: t["relation"].isin(S.RELATION_TYPES)).alias("triples"))
    if entities is None:
        # the first of each id, in order
        rows = rows.withColumn("_kept", F.array_distinct(F.transform(F.filter("_each", lambda e: e["stays"]), lambda e: e["id"])))
    else:
        kept = entities.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "entity_id"))), lambda x: x["entity_id"]).alias("_kept"))
        rows = rows.join(kept, "chunk_id")
    # an entity that repeats an earlier one stands for that one
    own = F.transform("_each", lambda e: F.when(F.array_contains("_kept", e["id"]), e["id"]))
    # before the explosion, as they would be found for each triple after it
    rows = rows.select("chunk_id", "species_norm", "triples", (own if index_mode == "original" else F.col("_kept")).alias("ids"))
    t = rows.select("chunk_id", "species_norm", "ids", F.explode("triples").alias("t"))
    at = lambda c: F.get("ids", F.col(f"t.{c}").try_cast("int"))
    t = t.select(at("subj_idx").alias("subj_id"), F.col("t.relation").alias("relation_type"), at("obj_idx").alias("obj_id"), "chunk_id", "species_norm")
    return t.where("subj_id is not null and obj_id is not null").distinct()
