"""Mapping surface forms to terms: cheap decisions first, a verifier for the rest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..sources.snapshots import SnapshotTable
from .extract import Embedder, Normalizer, Verifier, embedded, keep_as_is
from .graph import keep_latest, settled
from .vectors import nearest


def decision(score, accept: float = S.ACCEPT, reject: float = S.REJECT):
    """V6: what the best candidate's score decides."""
    return F.when(score.isNull() | (score < reject), "reject").when(score >= accept, "accept").otherwise("verify")


def normalized(forms: DataFrame, normalizer: Normalizer = keep_as_is) -> DataFrame:
    """(raw_trait, normalized_trait) in batches; blank output gives the form back, a failed batch is tried one by one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(x):
            try:
                return normalizer([x])[0]
            except Exception:
                return x

        for frame in frames:
            raw = frame["raw_trait"].tolist()
            try:
                out = normalizer(raw)
                out = out if len(out) == len(raw) else [one(x) for x in raw]
            except Exception:
                out = [one(x) for x in raw]
            yield pd.DataFrame({"raw_trait": raw, "normalized_trait": [o if o and o.strip() else r for o, r in zip(out, raw)]})

    return forms.select("raw_trait").mapInPandas(run, "raw_trait string, normalized_trait string")


def _verified(asked: DataFrame, verifier: Verifier) -> DataFrame:
    """A verdict for each row's candidates. Only terms that exist are accepted; a failure is no match, marked as such."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for raw, normal, listed in zip(frame["raw_trait"], frame["normalized_trait"], frame["candidates"]):
                listed = [c if isinstance(c, dict) else c.asDict() for c in listed]
                try:
                    v = verifier(normal, listed) or {}
                    out.append((raw, v.get("confidence") or "no_match", v.get("term_id"), v.get("reasoning") or "", True))
                except Exception as e:
                    out.append((raw, "no_match", None, f"verifier failed: {type(e).__name__}", False))
            yield pd.DataFrame(out, columns=["raw_trait", "verdict", "verdict_id", "reasoning", "clean"])

    return asked.select("raw_trait", "normalized_trait", "candidates").mapInPandas(run, "raw_trait string, verdict string, verdict_id string, reasoning string, clean boolean")


def top_candidates(traits: DataFrame, terms: DataFrame, k: int = S.CANDIDATES) -> DataFrame:
    """(raw_trait, candidates): the k nearest terms of each trait (raw_trait, vector), best first."""
    hits = nearest(traits.select(F.col("raw_trait").alias("query_id"), "vector"), terms.select("id", F.col("embedding").alias("vector")), k)
    named = hits.join(terms.select("id", "name"), "id")
    listed = F.array_sort(F.collect_list(F.struct("rank", "id", "name", F.col("score").alias("cosine_score"))))
    return named.groupBy(F.col("query_id").alias("raw_trait")).agg(listed.alias("candidates"))


def map_forms(forms: DataFrame, terms: DataFrame, embedder: Embedder, verifier: Verifier, normalizer: Normalizer = keep_as_is, cache: DataFrame | None = None, k: int = S.CANDIDATES) -> DataFrame:
    """One row (schemas.MAPPING and clean) per distinct form (raw_trait).

    Forms in the cache are done. Others are normalised, embedded once per
    normalised text and held against the terms; only what falls between the
    two bounds is verified, and a low verdict is verified again against the
    term's parents. Only rows with `clean` should go into a cache.
    """
    forms = forms.select("raw_trait").where("raw_trait is not null").distinct()
    done = None
    if cache is not None:
        done = cache.join(forms, "raw_trait", "left_semi").withColumn("clean", F.lit(True))
        forms = forms.join(cache, "raw_trait", "left_anti")
    traits = embedded(normalized(forms, normalizer), "normalized_trait", embedder)
    rows = traits.join(top_candidates(traits, terms, k), "raw_trait", "left").select("raw_trait", "normalized_trait", "candidates")
    top = F.col("candidates")[0]
    rows = rows.withColumns({"score": top["cosine_score"], "decision": decision(top["cosine_score"])})
    rows = settled(rows)
    none = F.lit(None).cast("string")
    accept = rows.where("decision = 'accept'").select("raw_trait", "normalized_trait", top["id"].alias("term_id"), F.lit("high").alias("confidence"), F.col("score").alias("cosine_score"), F.lit("accepted by score").alias("reasoning"), F.lit(False).alias("broadened"), F.lit(True).alias("clean"))
    reject = rows.where("decision = 'reject'").select("raw_trait", "normalized_trait", none, F.lit("no_match"), F.lit(None).cast("double"), F.lit("rejected by score"), F.lit(False), F.lit(True))
    asked = rows.where("decision = 'verify'")
    first = asked.join(_verified(asked, verifier), "raw_trait")
    first = settled(first)
    own = F.get(F.transform(F.filter("candidates", lambda c: c["id"] == F.col("verdict_id")), lambda c: c["cosine_score"]), F.lit(0))
    sure = F.col("verdict").isin("high", "medium")
    up = first.where((F.col("verdict") == "low") & F.col("verdict_id").isNotNull())
    parents = up.join(terms.select(F.col("id").alias("verdict_id"), F.posexplode("parents").alias("pos", "pid")), "verdict_id").join(terms.select(F.col("id").alias("pid"), "name"), "pid")
    wider = parents.groupBy("raw_trait", "normalized_trait").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("rank"), F.col("pid").alias("id"), "name", F.lit(None).cast("double").alias("cosine_score")))).alias("candidates"))
    second = _verified(wider, verifier).where(sure).select("raw_trait", F.col("verdict").alias("v2"), F.col("verdict_id").alias("id2"), F.col("reasoning").alias("r2"))
    judged = first.join(second, "raw_trait", "left").select(
        "raw_trait", "normalized_trait", F.when(sure, F.col("verdict_id")).otherwise(F.col("id2")), F.when(sure, F.col("verdict")).otherwise(F.coalesce("v2", F.lit("no_match"))),
        F.when(sure, own), F.coalesce("r2", "reasoning"), ~sure & F.col("id2").isNotNull(), "clean",
    )
    out = accept.union(reject).union(judged)
    # a verdict counts only for a term that the index has
    out = out.join(terms.select(F.col("id").alias("term_id"), F.col("name").alias("term_name")).withColumn("_in", F.lit(True)), "term_id", "left")
    ok = F.coalesce("_in", F.lit(False))
    out = out.select(
        "raw_trait", "normalized_trait", F.when(ok, F.col("term_id")).alias("term_id"), "term_name", F.when(ok | F.col("term_id").isNull(), F.col("confidence")).otherwise("no_match").alias("confidence"),
        F.when(ok, F.col("cosine_score")).alias("cosine_score"), "reasoning", ok.alias("mapped"), (ok & F.col("broadened")).alias("broadened"), "clean",
    )
    return out if done is None else out.unionByName(done)


def map_with_memo(forms: DataFrame, terms: DataFrame, embedder: Embedder, verifier: Verifier, memo: SnapshotTable, normalizer: Normalizer = keep_as_is, model: str = "default", k: int = S.CANDIDATES) -> DataFrame:
    """map_forms() with a memo that lasts from run to run; rows and `from_memo`, whether no call was needed.

    memo: a table with the keys raw_trait and model, which is read first and
    gets the clean results of what wasn't in it. Another model's answers don't
    count. What failed isn't kept, so it is tried again.
    """
    known = memo.read().where(F.col("model") == model).drop("model") if memo.versions() else None
    out = settled(map_forms(forms, terms, embedder, verifier, normalizer, known, k))
    if known is None:
        held = out.withColumn("from_memo", F.lit(False))
    else:
        held = out.join(known.select("raw_trait", F.lit(True).alias("from_memo")), "raw_trait", "left").withColumn("from_memo", F.coalesce("from_memo", F.lit(False)))
    memo.upsert(held.where("clean and not from_memo").drop("clean", "from_memo").withColumn("model", F.lit(model)))
    return held


def cache_after(cache: DataFrame, mapped: DataFrame) -> DataFrame:
    """The cache with all clean results, the latest of each form."""
    return keep_latest(cache, mapped.where("clean").drop("clean"), ["raw_trait"])


def fan_out(entities: DataFrame, mapped: DataFrame) -> DataFrame:
    """Each entity with the result of its surface form."""
    return entities.join(mapped, F.col("surface_form") == F.col("raw_trait"))


def type_stats(rows: DataFrame) -> DataFrame:
    """Per entity type: seen, mapped, no match, rate, mean cosine of those with one."""
    got = F.count_if("mapped")
    return rows.groupBy("entity_type").agg(
        F.count(F.lit(1)).alias("seen"), got.alias("mapped"), (F.count(F.lit(1)) - got).alias("no_match"), F.round(got / F.count(F.lit(1)), 3).alias("map_rate"),
        F.round(F.avg(F.when(F.col("mapped"), F.nullif("cosine_score", F.lit(0.0)))), 3).alias("avg_cosine"),
    )


def merge_stats(rows: DataFrame) -> DataFrame:
    """How many forms share a term, and how far their scores spread; rows: (surface_form, term_id, cosine_score) of what was mapped."""
    per = rows.groupBy("term_id").agg(F.count_distinct("surface_form").alias("n"), (F.max("cosine_score") - F.min("cosine_score")).alias("spread"))
    return per.agg(
        F.count(F.lit(1)).alias("n_terms"), F.round(F.avg("n"), 3).alias("forms_per_term"), F.count_if(F.col("n") > 1).alias("n_shared"), F.sum(F.col("n") - 1).alias("n_redundant"), F.round(F.avg(F.when(F.col("n") > 1, F.col("spread"))), 3).alias("avg_spread"),
    )


def parents_of(terms: DataFrame, ids: DataFrame) -> DataFrame:
    """Parents of terms that the index has, in their order."""
    return ids.join(terms.select(F.col("id").alias("term_id"), F.posexplode("parents").alias("pos", "parent_id")), "term_id").join(terms.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").withColumn("pos", F.row_number().over(Window.partitionBy("term_id").orderBy("pos")) - 1)
