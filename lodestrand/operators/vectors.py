"""Diversified selection and retrieval; nearest neighbours and similar pairs are in cells.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as T
from ..functions import vectors as V
from .cells import nearest, similar_pairs  # noqa: F401  part of this module's offer


def both_directions(pairs: DataFrame) -> DataFrame:
    """Each pair both ways; pairs are computed once."""
    way = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), "score")
    return pairs.select(F.inline(F.array(way("a", "b"), way("b", "a"))))


def mmr(candidates: DataFrame, group: str, k: int = S.FINAL_K, weight: float = S.MMR_LAMBDA) -> DataFrame:
    """V3 for each group: candidates (group, id, distance, vector, query) that are chosen, with their place.

    Each next one is the best balance of nearness to the query and distance
    from those chosen; equal ones go by distance and id. A group holds the
    candidates of one query, which nearest() limits; they are one array, and a
    choice is a step over it that keeps for each candidate its greatest
    likeness to any that is chosen. Likeness counts to nine digits. Candidates
    without a vector come last, in order.
    """
    like = lambda a, b: F.round(V.dot(a, b), 9)
    low = F.lit(float("-inf"))
    row = F.struct(*[F.col(f"`{c}`") for c in candidates.columns])
    unit = V.normalized("vector")
    each = candidates.select(F.col(group).alias("_group"), F.struct("distance", "id", like(unit, V.normalized("query")).alias("rel"), low.alias("worst"), unit.alias("v"), row.alias("row")).alias("x"))
    packed = each.groupBy("_group").agg(F.array_sort(F.collect_list("x")).alias("left"))
    start = F.struct(F.col("left"), F.slice(F.transform("left", lambda x: x["row"]), 1, 0).alias("chosen"))

    def step(state, _):
        first = F.size(state["chosen"]) == 0
        value = lambda x: F.when(first, x["rel"]).otherwise(F.round(weight * x["rel"] - (1 - weight) * x["worst"], 9))
        best = F.array_max(F.transform(state["left"], lambda x, i: F.struct(value(x).alias("value"), (-i).alias("i"))))

        def taken(at, own):
            rest = F.filter(state["left"], lambda x, i: i != at)
            rest = F.transform(rest, lambda x: F.struct(x["distance"].alias("distance"), x["id"].alias("id"), x["rel"].alias("rel"), F.greatest(x["worst"], like(x["v"], own["v"])).alias("worst"), x["v"].alias("v"), x["row"].alias("row")))
            return F.struct(rest.alias("left"), F.concat(state["chosen"], F.array(own["row"])).alias("chosen"))

        # arrays of one element bind what is used for each candidate to a name, so that it is found once
        one = F.transform(F.array(-best["i"]), lambda at: F.transform(F.array(F.get(state["left"], at)), lambda own: taken(at, own))[0])[0]
        return F.when(F.size(state["left"]) > 0, one).otherwise(state)

    chosen = F.aggregate(F.sequence(F.lit(1), F.lit(k)), start, step, lambda state: state["chosen"])
    return packed.select(F.posexplode(chosen).alias("place", "_row")).select("_row.*", "place")


def candidate_key(doc_id: str = "doc_id", source: str = "source_path", index: str = "chunk_index", content: str = "content"):
    """D3: by document and index, else by source and index, else by the content."""
    c = F.col
    tag = lambda kind, *cols: F.concat_ws("|", F.lit(kind), *[x.cast("string") for x in cols])
    return F.when(c(doc_id).isNotNull() & c(index).isNotNull(), tag("doc_id", c(doc_id), c(index))).when(c(source).isNotNull() & c(index).isNotNull(), tag("source_path", c(source), c(index))).otherwise(tag("content_hash", F.sha2(content, 256)))


def united_candidates(a: DataFrame, b: DataFrame, keys: list[str], distance: str = "distance") -> DataFrame:
    """Both lists, each key once at its least distance."""
    both = a.unionByName(b)
    rest = [c for c in both.columns if c not in (*keys, distance)]
    return both.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(distance, *rest)).alias("_r"), F.min(distance).alias(distance)).select(*keys, *[f"_r.{c}" for c in rest], distance)


def within_margin(rows: DataFrame, group: str, margin: float = S.SCORE_MARGIN, distance: str = "distance", threshold: float | None = None) -> DataFrame:
    """Rows at most `margin` beyond the best of their group and, if given, below a threshold."""
    out = rows.withColumn("_best", F.min(distance).over(Window.partitionBy(group))).where(F.col(distance) <= F.col("_best") + margin).drop("_best")
    return out if threshold is None else out.where(F.col(distance) <= threshold)


def per_document(rows: DataFrame, group: list[str], doc: str = "doc_id", limit: int = S.PER_DOC, order: list[str] | None = None) -> DataFrame:
    """W8's last step: so many rows of each document, the nearest first."""
    w = Window.partitionBy(*group, doc).orderBy(*(order or ["distance", "id"]))
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


def nearest_share(rows: DataFrame, group: str, share: float = 0.6, distance: str = "distance") -> DataFrame:
    """W7's last step: the nearest share of each group, one row at least."""
    w = Window.partitionBy(group)
    n = F.greatest(F.lit(1), F.ceil(F.lit(share) * F.count(F.lit(1)).over(w)))
    return rows.withColumns({"_n": n, "_r": F.row_number().over(w.orderBy(distance, "id"))}).where(F.col("_r") <= F.col("_n")).drop("_n", "_r")


def retrieve(chunks: DataFrame, queries: DataFrame, group: str = "specie", fetch: int = S.FETCH_K, final: int = S.FINAL_K, margin: float = S.SCORE_MARGIN, threshold: float | None = None, per_doc: int = S.PER_DOC) -> DataFrame:
    """(query_id, id, distance, place, ...): per query two searches among its group's chunks, united, diversified, cut at the margin and by document.

    chunks: (id, group, doc_id, vector), ids once each. queries: (query_id,
    group, vector1, vector2); the balance is against their mean.
    """
    search = lambda n: nearest(queries.select("query_id", group, F.col(f"vector{n}").alias("vector")), chunks.select("id", "vector", group), fetch, "l2", by=group)
    both = search(1).unionByName(search(2)).groupBy("query_id", "id").agg(F.min("score").alias("distance"))
    mean = queries.select("query_id", F.zip_with("vector1", "vector2", lambda x, y: (x.cast("double") + y.cast("double")) / 2).alias("query"))
    chosen = mmr(both.join(chunks.select("id", "doc_id", "vector"), "id").join(mean, "query_id"), "query_id", final).drop("query", "vector")
    return per_document(within_margin(chosen, "query_id", margin, threshold=threshold), ["query_id"], limit=per_doc)


def allowed_citations(bullets: DataFrame, allowed: DataFrame) -> DataFrame:
    """Bullets (id, trait, tags) with those of their tags that were retrieved, in order; without trait or tags they go."""
    tags = bullets.select("id", "trait", F.posexplode("tags").alias("pos", "tag")).join(allowed.select("tag").distinct(), "tag", "left_semi")
    kept = tags.groupBy("id", "trait").agg(F.array_sort(F.collect_list(F.struct("pos", "tag"))).alias("_t"))
    return kept.select("id", "trait", F.array_distinct(F.transform("_t", lambda x: x["tag"])).alias("tags")).where(F.coalesce(T.strip("trait"), F.lit("")) != "")


def best_hits(hits: DataFrame) -> DataFrame:
    """The best search hit of each name (name, rank, title, snippet); the first of equals, and the first if all score below 0."""
    s = F.greatest(T.hit_score("name", "title", "snippet"), F.lit(-1))
    return hits.groupBy("name").agg(F.max_by(F.struct("title", "rank"), F.struct(s.alias("s"), (-F.col("rank")).alias("r"))).alias("b")).select("name", "b.title", "b.rank")
