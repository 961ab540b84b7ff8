"""The property graph as node and edge tables: upserts, closures, subgraphs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as T
from ..places import stored as settled


def keep_latest(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """An upsert by key; of several new rows of a key the first by `order` stays."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rank = Window.partitionBy(*keys).orderBy(F.desc("_new"), *(order or [F.col(c) for c in new.columns if c not in keys]))
    return both.withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_r", "_new")


def fill_blank(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """K4: an upsert that replaces a value only if it is null or empty."""
    a, b = old.select(key, F.col(value).alias("_o")), new.select(key, F.col(value).alias("_n"))
    return a.join(b, key, "full").select(key, F.coalesce(T.falsy_null("_o"), "_n", "_o").alias(value))


def without_run(edges: DataFrame, run_id: str) -> DataFrame:
    """K6"""
    return edges.where(~F.col("run_id").eqNullSafe(F.lit(run_id)))


def first_of(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def entity_species(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Which entity is mentioned by which species: from the chunks, as an entity itself has no species of its own."""
    return mentions.select("chunk_id", "entity_id").join(chunks.select("chunk_id", "species_norm"), "chunk_id").select("entity_id", "species_norm").distinct()


def mention_counts(mentions: DataFrame, chunks: DataFrame, entities: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Mentions of each entity by species."""
    e = entities if types is None else entities.where(F.col("entity_type").isin(types))
    counted = mentions.select("chunk_id", "entity_id").join(chunks.select("chunk_id", "species_norm"), "chunk_id").groupBy("species_norm", "entity_id").agg(F.count(F.lit(1)).alias("mention_count"))
    return counted.join(e.select("entity_id", "surface_form", "entity_type"), "entity_id")


def entities_to_map(mentions: DataFrame, chunks: DataFrame, entities: DataFrame, force: bool = False) -> DataFrame:
    """Distinct entities of the types that are mapped and, unless forced, not enriched yet."""
    e = entities.where(F.col("entity_type").isin(S.MAPPED_TYPES))
    if not force:
        e = e.where(~F.coalesce("upheno_enriched", F.lit(False)))
    return e.select("entity_id", "surface_form", "entity_type").join(entity_species(mentions, chunks), "entity_id", "left_semi").distinct()


def species_entity_counts(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """A3: distinct entities of each species, of every type."""
    return entity_species(mentions, chunks).groupBy("species_norm").agg(F.count_distinct("entity_id").alias("n_entities"))


def surface_triples(related: DataFrame, mentions: DataFrame, chunks: DataFrame, entities: DataFrame, cross_species: bool = True) -> DataFrame:
    """Distinct (species, subject, relation, object) of the entities a species mentions.

    cross_species: triples that other species say about a shared entity count too.
    """
    about = related.join(entity_species(mentions, chunks).select(F.col("entity_id").alias("subj_id"), F.col("species_norm").alias("_sp")), "subj_id")
    if not cross_species:
        about = about.where(F.col("species_norm") == F.col("_sp"))
    form = lambda k, name: entities.select(F.col("entity_id").alias(k), F.col("surface_form").alias(name))
    return about.join(form("subj_id", "subject"), "subj_id").join(form("obj_id", "object"), "obj_id").select(F.col("_sp").alias("species_norm"), "subject", F.col("relation_type").alias("relation"), "object").distinct()


#: Edges of a hierarchy for each task that goes up a level.
TASK_EDGES = 1 << 15


def ancestors(parents: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """H1: (term_id, ancestor, depth) level by level, only through allowed terms; each at its least depth, a term is not its own."""
    level = start.select("term_id", F.col("term_id").alias("ancestor"))
    edges = parents.where(T.is_allowed_term("parent_id")).select(F.col("child_id").alias("ancestor"), F.col("parent_id").alias("_up"))
    # a few bytes of edges make many pairs, so that tasks go by the number of edges
    n = max(1, math.ceil(edges.count() / TASK_EDGES))
    edges = edges.repartition(n, "ancestor").hint("merge")
    found = None
    for k in range(1, depth + 1):
        level = level.repartition(n, "ancestor").join(edges, "ancestor").select("term_id", F.col("_up").alias("ancestor")).repartition(n, "term_id", "ancestor").distinct()
        found = level.withColumn("depth", F.lit(k)) if found is None else found.unionByName(level.withColumn("depth", F.lit(k)))
    return found.where("term_id <> ancestor").repartition(n, "term_id", "ancestor").groupBy("term_id", "ancestor").agg(F.min("depth").alias("depth"))


def closure_within(is_a: DataFrame, terms: DataFrame, hops: int) -> DataFrame:
    """H2: (term_id, ancestor) within 0 to so many IS_A edges, the term itself included."""
    edges = is_a.select(F.col("child_id").alias("ancestor"), F.col("parent_id").alias("_up"))
    level = terms.select("term_id", F.col("term_id").alias("ancestor")).distinct()
    out = level
    for _ in range(hops):
        level = level.join(edges, "ancestor").select("term_id", F.col("_up").alias("ancestor")).distinct()
        out = out.unionByName(level)
    return out.distinct()


def transitive_closure(is_a: DataFrame) -> DataFrame:
    """H3: all (child_id, parent_id) over one or more edges, cycles included. Each round extends only the pairs that are new."""
    edges = settled(is_a.select("child_id", "parent_id").where("child_id is not null and parent_id is not null").distinct())
    step = edges.select(F.col("child_id").alias("_at"), F.col("parent_id").alias("_up"))
    known = delta = edges
    while True:
        far = delta.join(step, F.col("parent_id") == F.col("_at")).select("child_id", F.col("_up").alias("parent_id")).distinct()
        delta = settled(far.join(known, ["child_id", "parent_id"], "left_anti").select("child_id", "parent_id"))
        if delta.isEmpty():
            return known
        known = known.union(delta)  # what is new is in no earlier round


def fan_in(is_a: DataFrame) -> DataFrame:
    """A2: distinct descendants of every term that has any.

    For edges that are flat, as flattened() lays them: nearly all pairs of the
    closure are edges already. Deep hierarchies: reach.descendant_counts().
    """
    return transitive_closure(is_a).where("child_id <> parent_id").groupBy(F.col("parent_id").alias("term_id")).agg(F.count_distinct("child_id").alias("fan_in"))


def flattened(matched: DataFrame, parents: DataFrame, depth: int = 3) -> DataFrame:
    """IS_A edges from each matched term straight to all of its ancestors."""
    return ancestors(parents, matched, depth).select(F.col("term_id").alias("child_id"), F.col("ancestor").alias("parent_id"))


def collapsed_entities(counts: DataFrame, mapped: DataFrame) -> DataFrame:
    """Entities of a species that share a term become one; single and unmapped ones stay as they are.

    counts: species_norm, entity_id, surface_form, entity_type, mention_count.
    mapped: entity_id, term_id, term_name. Ties go by entity_id.
    """
    rows = counts.join(mapped.select("entity_id", "term_id", "term_name"), "entity_id", "left").withColumn("_g", F.coalesce("term_id", F.concat(F.lit("entity:"), F.col("entity_id"))))
    merged = rows.groupBy("species_norm", "_g").agg(
        F.count(F.lit(1)).alias("n_forms"),
        F.min("entity_id").alias("entity_id"),
        F.min_by("surface_form", "entity_id").alias("_one"),
        F.max_by("entity_type", F.struct("mention_count", F.col("entity_id"))).alias("entity_type"),
        F.sum("mention_count").alias("mention_count"),
        F.first(F.coalesce(T.falsy_null("term_name"), "term_id"), ignorenulls=True).alias("_term"),
    )
    label = F.when(F.col("n_forms") > 1, F.format_string("%s  (merged %d forms)", "_term", "n_forms")).otherwise(F.col("_one"))
    return merged.select("species_norm", "entity_id", label.alias("surface_form"), "entity_type", "mention_count", "n_forms")


def rewritten_triples(triples: DataFrame, counts: DataFrame, mapped: DataFrame) -> DataFrame:
    """Triples with the term's name for forms that were merged, without those that became equal."""
    named = counts.join(mapped.select("entity_id", "term_id", F.coalesce(T.falsy_null("term_name"), "term_id").alias("name")), "entity_id")
    w = Window.partitionBy("species_norm", "term_id")
    # a form that several terms claim gets the last of them by name
    names = named.withColumn("_n", F.count(F.lit(1)).over(w)).where("_n > 1").groupBy("species_norm", "surface_form").agg(F.max("name").alias("name"))
    side = lambda form, name: names.select("species_norm", F.col("surface_form").alias(form), F.col("name").alias(name))
    out = triples.join(side("subject", "_s"), ["species_norm", "subject"], "left").join(side("object", "_o"), ["species_norm", "object"], "left")
    return out.select("species_norm", F.coalesce("_s", "subject").alias("subject"), "relation", F.coalesce("_o", "object").alias("object")).distinct()


def subgraphs(counts: DataFrame, triples: DataFrame, chunks: DataFrame, max_chunks: int = 200, max_triples: int = S.MAX_TRIPLES) -> DataFrame:
    """H5: one row per species: entities by mentions, triples, snippets and sources of its first chunks."""
    top = lambda df, by, n: df.withColumn("_r", F.row_number().over(Window.partitionBy("species_norm").orderBy(*by))).where(F.col("_r") <= n)
    ent = counts.groupBy("species_norm").agg(F.array_sort(F.collect_list(F.struct((-F.col("mention_count")).alias("k"), "entity_id", "surface_form", "entity_type", "mention_count"))).alias("entities"))
    tri = top(triples, ["subject", "relation", "object"], max_triples).groupBy("species_norm").agg(F.array_sort(F.collect_list(F.struct("subject", "relation", "object"))).alias("triples"))
    chk = top(chunks, ["source_path", "chunk_index", "chunk_id"], max_chunks).groupBy("species_norm").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("chunk_id", "text_snippet")))).alias("chunk_texts"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("chunk_id", "source_path")))).alias("chunk_sources"))
    out = chk.join(ent, "species_norm", "left").join(tri, "species_norm", "left")
    return out.withColumns({"n_entities": F.coalesce(F.size("entities"), F.lit(0)), "n_triples": F.coalesce(F.size("triples"), F.lit(0))})


def legacy_edges(traits: DataFrame, is_a: DataFrame, similar: DataFrame | None = None, synonyms: DataFrame | None = None) -> DataFrame:
    """HAS_TRAIT, MAPPED_TO and IS_A edges (kind, src, dst, score) of mapped traits of species, each once; with SIMILAR_TO of similar pairs (src, dst, score) and SYNONYM_OF of synonym_pairs(), which has each pair once already."""
    has = traits.select(F.lit("HAS_TRAIT").alias("kind"), F.col("species").alias("src"), F.col("raw_trait").alias("dst"), F.coalesce("cosine_score", F.lit(0.0)).alias("score"))
    usable = traits.where("mapped and term_id is not null")
    to = usable.select(F.lit("MAPPED_TO"), "raw_trait", "term_id", F.coalesce("cosine_score", F.lit(0.0)))
    up = usable.select("term_id").distinct().join(is_a, F.col("term_id") == F.col("child_id")).select(F.lit("IS_A"), "child_id", "parent_id", F.lit(None).cast("double"))
    out = has.union(to).union(up)
    if similar is not None:
        out = out.union(similar.select(F.lit("SIMILAR_TO"), "src", "dst", "score"))
    out = out.distinct()
    if synonyms is not None:
        out = out.union(synonyms.select(F.lit("SYNONYM_OF"), "src", "dst", F.lit(None).cast("double")))
    return out


def legacy_nodes(traits: DataFrame, is_a: DataFrame) -> DataFrame:
    """(kind, id) of species, traits and terms, each once."""
    terms = traits.where("mapped and term_id is not null").select("term_id").distinct()
    up = terms.join(is_a, F.col("term_id") == F.col("child_id")).select(F.lit("Term").alias("kind"), F.col("parent_id").alias("id"))
    each = traits.select(F.lit("Species").alias("kind"), F.col("species").alias("id")).union(traits.select(F.lit("Trait"), "raw_trait"))
    return each.union(terms.select(F.lit("Term"), "term_id")).union(up).distinct()


#: Members of a group that one key of the join of pairs holds, and pairs that one of its tasks makes, on average.
PAIR_BLOCK, TASK_PAIRS = 512, 1 << 21


def synonym_pairs(members: DataFrame) -> DataFrame:
    """Both directions between members (group_id, pos, species, raw_trait) of a group from different species.

    Members that differ in their place only are one row. A group of any size is
    cut into blocks, each of which meets the whole group. Traits that are in
    one group and species only make no pair twice; just the others' pairs are
    compared with each other.
    """
    rows = members.where("group_id is not null and pos is not null and species is not null").groupBy("group_id", "species", "raw_trait").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    rows = settled(rows.withColumn("once", F.count(F.lit(1)).over(Window.partitionBy("raw_trait")) == 1))
    sizes = rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0
    rows = rows.join(sizes.select("group_id", F.ceil(F.col("n") / PAIR_BLOCK).cast("int").alias("blocks")), "group_id")

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        x = x.withColumn("block", F.pmod(F.xxhash64("raw_trait", "species"), F.col("blocks")).cast("int")).repartition(max(1, min(8192, int(total / TASK_PAIRS))), "group_id", "block").alias("x")
        y = y.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("y")
        # two members at one place are no pair
        apart = (F.col("x.lo") != F.col("y.hi")) | (F.col("x.hi") != F.col("y.lo"))
        on = (F.col("x.group_id") == F.col("y.group_id")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.species") != F.col("y.species")) & apart
        return x.join(y, on).select(F.col("x.raw_trait").alias("src"), F.col("y.raw_trait").alias("dst"))

    once, more = rows.where("once"), rows.where("not once")
    if more.isEmpty():
        return met(once, once)
    return met(once, once).union(met(more, rows).union(met(once, more)).distinct())
