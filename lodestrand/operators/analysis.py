"""Stability of runs, groups of traits, and summaries of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trait_frequency(rows: DataFrame) -> DataFrame:
    """Runs that a trait occurs in; rows: (run, trait)."""
    return rows.groupBy("trait").agg(F.count_distinct("run").alias("n_runs")).orderBy(F.desc("n_runs"), F.lower("trait"))


def citation_drift(rows: DataFrame) -> DataFrame:
    """Per trait: runs, size of the union of citations, mean Jaccard of pairs of runs and against the union.

    rows: (run, trait, source), source null for a run that cites nothing.
    Traits that no run cites anything for are left out. Only runs that share a
    source meet, by that source, and their overlap is what is counted; of all
    other pairs it is known that two runs without citations are equal and the
    rest share nothing, so they enter as numbers.
    """
    cites = rows.where("source is not null").select("trait", "run", "source").distinct()
    sizes = cites.groupBy("trait", "run").agg(F.count(F.lit(1)).alias("n"))
    union = cites.groupBy("trait").agg(F.count_distinct("source").alias("u"))
    per = rows.select("trait", "run").distinct().join(sizes, ["trait", "run"], "left").groupBy("trait").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("n").isNull()).alias("empty"), F.sum("n").alias("cited"))
    sized = cites.join(sizes, ["trait", "run"])
    side = lambda k: sized.select("trait", "source", F.col("run").alias(f"r{k}"), F.col("n").alias(f"n{k}"))
    met = side(1).join(side(2), ["trait", "source"]).where("r1 < r2").groupBy("trait", "r1", "r2", "n1", "n2").agg(F.count(F.lit(1)).alias("both"))
    shared = met.groupBy("trait").agg(F.sum(F.col("both") / (F.col("n1") + F.col("n2") - F.col("both"))).alias("s"))
    of_two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    pairwise = F.when(F.col("runs") > 1, (F.coalesce("s", F.lit(0.0)) + of_two("empty")) / of_two("runs")).otherwise(1.0)
    out = per.join(union, "trait").join(shared, "trait", "left")
    return out.select("trait", F.col("runs").alias("runs_present"), F.col("u").cast("long").alias("citation_union_size"), F.round(pairwise, 3).alias("mean_pairwise_jaccard"), F.round(F.col("cited") / F.col("u") / F.col("runs"), 3).alias("mean_vs_union_jaccard"))


def source_counts(rows: DataFrame) -> DataFrame:
    """A11's counts: runs that cite a source for a trait."""
    return rows.where("source is not null").groupBy("trait", "source").agg(F.count_distinct("run").alias("n_runs"))


def group_counts(groups: DataFrame, freq: DataFrame) -> DataFrame:
    """The sum of the counts of a group's traits; unknown traits count 0."""
    return groups.join(freq, "trait", "left").groupBy("group").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))


def ungrouped(groups: DataFrame, freq: DataFrame) -> DataFrame:
    """U8's rule that each trait is in one group: traits in none or several, with the number of groups."""
    per = groups.groupBy("trait").agg(F.count_distinct("group").alias("n_groups"))
    return freq.join(per, "trait", "left").select("trait", F.coalesce("n_groups", F.lit(0)).alias("n_groups")).where("n_groups <> 1")


def source_usage(rows: DataFrame, group: str, source: str, is_wiki: Column) -> DataFrame:
    """Distinct sources of each group, encyclopedic ones and others."""
    return rows.groupBy(group).agg(F.count_distinct(source).alias("n_sources"), F.count_distinct(F.when(is_wiki, F.col(source))).alias("n_wiki"), F.count_distinct(F.when(~is_wiki, F.col(source))).alias("n_pdf"))


def ingested_sources(chunks: DataFrame) -> DataFrame:
    """The set of sources of each species, by path or else by document."""
    key = F.coalesce(F.nullif("source_path", F.lit("")), F.nullif("doc_id", F.lit("")))
    return chunks.groupBy("species_norm").agg(F.array_sort(F.collect_set(key)).alias("sources"))


def described(rows: DataFrame, value: str, group: str | None = None) -> DataFrame:
    """Count, mean, deviation, least, quartiles, most, and the ratio of most to least."""
    v = F.col(value)
    q = lambda p: F.expr(f"percentile({value}, {p})")
    aggs = [F.count(v).alias("n"), F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev(v), 4).alias("std"), F.min(v).alias("least"), F.round(q(0.25), 4).alias("q1"), F.round(q(0.5), 4).alias("median"), F.round(q(0.75), 4).alias("q3"), F.max(v).alias("most"), F.round(F.max(v) / F.nullif(F.min(v), F.lit(0)), 4).alias("ratio")]
    return (rows.groupBy(group) if group else rows.groupBy()).agg(*aggs)


def distribution(rows: DataFrame, value: str) -> DataFrame:
    """Each value with its count and the share of rows up to it."""
    counts = rows.groupBy(value).agg(F.count(F.lit(1)).alias("n"))  # one row per distinct value, so the window is small
    w = Window.orderBy(value)
    return counts.select(value, "n", F.round(F.sum("n").over(w) / F.sum("n").over(Window.partitionBy()), 6).alias("cdf"))


def bracket(value: str, edges: list[int]) -> Column:
    """The bracket [a, b) of a value, as text; below the first and from the last edge on."""
    out = F.when(F.col(value) < edges[0], f"<{edges[0]}")
    for a, b in zip(edges, edges[1:]):
        out = out.when(F.col(value) < b, f"{a}-{b - 1}")
    return out.otherwise(f">={edges[-1]}")


def theme_share(rows: DataFrame, theme: str, per: int = 10) -> DataFrame:
    """Each theme's count as a share of so many runs, in percent."""
    return rows.groupBy(theme).agg(F.count(F.lit(1)).alias("n")).select(theme, "n", F.round(F.col("n") / per * 100, 2).alias("share")).orderBy(F.desc("n"), theme)
