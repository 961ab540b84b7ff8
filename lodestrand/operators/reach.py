"""Numbers of descendants in a hierarchy that may have cycles, without writing its pairs.

Terms that reach each other are one component; components form a hierarchy
without cycles, which is worked on from below. A component's descendants are
words of 64 bits, one for each 64 terms in a row of which it has any: its own
terms' bits, and the union of what lies below it. A component that is done hands
its words on to its parents, where they wait by the parents' levels, so that a
level reads only what is its own. Components with nothing below them have no words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..places import fresh_path, stored


def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges (c, p) that lie on cycles or between them: ends without an edge further on are taken away, again and again."""
    n = edges.count()
    while n:
        edges = edges.join(edges.select(F.col("p").alias("c")).distinct(), "c", "left_semi")
        edges = stored(edges.join(edges.select(F.col("c").alias("p")).distinct(), "p", "left_semi").select("c", "p"))
        left = edges.count()
        if left == n:
            break
        n = left
    return edges


def cycle_components(edges: DataFrame) -> DataFrame:
    """(term, component) of the terms that lie on cycles of edges (c, p); component is the smallest term of it that was found first.

    Each term takes the smallest colour that reaches it. The terms of a colour
    that reach back to the term which gave it are a component; what is left is
    trimmed and coloured anew.
    """
    edges = _trimmed(edges)
    found = edges.select(F.col("c").alias("term"), F.col("p").alias("component")).where("false")
    while not edges.isEmpty():
        colour = stored(edges.select(F.col("c").alias("term")).union(edges.select("p")).distinct().withColumn("colour", F.col("term")))
        while True:
            up = edges.join(colour, F.col("c") == F.col("term")).groupBy(F.col("p").alias("term")).agg(F.min("colour").alias("least"))
            after = stored(colour.join(up, "term", "left").select("term", F.least("colour", "least").alias("colour"), (F.col("least") < F.col("colour")).alias("moved")))
            colour = after.select("term", "colour")
            if after.where("moved").isEmpty():
                break
        same = stored(edges.join(colour.select(F.col("term").alias("c"), F.col("colour").alias("x")), "c").join(colour.select(F.col("term").alias("p"), F.col("colour").alias("y")), "p").where("x = y").select("c", "p"))
        back = step = stored(colour.where("term = colour"))
        while True:
            down = same.join(step, F.col("p") == F.col("term")).select(F.col("c").alias("term"), "colour").distinct()
            step = stored(down.join(back, "term", "left_anti").select("term", "colour"))
            if step.isEmpty():
                break
            back = back.union(step)
        back = stored(back)
        found = stored(found.union(back.select("term", "colour")))
        rest = edges.join(back.select(F.col("term").alias("c")), "c", "left_anti").join(back.select(F.col("term").alias("p")), "p", "left_anti").select("c", "p")
        edges = _trimmed(stored(rest))
    return found


def _levels(edges: DataFrame) -> tuple[DataFrame | None, int]:
    """(component, level) of all parents of an acyclic hierarchy, and the highest level: one more than the highest level below; ends without a child have 0 and no row."""
    at, n, levels = stored(edges.select(F.col("p").alias("component")).distinct()), 0, None
    # those with a path of n edges below them: each round holds only what goes on
    while not at.isEmpty():
        n += 1
        here = at.withColumn("level", F.lit(n))
        levels = here if levels is None else levels.union(here)
        at = stored(edges.join(at, F.col("c") == F.col("component")).select(F.col("p").alias("component")).distinct())
    return None if levels is None else stored(levels.groupBy("component").agg(F.max("level").alias("level"))), n


def descendant_counts(is_a: DataFrame) -> DataFrame:
    """H3, A2: (term_id, fan_in): distinct other terms below every term that has any, over edges (child_id, parent_id) of any depth, cycles included. Edges with a null end count for nothing."""
    spark = is_a.sparkSession
    edges = stored(is_a.select(F.col("child_id").alias("c"), F.col("parent_id").alias("p")).where("c is not null and p is not null and c <> p").distinct())
    on_cycles = cycle_components(edges)
    # numbers in order of the terms: neighbours share words
    terms = edges.select(F.col("c").alias("term")).union(edges.select("p")).distinct().join(on_cycles, "term", "left")
    terms = stored(terms.sort("term").select("term", F.coalesce("component", "term").alias("component"), F.monotonically_increasing_id().alias("n")))
    bits = terms.select("component", F.shiftright("n", 6).alias("word"), F.expr("shiftleft(1L, cast(n & 63 as int))").alias("mask"))
    of = lambda k, name: terms.select(F.col("term").alias(k), F.col("component").alias(name))
    dag = stored(edges.join(of("c", "_c"), "c").join(of("p", "_p"), "p").where("_c <> _p").select(F.col("_c").alias("c"), F.col("_p").alias("p")).distinct())
    levels, top = _levels(dag)
    sizes = terms.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    if top:
        below = dag.join(levels.select(F.col("component").alias("p"), "level"), "p").join(levels.select(F.col("component").alias("c"), F.col("level").alias("child_level")), "c", "left")
        below = stored(below.select("c", "p", "level", "child_level"))
        leaves = below.where("child_level is null").join(bits.withColumnRenamed("component", "c"), "c").select(F.col("p").alias("component"), "word", "mask", "level")
        start = bits.join(levels, "component").select("component", "word", "mask", "level").union(leaves).groupBy("component", "word", "level").agg(F.bit_or("mask").alias("mask"))
        path, done = fresh_path(spark, "words"), []
        start.write.partitionBy("level").parquet(path)
        for n in range(1, top + 1):
            waiting = spark.read.schema(start.select("component", "word", "mask", "level").schema).parquet(path).where(F.col("level") == n)
            words = stored(waiting.groupBy("component", "word").agg(F.bit_or("mask").alias("mask")))
            done.append(words)
            if n < top:
                up = below.where(F.col("child_level") == n).join(words, F.col("c") == F.col("component"))
                up.select(F.col("p").alias("component"), "word", "mask", "level").write.mode("append").partitionBy("level").parquet(path)
        sizes = sizes.join(reduce(DataFrame.union, done).groupBy("component").agg(F.sum(F.bit_count("mask")).alias("m")), "component", "left").select("component", F.coalesce("m", "n").alias("n"))
    return terms.join(sizes.where("n > 1").withColumnRenamed("n", "size"), "component").select(F.col("term").alias("term_id"), (F.col("size") - 1).alias("fan_in"))
