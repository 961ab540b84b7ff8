"""What the corpus operators share: places, staging and hashes."""

from __future__ import annotations

import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..places import fresh_path


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Spark's own setting that deletes a query's shuffle files when it ends; what is staged needs them no more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: the lineage ends there."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    PATHS[id(out)] = weakref.ref(out, lambda _, k=id(out): PATHS.pop(k, None)), path
    return out


#: Where staged tables lie, as long as they are referred to.
PATHS: dict[int, tuple] = {}


def removed(*tables: DataFrame) -> None:
    """Deletes the files of staged tables that nothing will read any more; others are left alone."""
    for df in tables:
        if id(df) in PATHS:
            removed_path(df.sparkSession, PATHS[id(df)][1])


def removed_path(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def unit_hash(*parts: Column) -> Column:
    """A number strictly between 0 and 1, from 52 bits of the MD5 of the parts joined by ':'."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def long_hash(*parts: Column) -> Column:
    """A whole number below 2**60, from the MD5 of the parts joined by ':'."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


#: A key is hot if at least one row in so many has it; so there are at most so many hot keys.
HOT_SHARE = 2000


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Inner join of rows with `counted`, which has each key once, with its number of rows in `size`.

    A hot key has rows without bound on the left but one on the right. The at
    most HOT_SHARE keys that own that share of all rows are broadcast; all
    others meet by a sort-merge join, where no key is large.
    """
    total = counted.agg(F.sum(size)).first()[0] or 0
    is_hot = F.col(size) * HOT_SHARE >= F.lit(max(total, 2 * HOT_SHARE))
    others = [c for c in counted.columns if c not in keys]
    hot = F.broadcast(counted.where(is_hot).withColumn("_hot", F.lit(True)))
    tagged = rows.join(hot, keys, "left")
    cold = tagged.where("_hot is null").drop("_hot", *others).hint("merge").join(counted.where(~is_hot), keys)
    return tagged.where("_hot").drop("_hot").unionByName(cold)


def components(edges: DataFrame) -> DataFrame:
    """(node, label, old) for the nodes of edges (a, b): label is the smallest node that can be reached.

    Each round takes the smallest label among neighbours and then follows
    labels of labels, so that rounds grow with the logarithm of a component's
    width. Nothing is collected; each round is a table in the shared folder.
    """
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("node"), F.least("a", "_m").alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = staged(labels.join(near, labels.node == near.a, "left").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old")), "labels")
        # every label has one row on the right, so a join can deal out a label with very many rows on the left
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("root"))
        after = staged(step.join(jump, "label", "left").select("node", F.coalesce("root", "label").alias("label"), "old"), "labels")
        removed(labels, step)
        if after.where("label <> old").limit(1).count() == 0:
            removed(both)
            return after
        labels = after
