"""Sinks: keyed tables, JSON, run lists and graph files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .snapshots import SnapshotTable


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def append(df: DataFrame, path: str) -> None:
    """K1: the store's retry is Spark's own retry of tasks."""
    df.write.mode("append").parquet(path)


def upsert(new: DataFrame, path: str, keys: list[str]) -> None:
    """A table with the latest row of every key."""
    SnapshotTable(new.sparkSession, path, keys).upsert(new)


def read(spark: SparkSession, path: str) -> DataFrame:
    """What upsert() and clear_run() have made: the latest snapshot, whatever is written meanwhile."""
    return SnapshotTable(spark, path).read()


def push_graph(nodes: dict[str, DataFrame], edges: dict[str, DataFrame], root: str) -> None:
    """K3, K5: every node and edge table into its own folder; nodes by their first column, edges by all their columns."""
    for name, df in nodes.items():
        upsert(df, f"{root}/nodes/{name}", [df.columns[0]])
    for name, df in edges.items():
        upsert(df, f"{root}/edges/{name}", df.columns)


def clear_run(spark: SparkSession, path: str, run_id: str) -> None:
    """K6: all rows but those of a run."""
    SnapshotTable(spark, path).delete(F.col("run_id") == run_id)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def bundle(spark: SparkSession, values: dict, path: str) -> None:
    """K9: one row of results."""
    spark.createDataFrame([{k: str(v) for k, v in values.items()}]).coalesce(1).write.mode("overwrite").json(path)


def run_list(runs: DataFrame, path: str) -> None:
    """One run directory a line, in order."""
    runs.select(F.col(runs.columns[0]).cast("string")).coalesce(1).write.mode("overwrite").text(path)


def xml(c: str) -> Column:
    """Text with XML's marks escaped; null is empty."""
    out = F.coalesce(F.col(c).cast("string"), F.lit(""))
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def attr(c: str) -> Column:
    return F.concat(F.lit('"'), xml(c), F.lit('"'))


def graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """K7: a GraphML file in one part, as the format asks for; of edges with equal ends the last by kind stays.

    nodes: (id, label); edges: (src, dst, kind).
    """
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="label" for="node" attr.name="label" attr.type="string"/><key id="kind" for="edge" attr.name="kind" attr.type="string"/><graph edgedefault="directed">'
    n = nodes.dropDuplicates(["id"]).select(F.lit(1).alias("k"), F.concat(F.lit("<node id="), attr("id"), F.lit('><data key="label">'), xml("label"), F.lit("</data></node>")).alias("value"))
    e = edges.groupBy("src", "dst").agg(F.max("kind").alias("kind")).select(F.lit(2).alias("k"), F.concat(F.lit("<edge source="), attr("src"), F.lit(" target="), attr("dst"), F.lit('><data key="kind">'), xml("kind"), F.lit("</data></edge>")).alias("value"))
    ends = nodes.sparkSession.createDataFrame([(0, head), (3, "</graph></graphml>")], "k int, value string")
    n.union(e).union(ends).orderBy("k", "value").select("value").coalesce(1).write.mode("overwrite").text(path)
