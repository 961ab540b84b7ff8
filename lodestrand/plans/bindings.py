"""The graph's tables, bound to the order and text tables that the queries run over.

Species are nations (by customer), chunks are orders, entities are parts,
mentions are lines, relations join consecutive lines of an order, terms are
brand and type of a part, over the brand, the type and a root.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

ROOT = "ROOT"
#: Rows that a task gets; up to so many tasks a scan writes rows to each without sorting them in memory, so that beyond it tasks first grow to MOST_ROWS.
TASK_ROWS, PLAIN_TASKS, MOST_ROWS = 1 << 17, 200, 1 << 21
#: Rows of a table that each executor holds whole at most.
HELD_ROWS = 1 << 21


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tasks(*tables: DataFrame) -> int:
    """How many tasks the largest of these tables takes."""
    n = max(t.count() for t in tables)
    return max(1, min(math.ceil(n / TASK_ROWS), PLAIN_TASKS), math.ceil(n / MOST_ROWS))


def held(table: DataFrame) -> bool:
    """Whether each executor may hold the whole table."""
    return table.count() <= HELD_ROWS


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), "o_custkey", "o_orderpriority"), load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    few = held(customer)
    if not few:
        n = tasks(orders, customer)
        orders, customer = orders.repartition(n, "o_custkey"), customer.repartition(n, "c_custkey")
    who = customer.join(load(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return orders.join(F.broadcast(who) if few else who.hint("merge"), F.col("o_custkey") == F.col("c_custkey")).select("chunk_id", F.col("n_name").alias("species_norm"), "o_orderpriority")


def parts(spark: SparkSession, sf_dir: str, n: int | None = None) -> DataFrame:
    """Parts with their entity, dealt by key to n tasks, or to as many as they take."""
    rows = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    n = n or tasks(rows)
    return (rows.repartition(n, "p_partkey") if n > 1 else rows).withColumn("entity_id", T.entity_id("p_type", "p_name"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).groupBy("entity_id").agg(F.min("p_name").alias("surface_form"), F.min("p_type").alias("entity_type"))


def lines(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """Lines of the chunks with their species and entity, numbered within the order. Tasks go by the number of lines.

    together: lines of a chunk are in one partition.
    """
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    part = load(spark, sf_dir, "part")
    few, n = held(part), tasks(li, load(spark, sf_dir, "orders"), part)
    at = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    numbered = li.repartition(n, "l_orderkey").withColumn("pos", F.row_number().over(at))
    # chunks first: the lines are dealt by order already
    rows = numbered.join(chunks(spark, sf_dir).repartition(n, "chunk_id"), F.col("l_orderkey") == F.col("chunk_id"))
    on = F.col("l_partkey") == F.col("p_partkey")
    if few:
        return rows.join(F.broadcast(parts(spark, sf_dir).select("p_partkey", "p_type", "entity_id")), on)
    rows = rows.repartition(n, "l_partkey").join(parts(spark, sf_dir, n).select("p_partkey", "p_type", "entity_id").hint("merge"), on)
    return rows.repartition(n, "chunk_id") if together else rows


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("chunk_id", "entity_id", "species_norm")


def related(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir, together=True).select("chunk_id", "species_norm", "entity_id", "pos", "l_returnflag")
    nxt = F.lead("entity_id").over(Window.partitionBy("chunk_id").orderBy("pos"))
    return rows.withColumn("obj_id", nxt).where("obj_id is not null").select(F.col("entity_id").alias("subj_id"), F.col("l_returnflag").alias("relation_type"), "obj_id", "chunk_id", "species_norm")


def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One term per entity: its type with its first brand."""
    rows = parts(spark, sf_dir).groupBy("entity_id").agg(F.min("p_brand").alias("brand"), F.min("p_type").alias("type"))
    return rows.select("entity_id", F.concat_ws("|", "brand", "type").alias("term_id"), F.concat_ws(" ", "brand", "type").alias("term_name"), "brand", "type")


def is_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat edges: from each mapped term to its brand, its type and the root."""
    terms = mapped(spark, sf_dir).select("term_id", "brand", "type").distinct()
    return terms.select(F.col("term_id").alias("child_id"), F.explode(F.array("brand", "type", F.lit(ROOT))).alias("parent_id"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.array(F.concat(F.lit("L"), "label")).alias("groups"), "label")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, trait, source): order priorities as runs, part types as traits, suppliers as citations."""
    return lines(spark, sf_dir).select(F.col("o_orderpriority").alias("run"), F.col("p_type").alias("trait"), F.col("l_suppkey").cast("string").alias("source"))


#: The same tables for DuckDB.
SQL = """
WITH RECURSIVE chunks AS (
  SELECT o_orderkey AS chunk_id, n_name AS species_norm, o_orderpriority FROM orders
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
), parts AS (
  SELECT *, substr(sha256(upper(p_type) || ':' || lower(trim(p_name))), 1, 16) AS entity_id FROM part
), entities AS (
  SELECT entity_id, min(p_name) AS surface_form, min(p_type) AS entity_type FROM parts GROUP BY entity_id
), lines AS (
  SELECT l.*, chunk_id, species_norm, o_orderpriority, entity_id, p_type FROM (
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_returnflag,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos FROM lineitem) l
  JOIN parts ON l_partkey = p_partkey JOIN chunks ON l_orderkey = chunk_id
), mentions AS (
  SELECT chunk_id, entity_id, species_norm FROM lines
), species_of AS (
  SELECT DISTINCT entity_id, species_norm FROM mentions
), related AS (
  SELECT * FROM (SELECT entity_id AS subj_id, l_returnflag AS relation_type, lead(entity_id) OVER (PARTITION BY chunk_id ORDER BY pos) AS obj_id, chunk_id, species_norm FROM lines) WHERE obj_id IS NOT NULL
), mapped AS (
  SELECT entity_id, min(p_brand) || '|' || min(p_type) AS term_id, min(p_brand) || ' ' || min(p_type) AS term_name, min(p_brand) AS brand, min(p_type) AS type FROM parts GROUP BY entity_id
), is_a AS (
  SELECT DISTINCT term_id AS child_id, unnest([brand, type, 'ROOT']) AS parent_id FROM mapped
), fan AS (
  SELECT parent_id AS term_id, count(DISTINCT child_id) AS fan_in FROM is_a GROUP BY parent_id
), vectors AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector, label FROM embeddings
)
"""
