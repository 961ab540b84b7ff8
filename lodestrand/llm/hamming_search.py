"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into m segments, of about as many bits as there are bits in the
number of codes, so that a segment value has few codes. Two codes at distance d
agree within d // m bits on some segment, so with all segment values within
radius r looked up, every code nearer than m * (r + 1) has been found. The
radius grows until each query's k-th verified distance is below that bound.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged

#: Bits of a word of a code, and of a segment at most: its flips of one radius, 705,432 at most, are broadcast.
WORD, MOST_BITS = 64, 22


def word(embedding: str, j: int) -> Column:
    """Bits 64j to 64j+63 of the code: whether each value is above 0 (null, NaN and missing ones are not)."""
    bits = F.transform(F.slice(embedding, j * WORD + 1, WORD), lambda x, i: F.when((x > 0) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def binary_codes(rows: DataFrame, key: str, embedding: str, words: int) -> DataFrame:
    """(id, code): the signs of all dimensions, as `words` numbers of 64 bits. Rows without an embedding or id have no code."""
    return rows.select(F.col(key).cast("long").alias("id"), F.col(embedding).alias("_e")).where("_e is not null and id is not null").select("id", F.array(*[word("_e", j) for j in range(words)]).alias("code"))


def segments(dims: int, codes: int) -> list[tuple[int, int, int]]:
    """(word, first bit, bits) of the segments for so many dimensions and codes; none crosses a word."""
    wanted, out = min(MOST_BITS, max(8, math.ceil(math.log2(max(codes, 2))))), []
    for j in range(math.ceil(dims / WORD)):
        bits = min(WORD, dims - j * WORD)
        parts = math.ceil(bits / wanted)
        width = math.ceil(bits / parts)
        out += [(j, k, min(width, bits - k)) for k in range(0, bits, width)]
    return out


def in_segments(df: DataFrame, code: str, parts: list[tuple[int, int, int]]) -> DataFrame:
    """A row per segment: seg, val."""
    value = lambda j, at, bits: F.shiftrightunsigned(F.col(code)[j], at).bitwiseAND(F.lit((1 << bits) - 1))
    listed = F.array(*[F.struct(F.lit(k).alias("seg"), value(*p).alias("val")) for k, p in enumerate(parts)])
    return df.withColumn("_s", F.explode(listed)).select("*", "_s.seg", "_s.val").drop("_s")


def distance(a: str, b: str, words: int) -> Column:
    return reduce(lambda x, y: x + y, (F.bit_count(F.col(a)[j].bitwiseXOR(F.col(b)[j])) for j in range(words)))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, id, distance): the k nearest other rows of each query, by distance and id.

    Vectors have any number of dimensions, read from the data; where some are
    shorter, the dimensions that they lack are not above 0. Rows without an
    embedding or id are left out, and empty tables give an empty result; other
    columns are ignored. Equal codes are indexed once, with their k + 1 smallest ids, as no more can
    be among the k nearest of a query; so a code with very many rows costs as
    much as any other. Rows that repeat an id and its code count once, among
    rows and among queries. Fewer than k results come back only if there are
    fewer such rows. Queries with equal codes share one search.
    """
    most = lambda df: df.agg(F.max(F.size(F.col(embedding)))).first()[0] or 0
    dims = max(most(rows), most(queries), 1)
    words = math.ceil(dims / WORD)
    last = Window.partitionBy("code").orderBy("id")
    ids = binary_codes(rows, key, embedding, words).distinct().withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= k + 1)
    codes = staged(ids.groupBy("code").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("id")).alias("ids")), "codes")
    parts = segments(dims, codes.count())
    index = in_segments(codes.select("code", "least", "n"), "code", parts)
    asked = staged(binary_codes(queries, key, embedding, words).distinct().withColumnRenamed("id", "query_id").withColumnRenamed("code", "q"), "queries")
    open_ = asked.select("q").distinct()
    width = max(bits for _, _, bits in parts)
    masks = rows.sparkSession.range(1 << width).select(F.col("id").alias("flip"), F.bit_count("id").alias("radius"))
    best = done = None
    for radius in range(width + 1):
        flips = F.broadcast(masks.where(F.col("radius") == radius))  # half of MOST_BITS out of MOST_BITS at most
        probes = in_segments(open_, "q", parts).withColumn("radius", F.lit(radius)).join(flips, "radius").select("q", "seg", F.col("val").bitwiseXOR(F.col("flip")).alias("val"))
        found = probes.join(index, ["seg", "val"]).select("q", "code", "least", "n").withColumn("distance", distance("q", "code", words))
        found = found if best is None else found.unionByName(best.join(open_, "q", "left_semi"))
        # k + 1 codes by distance and least id hold the k + 1 nearest ids
        by = Window.partitionBy("q").orderBy("distance", "least")
        best = found.groupBy("q", "code", "least", "n", "distance").agg(F.lit(1)).select("q", "code", "least", "n", "distance")
        best = staged(best.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= k + 1).drop("_r"), "best")
        covered = best.where(F.col("distance") < len(parts) * (radius + 1)).groupBy("q").agg(F.sum("n").alias("_n")).where(F.col("_n") > k).select("q")
        ready = best.join(covered, "q", "left_semi") if radius < width else best
        done = ready if done is None else done.unionByName(ready)
        open_ = staged(open_.join(covered, "q", "left_anti"), "open")
        if open_.isEmpty():
            break
    near = asked.join(done, "q").join(codes.select("code", "ids"), "code").select("query_id", "distance", F.explode("ids").alias("id")).where("id != query_id")
    rank = Window.partitionBy("query_id").orderBy("distance", "id")
    return near.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def op7_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """top_k() of every row whose id is divisible by 100 against all rows."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows, rows.where("vec_id % 100 = 0"))


OP7_SQL = """
WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS bits FROM embeddings WHERE embedding IS NOT NULL),
d AS (
  SELECT q.vec_id AS query_id, e.vec_id AS id, CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN q.bits[i] <> e.bits[i] THEN 1 ELSE 0 END)) AS INT) AS distance
  FROM b q, b e WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INT) AS rank, id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d
) WHERE rank <= 10
"""
