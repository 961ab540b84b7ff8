"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard. At each node every child makes a
weighted draw from a hash of (doc_id, child): -ln(u) / weight, and the smallest
draw wins, so a child is chosen in proportion to its weight, which is the sum
of the weights below it. A child's draws do not depend on its siblings; when
weights change, documents move only into children whose weight grew or out of
children whose weight shrank, so that movement stays inside those subtrees.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import unit_hash, whole_text


@dataclass(frozen=True)
class Node:
    """A region, rack or shard. name is what its draws hash; a shard has its number and weight."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def topology(shards: int, base: int = 16, racks: int = 2, per_rack: int = 2) -> Node:
    """The tree for a number of shards: doc_id and this number decide everything.

    The first `base` shards fill regions of `racks` racks of `per_rack` shards.
    Each shard beyond them opens a region of its own: only that region is a
    changed subtree, so one more shard takes rows only into itself. (Put into a
    rack that exists, it would also draw rows to its neighbours there.)
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    regions, per_region = [], racks * per_rack
    for r, first in enumerate(range(0, min(shards, base), per_region)):
        own = range(first, min(first + per_region, shards, base))
        groups = [[s for s in own if (s - first) // per_rack == k] for k in range(racks)]
        regions.append(Node(f"g{r}", tuple(Node(f"g{r}.k{k}", tuple(Node(f"g{r}.k{k}.s{s}", shard=s) for s in group)) for k, group in enumerate(groups) if group)))
    regions += [Node(f"x{s}", (Node(f"x{s}.k0", (Node(f"x{s}.k0.s{s}", shard=s),)),)) for s in range(base, shards)]
    return Node("root", tuple(regions))


def place(doc_id: Column, tree: Node) -> Column:
    """The shard of a document, as a column expression: one weighted draw per child on the way down."""
    if tree.shard is not None:
        return F.lit(tree.shard)
    if len(tree.children) == 1:
        return place(doc_id, tree.children[0])
    draws = [F.struct((-F.log(unit_hash(doc_id, F.lit(c.name))) / F.lit(float(c.weight))).alias("draw"), F.lit(k).alias("child")) for k, c in enumerate(tree.children)]
    # the one-element array binds the winner to a name, so that it is drawn once
    return F.transform(F.array(F.least(*draws)["child"]), lambda won: _choose(won, [place(doc_id, c) for c in tree.children]))[0]


def _choose(won: Column, options: list[Column]) -> Column:
    out = F.lit(None).cast("int")
    for k, option in reversed(list(enumerate(options))):
        out = F.when(won == k, option).otherwise(out)
    return out


def assign_shards(docs: DataFrame, shards: int = 16, slices: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    law is `key`: doc_id and the number of shards decide. size: UTF-8 bytes of
    the text (null: none) plus 1. slot numbers the rows of a shard from 0
    without gaps, by slice and then doc_id; a shard is cut into `slices` by
    hash, whose counts are summed first, so no task holds a whole shard.
    grown_shard: the shard if there were one more. A null doc_id hashes as the
    empty key. Rows that repeat a doc_id get slots of their own.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    part = lambda df: df.withColumns({"shard": place(key, topology(shards)), "_slice": F.floor(unit_hash(key, F.lit("slice")) * slices).cast("int")})
    counts = part(docs.select("doc_id")).groupBy("shard", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # shards * slices rows, whatever the input
    offsets = counts.select("shard", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = part(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(whole_text()) + 1).cast("long").alias("size"), F.crc32(whole_text().cast("binary")).cast("long").alias("text_crc32")))
    within = Window.partitionBy("shard", "_slice").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("_rank", F.row_number().over(within) - 1)
        .join(F.broadcast(offsets), ["shard", "_slice"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("_before") + F.col("_rank")).cast("long").alias("slot"), place(key, topology(shards + 1)).cast("int").alias("grown_shard"))
    )


def oracle(shards: int = 16, slices: int = 64) -> str:
    """assign_shards() in DuckDB's SQL."""
    unit = lambda name: f"(CAST('0x' || substr(md5(doc_id || ':{name}'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0"

    def pick(tree: Node) -> str:
        if tree.shard is not None:
            return str(tree.shard)
        if len(tree.children) == 1:
            return pick(tree.children[0])
        draw = [f"-ln({unit(c.name)}) / {float(c.weight)}" for c in tree.children]
        rows = " ".join(f"WHEN {k} THEN {pick(c)}" for k, c in enumerate(tree.children))
        return f"CASE list_position([{', '.join(draw)}], list_min([{', '.join(draw)}])) - 1 {rows} END"

    # CRC-32 by bytes: the table of 256 remainders comes from its rule
    return f"""
WITH RECURSIVE bits(n, v, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
), tab AS (SELECT list(v ORDER BY n) AS t FROM bits WHERE k = 8),
sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS h,
         {pick(topology(shards))} AS shard, {pick(topology(shards + 1))} AS grown_shard,
         CAST(floor({unit('slice')} * {slices}) AS INT) AS slice
  FROM documents
)
SELECT doc_id, CAST(size AS BIGINT) AS size,
       CAST(xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, CAST(length(h) AS BIGINT), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT))),
            lambda a, b: xor(a >> 8, tab.t[(xor(a, b) & 255) + 1]))) AS BIGINT) AS text_crc32,
       'key' AS law, CAST(shard AS INT) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY slice, doc_id) - 1 AS slot, CAST(grown_shard AS INT) AS grown_shard
FROM sized, tab
"""


def op2_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """assign_shards() of all documents to 16 shards by the law `key`; null and empty texts have size 1, an empty table no rows."""
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
