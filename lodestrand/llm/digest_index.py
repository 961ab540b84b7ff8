"""Exact deduplication against a persistent index of text digests.

The index is a Parquet table, bucketed and sorted by the SHA-256 digest of the
text, with one row for each digest. New data comes in batches. A batch is first
reduced to one row for each digest (so a text with a million copies costs one
row), then compared with the index by a sort-merge anti-join over the buckets;
what passes is appended and keeps its document, what doesn't is a copy. A
table's batches go in by falling doc_id, so that the document that brings a
digest is the one that stays. How often a digest came lies in a second table
with the same buckets, a row for each batch that had it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, join_counted, removed, removed_path, staged, whole_text

#: Batches that a table is ingested in.
BATCHES = 2


def text_digest(name: str = "text") -> Column:
    """SHA-256 of the UTF-8 text; null counts as the empty text."""
    return F.unhex(F.sha2(whole_text(name), 256))


class DigestIndex:
    """Digests seen so far (digest, keep_id) and their counts (digest, group_size, raised), both bucketed and sorted by digest.

    raised is the largest doc_id of a batch if that is larger than keep_id,
    which only a later call can bring, else null.

    path: folder of the index, in storage that all executors reach. An index
    that exists there is opened, else an empty one is made.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        name = f"digest_index_{uuid.uuid4().hex}"
        self.keys, self.counts = f"{name}_keys", f"{name}_counts"
        for table, columns in ((self.keys, "keep_id BIGINT"), (self.counts, "group_size BIGINT, raised BIGINT")):
            spark.sql(
                f"CREATE TABLE {table} (digest BINARY, {columns}) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}/{table[len(name) + 1 :]}'"
            )

    def _table(self, name: str) -> DataFrame:
        self.spark.catalog.refreshTable(name)
        return self.spark.table(name)

    def _append(self, rows: DataFrame, name: str) -> None:
        # by the bucket's number, so that one task writes a bucket, however many partitions there are
        bucket = F.pmod(F.hash("digest"), F.lit(self.buckets))
        rows.repartition(self.buckets, bucket).write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(name)

    def rows(self) -> DataFrame:
        """(digest, keep_id, group_size) over all batches; the buckets spare a shuffle."""
        counted = self._table(self.counts).groupBy("digest").agg(F.sum("group_size").alias("group_size"), F.max("raised").alias("raised"))
        return self._table(self.keys).hint("merge").join(counted, "digest").select("digest", F.coalesce("raised", "keep_id").alias("keep_id"), "group_size")

    def ingest(self, digests: DataFrame) -> DataFrame:
        """Adds a batch (digest, doc_id); returns (digest, keep_id, group_size) of the digests that the index didn't have.

        The digests are appended before their counts. A batch that failed in
        between can be ingested again: it then counts once.
        """
        batch = staged(digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "digest-batch")
        new = staged(batch.hint("merge").join(self._table(self.keys).select("digest"), "digest", "left_anti"), "digest-new")
        self._append(new.select("digest", "keep_id"), self.keys)
        held = self._table(self.keys).withColumnRenamed("keep_id", "held")
        later = F.col("keep_id").isNotNull() & (F.col("held").isNull() | (F.col("keep_id") > F.col("held")))
        self._append(batch.hint("merge").join(held, "digest").select("digest", "group_size", F.when(later, F.col("keep_id")).alias("raised")), self.counts)
        removed(batch)
        return new

    def close(self) -> None:
        """Forgets the tables' names; the files stay, for the next DigestIndex on this path."""
        for table in (self.keys, self.counts):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")


def falling(digests: DataFrame, batches: int) -> list[Column]:
    """A condition for each batch, by falling doc_id: no batch has a doc_id of an earlier one's range. Rows without a doc_id are in the last."""
    shares = [k / batches for k in range(batches - 1, 0, -1)]
    cuts = digests.agg(F.percentile_approx("doc_id", shares).alias("cuts")).first().cuts if shares else None
    doc_id, out, above = F.col("doc_id"), [], F.lit(True)
    for cut in cuts or []:
        out.append(above & (doc_id >= cut))
        above = doc_id < cut
    return [*out, above | doc_id.isNull()]


def ingested(digests: DataFrame, path: str | None, buckets: int, batches: int) -> DataFrame:
    """(digest, keep_id, group_size) of all texts after the staged rows (digest, doc_id) went in, a batch at a time. Without a path the index is deleted in the end."""
    spark = digests.sparkSession
    place = path or fresh_path(spark, "digest-index")
    index = DigestIndex(spark, place, buckets)
    try:
        for which in falling(digests, batches):
            removed(index.ingest(digests.where(which)))
        return staged(index.rows(), "digest-rows")
    finally:
        index.close()
        if path is None:
            removed_path(spark, place)


def exact_duplicates(docs: DataFrame, path: str | None = None, buckets: int = 64, batches: int = BATCHES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. Of equal texts the
    largest doc_id stays (null ids only if there is no other); rows that repeat
    one doc_id and text are all "kept" here (keep_rows() leaves one). All rows
    go in, in `batches` by falling doc_id. With a path, the index there is used
    and extended: keep_id and group_size then count what it held before, too. An empty table gives an empty result; other columns are
    ignored.
    """
    digests = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("digest")), "digests")
    rows = ingested(digests, path, buckets, batches)
    if path is not None:  # what earlier calls brought is of no use here
        rows = rows.join(digests.select("digest"), "digest", "left_semi")
    return join_counted(digests, rows, ["digest"], "group_size").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def keep_rows(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The documents without exact copies; same columns as docs.

    The rows are found by (doc_id, digest), so that copies of one text don't
    meet in one task with their texts. Rows that repeat doc_id and text are
    reduced to one, the first by its JSON; a row without a doc_id stays if no row with one has its
    text. Columns of any name pass through.
    """
    digests = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("digest")), "digests")
    keep = ingested(digests, None, 64, batches)
    own = F.struct(F.col("doc_id").cast("long").alias("id"), text_digest().alias("digest"))
    # the row goes along in a struct, so that no column's name can clash
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), own.alias("key"))
    keep = keep.select(F.struct(F.coalesce("keep_id", F.lit(-1)).alias("id"), F.col("keep_id").isNull().alias("none"), "digest").alias("key"))
    held = held.withColumn("key", F.struct(F.coalesce("key.id", F.lit(-1)).alias("id"), F.col("key.id").isNull().alias("none"), F.col("key.digest").alias("digest")))
    held = held.join(keep, "key", "left_semi")
    if digests.groupBy("doc_id", "digest").count().where("count > 1").limit(1).count():
        # the same one however often a task is done again
        held = held.groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return held.select("row.*")


def keyed_rows(docs: DataFrame) -> tuple[DataFrame, int | None]:
    """(_key, text, row) for each row of docs, and the first key that is no doc_id (None if there is none).

    row holds all columns. _key is the doc_id. Each row without one has a key
    of its own, larger than all doc_ids, by text; these are staged with their
    keys.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("_key"), "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    most, nulls = docs.agg(F.max("_key"), F.count_if(F.isnull("_key"))).first()
    if not nulls:
        return docs, None
    first = 0 if most is None else most + 1
    rows = docs.where("_key is null").withColumns({"_digest": text_digest(), "_other": F.xxhash64(F.to_json("row")), "_at": F.monotonically_increasing_id()})
    rows = rows.orderBy("_digest", "_other", "_at").drop("_digest", "_other", "_at").withColumn("_key", F.lit(first) + F.monotonically_increasing_id())
    return docs.where("_key is not null").unionByName(staged(rows, "null-ids")), first


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exact_duplicates() of all documents, ingested into one new index in BATCHES batches."""
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP8_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
