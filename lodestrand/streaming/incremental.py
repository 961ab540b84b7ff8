"""Incremental state, and streams as an extension.

The batch rules: what is known is skipped unless forced; a result that is no
match counts as known. Streams do the same with a checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def not_indexed(chunks: DataFrame, indexed: DataFrame, force: bool = False) -> DataFrame:
    """I1, J6"""
    return chunks if force else chunks.join(indexed.select("chunk_id"), "chunk_id", "left_anti")


def not_ingested(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents whose id is in no chunk yet, nor their path."""
    return docs.join(chunks.select("doc_id"), "doc_id", "left_anti").join(chunks.select("source_path").where("source_path is not null"), "source_path", "left_anti")


def marked(entities: DataFrame, results: DataFrame) -> DataFrame:
    """Entities with their flags after a round; those without a match are enriched too, so they aren't tried again."""
    r = results.select("entity_id", F.col("mapped").alias("_m"))
    return entities.join(r, "entity_id", "left").withColumns({"upheno_enriched": F.coalesce(F.col("_m").isNotNull() | F.col("upheno_enriched"), F.lit(False)), "upheno_mapped": F.coalesce("_m", "upheno_mapped", F.lit(False))}).drop("_m")


def run_status(chunks: DataFrame, indexed: DataFrame, text: str = "content") -> DataFrame:
    """How many chunks are junk, known or new."""
    known = indexed.select("chunk_id").distinct().withColumn("_k", F.lit(True))
    status = F.when(F.col("_k"), "skipped").when(T.is_junk_chunk(text), "junk").otherwise("indexed")
    return chunks.join(known, "chunk_id", "left").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def index_states(chunks: DataFrame, text: str = "content", call: Callable[[str], object] | None = None, attempts: int = 2) -> DataFrame:
    """I1, I2, I3, A18 as a stateful stream: (chunk_id, status, n) for every change of a chunk's state.

    chunks: a stream of (chunk_id, text). The first of a chunk_id is `junk`, or
    `indexed` when the call on its text succeeds; what comes again, also in
    later files or after a restart, is `skipped`. A call that fails is noted as
    `retry` and made again when the chunk comes again; after so many attempts
    the chunk is `failed` and not tried any more. State lies in the checkpoint,
    a few bytes for each chunk. A null text is like an empty one, which is junk.
    """

    def step(key, frames, state):
        done, tries = state.get if state.exists else (False, 0)
        counts = {}

        def add(status):
            counts[status] = counts.get(status, 0) + 1

        for f in frames:
            for junk, whole in zip(f["junk"], f["text"] if call is not None else f["junk"]):
                if done:
                    add("skipped")
                elif junk:
                    done = True
                    add("junk")
                else:
                    try:
                        if call is not None:
                            call(whole)
                        done = True
                        add("indexed")
                    except Exception:  # noqa: BLE001  a call can fail in any way
                        tries += 1
                        done = tries >= attempts
                        add("failed" if done else "retry")
        state.update((done, tries))
        yield pd.DataFrame([(key[0], s, n) for s, n in counts.items()], columns=["chunk_id", "status", "n"])

    rows = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("junk", T.is_junk_chunk("text"))
    if call is None:  # nobody reads the texts, so they stay where they are
        rows = rows.drop("text")
    return rows.groupBy("chunk_id").applyInPandasWithState(step, "chunk_id string, status string, n long", "done boolean, tries int", "append", "NoTimeout")


def index_stream(chunks: DataFrame, table: str, checkpoint: str, **settings):
    """I1 over a stream of chunks: index_states(), appended to a table by Spark's own sink, each change once across restarts and files that come twice. No batch reads what earlier ones wrote."""
    return index_states(chunks, **settings).writeStream.format("parquet").outputMode("append").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_counts(states: DataFrame) -> DataFrame:
    """How many chunks came to each status, from the table of index_stream()."""
    return states.groupBy("status").agg(F.sum("n").alias("n"))


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: events and their value by window and type; on a stream, rows later than `late` are dropped."""
    held = events.withWatermark("ts", late) if events.isStreaming else events
    return held.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Extension: a user's events without a gap as one session."""
    held = events.withWatermark("ts", late) if events.isStreaming else events
    return held.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
