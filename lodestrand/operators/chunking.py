"""Documents to chunks: splitting, filters, caps, numbers and ids."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as PT

from .. import schemas as S
from ..functions import text as T

SEPARATORS = ["\n\n", "\n", " ", ""]
#: Chunks of a text that are handed on together.
PART = 4096


def _cuts(text: str, lo: int, hi: int, sep: str) -> np.ndarray:
    """Where the pieces of text[lo:hi] begin, and hi; a separator stays with the piece that it precedes, and none is empty."""
    found = np.fromiter((m.start() for m in re.compile(re.escape(sep)).finditer(text, lo, hi)), np.int64)
    return np.unique(np.concatenate([[lo], found, [hi]]))


def split_spans(text: str, size: int = S.CHUNK_SIZE, overlap: int = S.CHUNK_OVERLAP, separators: list[str] | None = None, lo: int = 0, hi: int | None = None) -> Iterator[tuple[int, int]]:
    """where the chunks of text[lo:hi] begin and end, before they are stripped.

    Pieces that fit are gathered up to the size; the next chunk takes over as
    many of the last pieces as fit into the overlap. A piece that is too long
    is cut at the next finer separator, by itself. Pieces are only places in
    the text, and a chunk's end is searched among them.
    """
    hi = len(text) if hi is None else hi
    separators = separators or SEPARATORS
    at = next((k for k, s in enumerate(separators) if s == "" or text.find(s, lo, hi) >= 0), len(separators) - 1)
    sep, finer = separators[at], separators[at + 1 :]
    if sep == "":  # single characters need no list
        start, step = lo, size - min(overlap, size - 1)
        while start + size < hi:
            yield start, start + size
            start += step
        if start < hi:
            yield start, hi
        return
    cuts = _cuts(text, lo, hi, sep)
    long = np.flatnonzero(np.diff(cuts) > size).tolist() if finer else []
    for first, last in zip([0, *(k + 1 for k in long)], [*long, len(cuts) - 1]):
        i = first  # pieces from first on, before last, are short
        while i < last:
            j = min(max(int(np.searchsorted(cuts, cuts[i] + size, side="right")) - 1, i + 1), last)
            yield int(cuts[i]), int(cuts[j])
            if j == last:
                break
            nxt = int(cuts[j + 1] - cuts[j])
            keep = min(overlap, size - nxt) if nxt < size else 0
            i = min(max(int(np.searchsorted(cuts, cuts[j] - keep, side="left")), i), j)
        if last < len(cuts) - 1:
            yield from split_spans(text, size, overlap, finer, int(cuts[last]), int(cuts[last + 1]))


def split_text(text: str, size: int = S.CHUNK_SIZE, overlap: int = S.CHUNK_OVERLAP, separators: list[str] | None = None) -> list[str]:
    """the chunks of a text, at most `size` characters each, cut at the coarsest separator that is there."""
    return [c for a, b in split_spans(text, size, overlap, separators) if (c := text[a:b].strip())]


def split_documents(docs: DataFrame, text: str = "text", size: int = S.CHUNK_SIZE, overlap: int = S.CHUNK_OVERLAP) -> DataFrame:
    """One row per piece: all columns of docs but the text, pos and content. Null texts give none."""

    rest = [c for c in docs.columns if c != text]
    schema = PT.StructType([*(docs.schema[c] for c in rest), PT.StructField("pos", PT.IntegerType()), PT.StructField("content", PT.StringType())])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                whole = batch.column(len(rest))[k].as_py()
                pieces, pos = (c for a, b in split_spans(whole or "", size, overlap) if (c := whole[a:b].strip())), 0
                # a long text's chunks go on in parts
                while part := list(islice(pieces, PART)):
                    at = pa.array([k] * len(part), pa.int32())
                    yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[: len(rest)]), pa.array(range(pos, pos + len(part)), pa.int32()), pa.array(part, pa.string())], names=schema.fieldNames())
                    pos += len(part)

    return docs.select(*rest, text).mapInArrow(run, schema)


def numbered(chunks: DataFrame, doc: list[str], pos: str = "pos") -> DataFrame:
    """chunk_index from 0 in order of pos within each document, after whatever was filtered."""
    return chunks.withColumn("chunk_index", F.row_number().over(Window.partitionBy(*doc).orderBy(pos)) - 1)


def capped(chunks: DataFrame, doc: list[str], ratio: float, index: str = "chunk_index") -> DataFrame:
    """The first and last share of each document's chunks, numbered anew; all of them if that would keep everything."""
    w = Window.partitionBy(*doc)
    keep = F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(float(ratio)), 0).cast("int"))
    ranked = chunks.withColumns({"_n": F.count(F.lit(1)).over(w), "_r": F.row_number().over(w.orderBy(index))}).withColumn("_k", keep)
    kept = ranked.where((2 * F.col("_k") >= F.col("_n")) | (F.col("_r") <= F.col("_k")) | (F.col("_r") > F.col("_n") - F.col("_k")))
    return kept.withColumn(index, F.row_number().over(w.orderBy("_r")) - 1).drop("_n", "_r", "_k")


def chunk_documents(docs: DataFrame, species: str, source: str, doc: str, text: str = "text", cap: float | None = None, drop_junk: bool = False) -> DataFrame:
    """References cut off, text split, short (and junk) chunks dropped, the rest numbered, capped and given ids."""
    base = docs.select(F.col(species).alias("species_norm"), F.col(source).cast("string").alias("source_path"), F.col(doc).cast("string").alias("doc_id"), T.strip_references(text).alias("text"))
    chunks = split_documents(base).where(T.long_enough("content", S.MIN_CHUNK))
    if drop_junk:
        chunks = chunks.where(~T.is_junk_chunk("content"))
    chunks = numbered(chunks, ["source_path", "doc_id"])
    if cap is not None:
        chunks = capped(chunks, ["source_path", "doc_id"], cap)
    return chunks.select(T.chunk_id("species_norm", "source_path", "chunk_index").alias("chunk_id"), "species_norm", "source_path", "doc_id", "chunk_index", "content", F.substring("content", 1, 300).alias("text_snippet"))
