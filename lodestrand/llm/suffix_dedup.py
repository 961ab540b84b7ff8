"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A byte goes if a string of LENGTH bytes that covers it also starts in a
document with a smaller doc_id. Equal strings are neighbours in the order of
suffixes; the order is never built as a whole, but a bucket at a time:

0. A text that is, byte for byte, an earlier one goes as a whole.
1. Suffixes fall into buckets by their anchor: of the K-byte strings within
   their first LENGTH bytes, the one with the smallest hash. Equal suffixes
   have equal anchors, at one distance. Neighbouring suffixes with one anchor
   are a run. Anchors meet as hashes first, which only tells which of them are
   in more than one document; no other bucket has anything to sort.
2. For the runs of these anchors the bytes from the first suffix to the end of
   the last (the run's surroundings) go to the anchor's bucket. Equal
   surroundings are one entry, found by their bytes, already where they are
   read, so a passage in very many documents goes on once from each batch.
3. A bucket with different surroundings is sorted, some buckets at a time:
   suffixes by their distance from the anchor and their first V bytes, and
   ties by the precomputed rank of the difference-cover sample that follows
   both suffixes at the same distance. How far neighbouring samples agree tells
   how far the suffixes do; those that agree on LENGTH bytes get the smallest
   doc_id among them.

An anchor with very many runs is split: each of its suffixes goes alone, to a
bucket of its distance and its first V bytes, a block of the order of suffixes.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import removed, staged
from .digest_index import keyed_rows, text_digest
from .token_count import text_buffer
from .words import U, eights, mixed

LENGTH, K = 50, 20
WINDOW = LENGTH - K + 1
#: A perfect difference set: every distance modulo V is a difference of two members (fixed values).
V, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Distance from a residue to the next sample that two suffixes of that residue share.
NEXT_SAMPLE = np.array([min(d for d in range(V) if (r + d) % V in COVER) for r in range(V)])
#: Text bytes looked at in one go, and text bytes whose anchors are sorted in one go.
BLOCK_BYTES, SETTLE_BYTES = 1 << 20, 6 << 20
#: Suffixes sorted at a time, and surroundings gathered before equal ones are merged.
SORT_SUFFIXES, GATHER = 1 << 18, 1 << 16
#: Input bytes for each bucket of anchors that a task holds at a time, and tasks.
BUCKET_BYTES, MOST_TASKS = 8 << 20, 50_000
#: Runs from which an anchor is split, and anchors that are split at most (with more input the number of runs rises instead).
SPLIT_RUNS, MOST_SPLIT = 1 << 14, 1 << 18


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of the K bytes from each place on."""
    lanes, n = eights(b), max(len(b) - K + 1, 0)
    h = mixed(lanes[:n])
    for at in [*range(8, K - 8, 8), K - 8]:
        h = mixed(h ^ lanes[at : at + n])
    return h


def anchors(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text number, anchor position, first suffix, last suffix, anchor hash) for each run of suffixes with one anchor.

    Suffixes are those with LENGTH bytes left in their text; positions count from the text's start.
    """
    none = np.zeros(0, np.int64)
    if len(b) < LENGTH:
        return none, none, none, none, none.astype(U)
    g = gram_hashes(b)
    low = (g >> U(32) << U(32)) | np.arange(len(g), dtype=U)
    size = 1
    while size * 2 <= WINDOW:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[: len(low) - (WINDOW - size)], low[WINDOW - size :])
    at = (low & U(0xFFFFFFFF)).astype(np.int64)
    length = np.diff(offsets)
    n = np.maximum(length - LENGTH + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    start = np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
    pos = at[offsets[doc] + start]
    new = np.ones(len(doc), bool)
    new[1:] = (pos[1:] != pos[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    base = offsets[doc[first]]
    return doc[first], pos[first] - base, start[first], start[last], g[pos[first]]


def _blocks(column: pa.Array):
    data, offsets = text_buffer(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def _pack(*columns: tuple[np.ndarray, type]) -> bytes:
    return b"".join(c.astype(t).tobytes() for c, t in columns)


def _unpack(blob: bytes, *types: type) -> list[np.ndarray]:
    n, at, out = len(blob) // sum(np.dtype(t).itemsize for t in types), 0, []
    for t in types:
        out.append(np.frombuffer(blob, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


#: What a batch says of an anchor: its hash, a doc_id (low and high half), and of a run the anchor's position and the distances to the first and last suffix; or how many runs an anchor has that the batch found in several documents (distances are ALL then).
SEEN = (np.uint32, np.uint32, np.uint32, np.uint32, np.uint8, np.uint8)
ALL = 255
#: What surroundings are sent with.
CODEC = "zstd"
_MARKS = "doc_id long, pos int, lo int, hi int, anchor long"


def _by_document(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by anchor and document, where anchors begin in it, and which anchor each place belongs to."""
    by = np.lexsort((doc, h))
    new = np.ones(len(h), bool)
    new[1:] = h[by[1:]] != h[by[:-1]]
    return by, np.flatnonzero(new), np.cumsum(new) - 1


def shared_anchors(docs: DataFrame, buckets: int, split_runs: int) -> DataFrame:
    """(doc_id, pos, lo, hi, anchor): the runs of suffixes whose anchor is in another document too; and with doc_id null the anchors of split_runs runs or more.

    Anchors meet by 32 bits of hash and a bucket; a chance meeting only adds a
    run that later proves unique. An anchor that a batch of texts holds in
    several documents is sent on once from there.
    """

    def rows(doc, p, lo, hi, anchor=None):
        ints = [pa.array(x.astype(np.int32)) for x in (p, lo, hi)]
        last = pa.nulls(len(doc), pa.int64()) if anchor is None else pa.array(anchor)
        return pa.RecordBatch.from_arrays([pa.nulls(len(doc), pa.int64()) if doc is p else pa.array(doc.astype(np.int64)), *ints, last], names=["doc_id", "pos", "lo", "hi", "anchor"])

    def settle(parts, salt):
        doc, p, lo, hi, h = (np.concatenate(c) for c in zip(*parts))
        h = anchor_name(h, buckets)
        by, first, group = _by_document(h, doc)
        h, doc, p, lo, hi = h[by], doc[by], p[by], lo[by], hi[by]
        last = np.append(first[1:], len(h)) - 1
        several = doc[first] < doc[last]
        here = several[group]
        one, k = np.flatnonzero(~here), first[several]
        runs = np.diff(np.append(first, len(h)))[several]
        every = [np.concatenate(c) for c in ((h[one], h[k]), (doc[one], doc[k]), (p[one], runs), (p[one] - lo[one], np.full(len(k), ALL)), (p[one] - hi[one], np.full(len(k), ALL)))]
        every = [x[np.argsort(every[0], kind="stable")] for x in every]
        bucket, d = (every[0] >> U(32)).astype(np.int64), every[1].astype(np.int64)
        cols = [x.astype(t) for x, t in zip((every[0] & U(0xFFFFFFFF), d & 0xFFFFFFFF, d >> 32, *every[2:]), SEEN)]
        used = np.unique(bucket)
        cut = np.searchsorted(bucket, np.append(used, buckets))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([_pack(*((c[x:y], t) for c, t in zip(cols, SEEN))) for x, y in zip(cut, cut[1:])], pa.binary()), pa.nulls(len(used), pa.binary())], names=["bucket", "seen", "settled"])
        done, step = np.flatnonzero(here), 1 << 16
        if len(done):
            blobs = [_pack((doc[k], np.int64), *((c[k], np.int32) for c in (p, lo, hi))) for k in (done[a : a + step] for a in range(0, len(done), step))]
            yield pa.RecordBatch.from_arrays([pa.array([(salt + k) % buckets for k in range(len(blobs))], pa.int64()), pa.nulls(len(blobs), pa.binary()), pa.array(blobs, pa.binary())], names=["bucket", "seen", "settled"])

    def see(batches):
        for batch in batches:
            ids, parts, size = batch.column(0).to_numpy(), [], 0
            for i, _, b, offsets in _blocks(batch.column(1)):
                d, *found = anchors(b, offsets)
                parts.append((ids[i + d], *found))
                size += len(b)
                if size >= SETTLE_BYTES:
                    yield from settle(parts, int(ids[i]))
                    parts, size = [], 0
            if parts:
                yield from settle(parts, int(ids[0]))

    def met(bucket, blobs):
        h, d0, d1, p, to_lo, to_hi = (np.concatenate(c) for c in zip(*(_unpack(x, *SEEN) for x in blobs)))
        doc = d1.astype(np.int64) << 32 | d0
        by, first, group = _by_document(h, doc)
        h, doc, p, to_lo, to_hi = h[by], doc[by], p[by].astype(np.int64), to_lo[by].astype(np.int64), to_hi[by].astype(np.int64)
        last = np.append(first[1:], len(h)) - 1
        whole = to_lo == ALL
        shared = (doc[first] < doc[last]) | np.logical_or.reduceat(whole, first)
        k = np.flatnonzero(shared[group] & ~whole)
        if len(k):
            yield rows(doc[k], p[k], p[k] - to_lo[k], p[k] - to_hi[k])
        many = first[np.add.reduceat(np.where(whole, p, 1), first) >= split_runs]
        if len(many):
            none = np.zeros(len(many), np.int64)
            yield rows(none, none, none, none, h[many].astype(np.int64) | bucket << 32)

    def meet(batches):
        held, at = [], None
        for batch in batches:
            for bucket, seen, settled in zip(*(c.to_pylist() for c in batch.columns)):
                if seen is None:
                    yield rows(*_unpack(settled, np.int64, np.int32, np.int32, np.int32))
                    continue
                if bucket != at and held:
                    yield from met(at, held)
                    held = []
                at = bucket
                held.append(seen)
        if held:
            yield from met(at, held)

    sent = docs.select("doc_id", "text").mapInArrow(see, "bucket long, seen binary, settled binary")
    return sent.repartition(min(buckets, MOST_TASKS), "bucket").sortWithinPartitions("bucket").mapInArrow(meet, _MARKS)


def anchor_name(h: np.ndarray, buckets: int) -> np.ndarray:
    """An anchor's bucket (upper half) and 32 bits of its hash."""
    return ((h >> U(32)) % U(buckets)) << U(32) | h & U(0xFFFFFFFF)


def suffix_minima(contexts: list[bytes], key: np.ndarray, anchor: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each suffix of each surroundings, the smallest doc_id that has its LENGTH bytes; with the number of its surroundings and its place in them.

    key: the bucket of each, ascending; anchor: its anchor's offset; doc: its smallest doc_id.
    """
    size = np.array([len(c) for c in contexts])
    # each is laid out so that its anchor stands at a multiple of V, with LENGTH zeros after it
    lead = -anchor % V
    slot = -(-(lead + size + LENGTH) // V) * V
    base = np.cumsum(slot) - slot + lead
    text = np.zeros(int(slot.sum()) + LENGTH, np.uint8)
    inside = np.repeat(base - (np.cumsum(size) - size), size) + np.arange(size.sum())
    text[inside] = np.frombuffer(b"".join(contexts), np.uint8)
    strings = np.lib.stride_tricks.sliding_window_view(text, LENGTH)
    n = size - LENGTH + 1
    owner = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    suffix = base[owner] + offset
    ahead = NEXT_SAMPLE[suffix % V]
    # the samples of the cover that follow a suffix, each once
    used = np.zeros(len(text), bool)
    used[suffix + ahead] = True
    sample = np.flatnonzero(used)
    # ranks of the cover's samples by their LENGTH bytes, and how far each agrees with the one before it; beyond its own, a text counts as zeros
    order, place = np.unique(np.ascontiguousarray(strings[sample]).view(f"S{LENGTH}").ravel(), return_inverse=True)
    rank = np.zeros(len(text), np.int32)
    rank[sample] = place
    sorted_ = np.zeros((len(order), LENGTH + 1), np.uint8)
    sorted_[:, :LENGTH] = np.frombuffer(order.tobytes(), np.uint8).reshape(-1, LENGTH)
    differ = np.ones((len(order), LENGTH + 1), bool)
    differ[1:] = sorted_[1:] != sorted_[:-1]
    differ[:, LENGTH] = True
    agree = np.argmax(differ, 1)
    first = np.zeros((len(suffix), 32), np.uint8)
    first[:, :V] = strings[suffix][:, :V]
    words = first.view(">u8").astype(U)
    distance = anchor[owner] - offset  # to the anchor: suffixes at one distance have one residue
    ranks = rank[suffix + ahead]
    by = np.lexsort((ranks, words[:, 3], words[:, 2], words[:, 1], words[:, 0], distance, key[owner]))
    ranks, ahead, o, far = ranks[by], ahead[by], owner[by], distance[by]
    # suffixes that agree on V bytes agree on LENGTH if the samples `ahead` of them do on the rest: if no two samples between their ranks part before that
    classes = np.zeros(len(by), np.int64)
    for d in np.unique(ahead).tolist():
        k = ahead == d
        classes[k] = np.cumsum(agree < LENGTH - d)[ranks[k]]
    w = words[by]
    same = np.zeros(len(by), bool)
    same[1:] = (w[1:] == w[:-1]).all(1) & (classes[1:] == classes[:-1]) & (far[1:] == far[:-1]) & (key[o[1:]] == key[o[:-1]])
    heads = np.flatnonzero(~same)
    least = np.minimum.reduceat(doc[o], heads)[np.cumsum(~same) - 1]
    out = np.empty(len(by), np.int64)
    out[by] = least
    return out, owner, offset


_RANGES = "doc_id long, lo int, hi int"


def repeated_suffixes(docs: DataFrame, marks: DataFrame, buckets: int, split: np.ndarray) -> DataFrame:
    """(doc_id, lo, hi): runs of suffixes whose LENGTH bytes also start in an earlier document.

    marks: runs by document. split: names of the anchors that are split, ascending.
    """

    def ranges(*columns):
        return pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, (np.int64, np.int32, np.int32))], names=["doc_id", "lo", "hi"])

    def packed(rows, columns):
        """A row (bucket, entries, settled) for each bucket of rows, which come with their bucket first."""
        rows.sort(key=lambda r: r[0])
        at = np.array([r[0] for r in rows], np.int64)
        used, first = np.unique(at, return_index=True)
        for k in range(0, len(used), 512):
            blobs = [columns(rows[x:y]) for x, y in zip(first[k : k + 512], np.append(first, len(rows))[k + 1 : k + 513])]
            yield pa.RecordBatch.from_arrays([pa.array(used[k : k + 512]), *blobs_of(blobs)], names=["bucket", "entries", "settled"])

    def entry_columns(rows):
        _, anchor, at, context, doc, lo, hi = zip(*rows)
        return _pack((np.array(anchor), np.int64), (np.array(doc), np.int64), (np.array(lo), np.int32), (np.array(hi), np.int32), (np.array(at), np.uint8), (np.array([len(c) for c in context]), np.uint8)) + b"".join(context), len(rows)

    def blobs_of(blobs):
        # the text makes most of it, and zstd takes it down further than what Spark does to a shuffle
        data = [n.to_bytes(4, "little") + len(x).to_bytes(4, "little") + pa.compress(x, codec=CODEC, asbytes=True) for x, n in blobs]
        return pa.array(data, pa.binary()), pa.nulls(len(data), pa.binary())

    def gather(batches):
        held: dict[tuple, list] = {}
        count = 0

        def full():
            out, settled = [], []
            for (anchor, at, context), found in held.items():
                least = min(found)[0] if len(found) > 1 else found[0][0]
                for doc, lo, hi in found:
                    # the bytes of a later document's run are an earlier one's, so it goes as a whole
                    if doc == least:
                        out.append((anchor % buckets, anchor, at, context, doc, lo, hi))
                    else:
                        settled.append((doc, lo, hi))
            held.clear()
            yield from packed(out, entry_columns)
            if settled:
                doc, lo, hi = (np.array(c) for c in zip(*settled))
                yield pa.RecordBatch.from_arrays([pa.array([int(doc[0]) % buckets], pa.int64()), pa.nulls(1, pa.binary()), pa.array([_pack((doc, np.int64), (lo, np.int32), (hi, np.int32))], pa.binary())], names=["bucket", "entries", "settled"])

        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            lists = batch.column(2)
            per, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
            pos, lo, hi = (flat.field(k).to_numpy() for k in range(3))
            ids, done = batch.column(0).to_pylist(), 0
            for d, n in enumerate(per.tolist()):
                b = data[offsets[d] : offsets[d + 1]]
                raw, at, first, last, doc = b.tobytes(), pos[done : done + n], lo[done : done + n], hi[done : done + n], ids[d]
                h = gram_hashes(b)[at]
                keys = (h >> U(1)).astype(np.int64)
                alone = np.isin(anchor_name(h, buckets).astype(np.int64), split) if len(split) else np.zeros(n, bool)
                for anchor, p, x, y in zip(keys[~alone].tolist(), at[~alone].tolist(), first[~alone].tolist(), last[~alone].tolist()):
                    held.setdefault((anchor, p - x, raw[x : y + LENGTH]), []).append((doc, x, y))
                for i in np.flatnonzero(alone).tolist():
                    for x in range(int(first[i]), int(last[i]) + 1):
                        block = (int(keys[i]) ^ (zlib.crc32(raw[x : x + V]) << 31 | int(at[i]) - x) * 0x9E3779B97F4A7C15) & 0x7FFFFFFFFFFFFFFF
                        held.setdefault((block, int(at[i]) - x, raw[x : x + LENGTH]), []).append((doc, x, x))
                done += n
                count += n + int((last[alone] - first[alone]).sum())
                if count >= GATHER:
                    yield from full()
                    count = 0
        yield from full()

    def resolved(blobs):
        """Ranges found in one bucket's entries."""
        parts, contexts = [], []
        for blob in blobs:
            n = int.from_bytes(blob[:4], "little")
            raw = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[4:8], "little"), codec=CODEC, asbytes=True)
            *columns, size = _unpack(raw[: n * 26], np.int64, np.int64, np.int32, np.int32, np.uint8, np.uint8)
            parts.append(columns)
            ends = n * 26 + np.cumsum(size, dtype=np.int64)
            contexts += [raw[x:y] for x, y in zip((ends - size).tolist(), ends.tolist())]
        anchor, doc, lo, hi, at = (np.concatenate(c) for c in zip(*parts))
        entry: dict[tuple, int] = {}
        own = np.array([entry.setdefault(k, len(entry)) for k in zip(anchor.tolist(), at.tolist(), contexts)])
        # of equal surroundings the smallest document goes on; the others' runs go as a whole
        by = np.lexsort((doc, own))
        head = np.ones(len(by), bool)
        head[1:] = own[by[1:]] != own[by[:-1]]
        least = doc[by[head]]
        gone = doc > least[own]
        yield ranges(doc[gone], lo[gone], hi[gone])
        # anchors with different surroundings in different documents are sorted
        name = np.array([k[0] for k in entry])
        order = np.argsort(name, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = name[order[1:]] != name[order[:-1]]
        edge, group = np.flatnonzero(new), np.cumsum(new) - 1
        differ = np.minimum.reduceat(least[order], edge) < np.maximum.reduceat(least[order], edge)
        order, group = order[differ[group]], group[differ[group]]
        if not len(order):
            return
        keys = list(entry)
        size = np.array([len(keys[k][2]) for k in order.tolist()]) - LENGTH + 1
        last = np.flatnonzero(np.append(group[1:] != group[:-1], True))  # of each anchor
        cuts, total = [0], np.cumsum(size)
        for x in last.tolist():
            if total[x] - (total[cuts[-1] - 1] if cuts[-1] else 0) >= SORT_SUFFIXES or x == last[-1]:
                cuts.append(x + 1)
        stay = np.flatnonzero(~gone)
        stay = stay[np.argsort(own[stay], kind="stable")]
        runs_of = np.searchsorted(own[stay], np.arange(len(entry) + 1))
        for x, y in zip(cuts, cuts[1:]):
            k = order[x:y]
            minima, owner, offset = suffix_minima([keys[i][2] for i in k.tolist()], group[x:y], np.array([keys[i][1] for i in k.tolist()]), least[k])
            hit = np.flatnonzero(minima < least[k][owner])
            if not len(hit):
                continue
            begins = np.ones(len(hit), bool)
            begins[1:] = (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])
            a, z = hit[begins], hit[np.append(np.flatnonzero(begins)[1:], len(hit)) - 1]
            # every run of these surroundings in the smallest document
            mine = k[owner[a]]
            many = runs_of[mine + 1] - runs_of[mine]
            which = np.repeat(np.arange(len(a)), many)
            run = stay[runs_of[mine][which] + np.arange(len(which)) - (np.cumsum(many) - many)[which]]
            yield ranges(doc[run], lo[run] + offset[a][which], lo[run] + offset[z][which])

    def resolve(batches):
        held, now = [], None
        for batch in batches:
            for bucket, entries, settled in zip(*(c.to_pylist() for c in batch.columns)):
                if entries is None:
                    yield ranges(*_unpack(settled, np.int64, np.int32, np.int32))
                    continue
                if bucket != now and held:
                    yield from resolved(held)
                    held = []
                now = bucket
                held.append(entries)
        if held:
            yield from resolved(held)

    listed = marks.groupBy("doc_id").agg(F.collect_set(F.struct("pos", "lo", "hi")).alias("marks"))
    texts = docs.select("doc_id", "text").join(listed, "doc_id").select("doc_id", "text", "marks")
    # a bucket's entries come together, so a task holds one bucket at a time
    sent = texts.mapInArrow(gather, "bucket long, entries binary, settled binary").repartition(min(buckets, MOST_TASKS), "bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(resolve, _RANGES)


def _cut(text: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[int, int, bytes]:
    """Bytes and spans removed, and what is left, for suffixes lo to hi."""
    by = np.argsort(lo, kind="stable")
    start, end = lo[by], np.maximum.accumulate(hi[by] + LENGTH)
    head = np.ones(len(start), bool)
    head[1:] = start[1:] > end[:-1]
    a, b = start[head], end[np.append(np.flatnonzero(head)[1:], len(end)) - 1]
    kept, at = [], 0
    for x, y in zip(a.tolist(), b.tolist()):
        kept.append(text[at:x])
        at = y
    kept.append(text[at:])
    return int((b - a).sum()), len(a), b"".join(kept)


def without_repeats(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the bytes left).

    Texts are UTF-8 bytes, null counts as empty, and strings that repeat only
    within a document stay. doc_id is taken to identify a text; rows that
    repeat both give equal rows. A row without a doc_id is a document of its
    own, after all others. Texts of less than LENGTH bytes are kept. Other
    columns are ignored.
    """
    docs, first = keyed_rows(docs.select("doc_id", "text"))
    out = _without_repeats(docs.select(F.col("_key").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), keep_text)
    return out if first is None else out.withColumn("doc_id", F.when(F.col("doc_id") < first, F.col("doc_id")))


def _without_repeats(docs: DataFrame, keep_text: bool) -> DataFrame:
    """without_repeats() of docs (doc_id, text) without nulls."""
    sized = staged(docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), text_digest().alias("digest")), "sized")
    total = sized.agg(F.sum("n_bytes")).first()[0] or 0
    copies = staged(whole_copies(docs, sized), "copies")
    firsts = docs.where(F.octet_length("text") >= LENGTH).join(copies, "doc_id", "left_anti")
    buckets, split_runs = max(int(total // BUCKET_BYTES), 32), max(SPLIT_RUNS, int(total // WINDOW // MOST_SPLIT))
    marks = staged(shared_anchors(firsts, buckets, split_runs), "marks")
    split = np.sort(np.array([r.anchor for r in marks.where("doc_id is null").select("anchor").distinct().collect()], np.int64))  # MOST_SPLIT times the runs of WINDOW bytes at most
    found = staged(repeated_suffixes(docs, marks.where("doc_id is not null").drop("anchor"), buckets, split), "ranges")
    removed(marks)

    def cut(batches):
        for batch in batches:
            lists, out = batch.column(2), []
            edges, flat = lists.offsets.to_numpy(), lists.flatten()
            lo, hi = (flat.field(k).to_numpy() for k in range(2))
            for k, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                span = slice(edges[k] - edges[0], edges[k + 1] - edges[0])
                removed, spans, kept = _cut(text.encode(), lo[span], hi[span])
                out.append((doc, removed, spans, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))], names=["doc_id", "n_removed", "n_spans", "kept_sha256", "kept"])

    listed = found.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    cuts = docs.join(listed, "doc_id").select("doc_id", "text", "ranges").mapInArrow(cut, "doc_id long, n_removed long, n_spans long, kept_sha256 string, kept binary").dropDuplicates(["doc_id"])
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    rows = sized.join(copies.withColumn("_copy", F.lit(True)), "doc_id", "left").join(cuts, "doc_id", "left")
    out = rows.select(
        "doc_id", "n_bytes", F.when(F.col("_copy"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("_copy"), 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("_copy"), nothing).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"), "kept", "_copy",
    )
    if not keep_text:
        return out.drop("kept", "_copy")
    untouched = docs.withColumnRenamed("text", "_text").dropDuplicates(["doc_id"])
    return out.join(untouched, "doc_id").withColumn("kept", F.when(F.col("_copy"), F.lit(b"")).otherwise(F.coalesce("kept", F.col("_text").cast("binary")))).drop("_copy", "_text")


def whole_copies(docs: DataFrame, sized: DataFrame) -> DataFrame:
    """(doc_id) of documents of LENGTH bytes or more whose text is, byte for byte, that of a document with a smaller doc_id.

    Digests only tell whom to compare. All suffixes of such a text start in the
    earlier document, so no bucket needs them.
    """
    groups = sized.where(F.col("n_bytes") >= LENGTH).groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    keyed = sized.select("doc_id", "digest").distinct().join(groups, "digest")
    texts = docs.join(keyed, "doc_id")  # of groups with copies only
    first = texts.where("doc_id = first").select("digest", F.col("text").alias("_t")).dropDuplicates(["digest"])
    return texts.where("doc_id > first").join(first, "digest").where("text = _t").select("doc_id").distinct()


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """without_repeats() of all documents, as digests."""
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False)
