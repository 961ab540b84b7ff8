"""N-gram Jaccard join with filters under several global token orders.

A document is the set of its word n-grams (shingles). If two sets are similar,
they share one of their first tokens, whatever global order the tokens are put
in. Candidates must share prefix tokens under several orders, which are
intersected before sets are compared. How far a prefix reaches depends on the
pair: with sizes x and y and a needed overlap of o, the first common token is
among the first x - o + 1 of one and the first y - o + 1 of the other.

All orders put frequent tokens last and differ in how they arrange tokens that
are equally frequent. Frequencies are counted over all documents: packs of
texts send their tokens to the range of hashes that a task counts, and get back
those that occur more than once. A token that occurs once can't be shared, so
only its place in a prefix counts. The number of ranges follows the number of
tokens, so no task or broadcast grows with the input.

Tokens are named by a range and 32 bits of hash. Where two tokens of a set
have one name, both keep their places, and the first name that two similar
sets share is still in both prefixes; sets are compared by 64-bit hashes.

Only what can change components is compared. Equal sets are one node. First
every node is held against leaders of the buckets that it is in, which joins
large groups of near copies with a number of pairs in proportion to their
size; then all remaining candidates in different components are compared. Where
many documents share a token, as copies of one text do that are not similar to
each other, they meet by what sets them apart from one of them (around_pivots).
Documents meet only if the bits of their sets, odd or even by SIGNATURE_WORDS
words, differ in no more places than similar sets may differ in tokens
(may_match). So a crowd without similar texts makes few pairs, though its
members are still held against each other bit by bit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, join_counted, removed, staged
from .digest_index import keyed_rows
from .token_count import text_buffer
from .words import U, mixed, shingles, word_hashes

ORDERS = 3
#: Tokens that one task counts, on average.
RANGE_TOKENS = 1 << 21
LEADER_ROUNDS = 2
#: Rounds of leaders around pivots, at most.
PIVOT_ROUNDS = 4
#: Documents that share a token above which they meet by their differences from one of them.
LARGE_BUCKET = 8
BLOCK_BYTES = 4 << 20
#: 64-bit words of a set's signature. It tells sets of up to about a thousand tokens apart; sets of several thousands all pass.
SIGNATURE_WORDS = 8
#: Bits of the filter that tells which documents' sets are needed, for each of them and at most; others may pass it.
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 28


def _blocks(column: pa.Array):
    data, offsets = text_buffer(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def shingle_sets(b: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, ascending, and where each text's begin."""
    tokens, bounds = shingles(*word_hashes(b, offsets), n)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((tokens, doc))
    tokens, doc = tokens[order], doc[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (doc[1:] != doc[:-1])
    return tokens[new], np.searchsorted(doc[new], np.arange(len(bounds)))


def _sums(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, U), np.cumsum(x, dtype=U)])
    return (total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)


def _list(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)))


def signatures(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each set SIGNATURE_WORDS numbers, of whose bits each says whether the set has an odd number of the tokens that fall on it."""
    out = np.zeros((len(bounds) - 1, SIGNATURE_WORDS), np.int64)
    if len(tokens):
        h = mixed(tokens ^ U(0x2545F4914F6CDD1D))
        word = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) * SIGNATURE_WORDS + (h >> U(6) & U(0xFFFFFFFF)).astype(np.int64) % SIGNATURE_WORDS
        by = np.argsort(word, kind="stable")
        word, bit = word[by], (U(1) << (h & U(63)))[by]
        start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        out.ravel()[word[start]] = np.bitwise_xor.reduceat(bit, start).view(np.int64)
    return out


def may_match(percent: int) -> Column:
    """Whether sets of n_a and n_b tokens with signatures sig_a and sig_b can be similar: each bit that differs stands for a token, at least, that is in one of them only."""
    bits = sum((F.bit_count(F.col(f"sig_a.s{k}").bitwiseXOR(F.col(f"sig_b.s{k}"))) for k in range(SIGNATURE_WORDS)), F.lit(0))
    return bits * (100 + percent) <= (F.col("n_a").cast("long") + F.col("n_b")) * (100 - percent)


def prefix_length(size: np.ndarray, percent: int) -> np.ndarray:
    """How many first tokens of a set must hold one that a similar set shares."""
    return np.where(size > 0, size - (size * percent + 99) // 100 + 1, 0)


def profiles(docs: DataFrame, n: int) -> DataFrame:
    """One row per document: doc_id, n_shingles, fp1, fp2; equal sets have these 128 bits in common."""

    def run(batches):
        for batch in batches:
            for i, j, b, offsets in _blocks(batch.column(1)):
                tokens, bounds = shingle_sets(b, offsets, n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(bounds)), pa.array(_sums(mixed(tokens ^ U(0x5851F42D4C957F2D)), bounds)), pa.array(_sums(mixed(tokens ^ U(0x14057B7EF767814F)), bounds))], names=["doc_id", "n_shingles", "fp1", "fp2"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, fp1 long, fp2 long")


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2**32 byte by byte, so that high bytes, which are mostly zero, compress."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


_PACKED = "part int, pack long, name binary, owner binary, level binary, docs binary"
_NAMES = [c.split()[0] for c in _PACKED.split(", ")]
_KINDS = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)], names=_NAMES)


def packs(docs: DataFrame, n: int, ranges: int) -> DataFrame:
    """A block of texts is a pack: a row (part, pack, name, owner) for each range that its tokens fall into, and one with its documents' ids and set sizes."""

    def run(batches):
        pack = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, j, b, offsets in _blocks(batch.column(1)):
                tokens, bounds = shingle_sets(b, offsets, n)
                size = np.diff(bounds)
                owner = np.repeat(np.arange(j - i), size)
                part = (tokens >> U(32)) * U(ranges) >> U(32)
                name = part << U(32) | tokens & U(0xFFFFFFFF)
                by = np.argsort(name)
                name, owner, part = name[by], owner[by], part[by].astype(np.int64)
                used = np.unique(part)
                cut = np.searchsorted(part, np.append(used, ranges))
                low = (name & U(0xFFFFFFFF)).astype(np.uint32)
                rows = [(p, pack, _planes(_steps(low[x:y])), _planes(owner[x:y]), None, None) for p, x, y in zip(used.tolist(), cut, cut[1:])]
                rows.append((pack % ranges, pack, None, None, None, np.concatenate([ids[i:j], size]).astype("<i8").tobytes()))
                yield _packed(rows)
                pack += 1

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PACKED)


def counted(sent: DataFrame, ranges: int) -> DataFrame:
    """The packs' tokens that occur more than once, with their frequency (`level`: eight steps for each doubling)."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            passed = []
            for part, pack, name, owner, _, docs in zip(*(c.to_pylist() for c in batch.columns)):
                if docs is None:
                    held.setdefault(part, []).append((pack, name, owner))
                else:
                    passed.append((part, pack, None, None, None, docs))
            if passed:
                yield _packed(passed)
        for part in list(held):
            rows = held.pop(part)
            names = [np.cumsum(_from_planes(x), dtype=np.uint32) for _, x, _ in rows]
            every = np.concatenate(names)
            by = np.argsort(every)
            new = np.ones(len(every), bool)
            new[1:] = every[by[1:]] != every[by[:-1]]
            start = np.flatnonzero(new)
            count = np.empty(len(every), np.int64)
            count[by] = np.repeat(np.diff(np.append(start, len(every))), np.diff(np.append(start, len(every))))
            level = np.minimum(np.log2(count) * 8, 255).astype(np.uint8)
            at, out = 0, []
            for (pack, _, owner), own in zip(rows, names):
                k = np.flatnonzero(count[at : at + len(own)] > 1)
                if len(k):
                    out.append((part, pack, _planes(_steps(own[k])), _planes(_from_planes(owner)[k]), level[at + k].tobytes(), None))
                at += len(own)
            if out:
                yield _packed(out)

    return sent.repartition(ranges, "part").mapInArrow(run, _PACKED)


_PREFIXES = "doc_id long, n int, " + ", ".join(f"p{k} array<struct<pos:int,token:long>>" for k in range(ORDERS))


def prefixes(found: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n, p0, p1, ...): a document's set size and, under each order, the tokens of its prefix that other documents have too, with their places. Documents without such a token under some order can't be similar to any and have no row."""

    def of_pack(rows: list[tuple]):
        docs = next(r[5] for r in rows if r[5] is not None)
        ids, size = np.frombuffer(docs, "<i8").reshape(2, -1)
        rows = [r for r in rows if r[5] is None]
        if not rows:
            return
        name = np.concatenate([np.cumsum(_from_planes(r[2]), dtype=np.uint32).astype(U) | U(r[0]) << U(32) for r in rows])
        owner = np.concatenate([_from_planes(r[3]) for r in rows]).astype(np.int64)
        level = np.concatenate([np.frombuffer(r[4], np.uint8) for r in rows]).astype(U)
        shared = np.bincount(owner, minlength=len(ids))
        keep, before = prefix_length(size, percent), np.cumsum(shared) - shared
        lists, there = [], np.ones(len(ids), bool)
        for k in range(ORDERS):
            rank = level << U(56) | mixed(name ^ U((k + 1) * 0xD6E8FEB86659FD93 % (1 << 64))) >> U(8)
            by = np.lexsort((name, rank, owner))
            doc = owner[by]
            # tokens that occur once come first under every order
            pos = size[doc] - shared[doc] + np.arange(len(by)) - before[doc]
            first = pos < keep[doc]
            lists.append((name[by][first], pos[first], np.bincount(doc[first], minlength=len(ids)), doc[first]))
            there &= lists[-1][2] > 0
        if not there.any():
            return
        columns = [pa.array(ids[there]), pa.array(size[there].astype(np.int32))]
        for token, pos, many, doc in lists:
            mine = there[doc]
            values = pa.StructArray.from_arrays([pa.array(pos[mine].astype(np.int32)), pa.array(token[mine].astype(np.int64))], names=["pos", "token"])
            columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many[there])]), pa.int32()), values))
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", *(f"p{k}" for k in range(ORDERS))])

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[1] != held[0][1]:
                    yield from of_pack(held)
                    held = []
                held.append(row)
        if held:
            yield from of_pack(held)

    return found.repartition("pack").sortWithinPartitions("pack").mapInArrow(run, _PREFIXES)


def needed_sets(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(doc_id, tokens, sig) of the documents in ids.

    A filter of bounded size spares most other documents' texts; those that
    pass it are dropped by the join with ids.
    """
    size = 1 << 16
    while size < min(ids.count() * FILTER_BITS, MOST_FILTER_BITS):
        size *= 2
    bits = np.zeros(size, bool)
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(size))
    # Spark numbers a bitmap's values from 1
    maps = ids.select((bit + 1).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
    for r in maps.toLocalIterator():  # MOST_FILTER_BITS / 8 bytes at most
        part = np.unpackbits(np.frombuffer(r["map"], np.uint8), bitorder="little")
        at = (r["bucket"] - 1) * 32768
        bits[at : at + len(part)] = part
    packed = np.packbits(bits, bitorder="little")

    def run(batches):
        for batch in batches:
            at = batch.column(2).to_numpy()
            want = (packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            if not want.any():
                continue
            batch = batch.filter(pa.array(want))
            for i, j, b, offsets in _blocks(batch.column(1)):
                sets = shingle_sets(b, offsets, n)
                sig = pa.StructArray.from_arrays([pa.array(w) for w in signatures(*sets).T], names=words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), _list(*sets), sig], names=["doc_id", "tokens", "sig"])

    words = [f"s{k}" for k in range(SIGNATURE_WORDS)]
    found = docs.select(F.col("doc_id").cast("long"), "text").withColumn("bit", bit).mapInArrow(run, f"doc_id long, tokens array<long>, sig struct<{','.join(w + ':long' for w in words)}>")
    return found.join(ids, "doc_id", "left_semi")


def overlap(x: str, y: str, percent: int) -> Column:
    """The common tokens that sets of x and y tokens need."""
    return F.expr(f"((cast({x} as long) + {y}) * {percent} + {99 + percent}) div {100 + percent}")


def in_all_orders(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that share a token of the pair's prefixes under every order; rows: prefixes()."""
    side = lambda x: rows.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), *[F.col(f"p{k}").alias(f"p{k}_{x}") for k in range(ORDERS)])
    met = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("o", overlap("n_a", "n_b", percent))
    first = lambda k, x: F.transform(F.filter(f"p{k}_{x}", lambda e: e["pos"] <= F.col(f"n_{x}") - F.col("o")), lambda e: e["token"])
    for k in range(ORDERS):
        met = met.where(F.arrays_overlap(first(k, "a"), first(k, "b")))
    return met.select("a", "b")


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets (doc_id, tokens) have a Jaccard similarity of at least percent / 100."""
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("tokens").alias(f"tokens_{x}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    both = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return met.where(both * 100 >= percent * (F.size("tokens_a") + F.size("tokens_b") - both)).select("a", "b")


def _near_size(x: str, y: str, percent: int):
    return F.least(x, y).cast("long") * 100 >= F.greatest(x, y).cast("long") * percent


def _early(x: str, x_pos: str, y: str, y_pos: str, percent: int):
    """Whether a token at these places of sets of x and y tokens can be their first common one, if they are similar."""
    o = overlap(x, y, percent)
    return (F.col(x_pos) <= F.col(x) - o) & (F.col(y_pos) <= F.col(y) - o)


def similar_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: documents linked by Jaccard similarity of at least percent / 100.

    Texts are lower-cased (A-Z) and cut into words at white space; a text of
    fewer than n words has its whole word sequence as one shingle. Null texts
    and texts without words have an empty set and are linked with nothing.
    component_id is the smallest doc_id that links reach, itself included.
    One row comes back for each row of docs. A doc_id that occurs with several
    texts is one document: its component joins those of all its texts. A row
    without a doc_id is a document of its own, after all others; component_id
    is null where links reach no doc_id. Other columns are ignored, an empty
    table gives an empty result, and texts of any length are read whole.
    """
    docs, first = keyed_rows(docs.select("doc_id", "text"))
    out = _key_components(docs.select(F.col("_key").alias("doc_id"), "text"), n, percent)
    if first is None:
        return out
    own = lambda c: F.when(F.col(c) < first, F.col(c)).alias(c)
    return out.select(own("doc_id"), "n_shingles", own("component_id"))


def _key_components(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """similar_components() of docs whose doc_ids are not null."""
    rows = staged(profiles(docs, n), "profiles")
    some = rows.where("n_shingles > 0")
    groups = staged(some.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies")), "groups")
    # of equal sets one document speaks; a doc_id with several texts speaks for each of them
    speaks = groups.select(F.col("node").alias("doc_id")).distinct()
    total = groups.agg(F.sum("n")).first()[0] or 0
    ranges = max(int(total // RANGE_TOKENS), 16)
    alone = staged(rows.join(speaks, "doc_id", "left_anti").select("doc_id").distinct(), "copies")
    firsts = docs.withColumn("doc_id", F.col("doc_id").cast("long")).join(alone, "doc_id", "left_anti")
    found = staged(counted(packs(firsts, n, ranges), ranges), "shared")
    entries = staged(prefixes(found, percent), "prefixes")
    removed(found)
    labels = _linked(firsts, entries, n, percent)
    removed(entries)
    named = groups.join(labels, "node", "left").select("fp1", "fp2", "copies", F.coalesce("label", "node").alias("component_id"))
    linked = join_counted(some, named, ["fp1", "fp2"], "copies").select("doc_id", "n_shingles", "component_id")
    if rows.groupBy("doc_id").agg(F.count_distinct("fp1", "fp2").alias("c")).where("c > 1").limit(1).count():
        linked = _joined_by_id(staged(linked, "linked"))
    return linked.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _joined_by_id(linked: DataFrame) -> DataFrame:
    """Components that share a doc_id, because it has several texts, become one."""
    parts = linked.select("doc_id", "component_id").distinct()
    least = parts.groupBy("doc_id").agg(F.min("component_id").alias("a"))
    to = components(parts.join(least, "doc_id").where("component_id > a").select("a", F.col("component_id").alias("b")))
    to = to.select(F.col("node").alias("component_id"), "label")
    return linked.join(to, "component_id", "left").select("doc_id", "n_shingles", F.coalesce("label", "component_id").alias("component_id"))


def _linked(docs: DataFrame, entries: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, label) over all links between the entries' documents."""
    comp = staged(entries.select("doc_id", F.col("doc_id").alias("comp")).distinct(), "components")
    tokens = entries.select("doc_id", "n", F.inline("p0"))
    # only documents that meet others under the first order can be candidates
    met = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token")
    asked = staged(tokens.join(met, "token", "left_semi").select("doc_id").distinct(), "asked")
    sets = staged(needed_sets(docs, asked, n), "sets")
    removed(asked)
    # a document that shares no token under the first order has no signature and is in no bucket
    sigs = sets.select("doc_id", "sig")

    def merge(pairs: DataFrame) -> DataFrame:
        """Components after the links among the pairs."""
        pairs = staged(in_all_orders(pairs, entries, percent), "pairs")
        links = staged(similar(pairs, sets, percent), "links")
        of = lambda x: comp.select(F.col("doc_id").alias(x), F.col("comp").alias(f"c{x}"))
        edges = staged(links.join(of("a"), "a").join(of("b"), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "edges")
        removed(pairs, links)
        if edges.isEmpty():
            removed(edges)
            return comp
        to = components(edges)
        after = staged(comp.join(to.select(F.col("node").alias("comp"), "label"), "comp", "left").select("doc_id", F.coalesce("label", "comp").alias("comp")), "components")
        removed(edges, to, comp)
        return after

    def mixed_buckets(leader: Column) -> DataFrame:
        """Tokens of the first order whose documents are of different components still: how many there are, and their leader."""
        now = tokens.join(comp, "doc_id").groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("many"), F.min(leader).alias("lead"))
        return now.where("lo < hi").drop("lo", "hi")

    for k in range(LEADER_ROUNDS):
        # the leader of a bucket: its first document, later by a hash that differs by round
        leader = F.struct(F.xxhash64("doc_id", F.lit(k)), "doc_id", "n", "comp", "pos") if k else F.struct("doc_id", "n", "comp", "pos")
        led = tokens.join(mixed_buckets(leader), "token").join(comp, "doc_id").where(F.col("comp") != F.col("lead.comp"))
        led = led.select(F.col("doc_id").alias("b"), "n", "pos", F.col("lead.doc_id").alias("a"), F.col("lead.n").alias("m"), F.col("lead.pos").alias("at"))
        led = led.where(_near_size("n", "m", percent) & _early("n", "pos", "m", "at", percent)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
        comp = merge(led.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a")).select("a", "b"))
    open_ = staged(mixed_buckets(F.struct(F.xxhash64("doc_id"), "doc_id")), "buckets")
    crowd = staged(tokens.join(open_.where(F.col("many") > LARGE_BUCKET), "token").select(F.col("lead.doc_id").alias("pivot"), "doc_id").distinct(), "crowd")
    apart = staged(from_pivots(crowd, sets), "apart")
    close = F.col("nd") * (100 + percent) <= (F.col("n") + F.col("n_pivot")) * (100 - percent)
    comp = merge(apart.where(close & (F.col("pivot") != F.col("doc_id"))).select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")))
    rest = staged(tokens.join(open_.where(F.col("many") <= LARGE_BUCKET).select("token"), "token").join(comp, "doc_id").join(sigs, "doc_id"), "rest")
    # a is the smaller set: as a similar one is no smaller, its own prefix is short
    side = lambda x: [F.col("doc_id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "pos", "comp", "sig")]]
    x = rest.where(F.col("pos") <= F.col("n") - overlap("n", "n", percent)).select("token", *side("a"))
    y = rest.select("token", *side("b"))
    smaller = (F.col("n_a") < F.col("n_b")) | (F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b"))
    near = _near_size("n_a", "n_b", percent) & _early("n_a", "pos_a", "n_b", "pos_b", percent)
    few = x.join(y, "token").where(smaller & (F.col("comp_a") != F.col("comp_b")) & near & may_match(percent)).select("a", "b")
    others = staged(differences(apart), "differences")
    comp = merge(around_leaders(others, comp, sigs, percent).unionByName(few).distinct())
    # two groups of near copies have very many links but need one: other leaders find it with few pairs
    for k in range(1, PIVOT_ROUNDS):
        after = merge(around_leaders(others, comp, sigs, percent, k))
        if after is comp:
            break
        comp = after
    comp = merge(around_pivots(others, comp, sigs, percent).distinct())
    removed(open_, crowd, apart, rest, others, sets)
    return comp.select(F.col("doc_id").alias("node"), F.col("comp").alias("label"))


def from_pivots(crowd: DataFrame, sets: DataFrame) -> DataFrame:
    """(pivot, doc_id, n, n_pivot, nd, d): d holds the nd tokens that are in one of the sets only."""
    met = crowd.join(sets, "doc_id").join(sets.select(F.col("doc_id").alias("pivot"), F.col("tokens").alias("_p")), "pivot")
    rows = met.select("pivot", "doc_id", F.size("tokens").alias("n"), F.size("_p").alias("n_pivot"), F.concat(F.array_except("tokens", "_p"), F.array_except("_p", "tokens")).alias("d"))
    return rows.withColumn("nd", F.size("d"))


def differences(apart: DataFrame) -> DataFrame:
    """(pivot, token, doc_id, n, nd, pos): the tokens of differences from a pivot that another difference from it holds too, and their places; rare ones come first."""
    each = apart.select("pivot", "doc_id", F.explode("d").alias("token"))
    often = each.groupBy("pivot", "token").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    own = each.join(often, ["pivot", "token"]).groupBy("pivot", "doc_id").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("shared"))
    rows = apart.drop("d", "n_pivot").join(own, ["pivot", "doc_id"])
    # tokens that no other difference holds come before all others
    rows = rows.select("pivot", "doc_id", "n", "nd", (F.col("nd") - F.size("shared")).alias("_u"), F.posexplode("shared").alias("_i", "_t"))
    return rows.select("pivot", F.col("_t.token").alias("token"), "doc_id", "n", "nd", (F.col("_u") + F.col("_i")).alias("pos"))


def _met(rows: DataFrame, pairs: DataFrame, percent: int, on: list[str]) -> DataFrame:
    """rows and pairs with the columns of sides a and b joined, where a token can be the first that the differences share."""
    n, m, v, w = (F.col(c).cast("long") for c in ("n_a", "n_b", "nd_a", "nd_b"))
    o = F.greatest(F.lit(1), _needed(n, m, v, w, percent))
    near = _near_size("n_a", "n_b", percent) & (F.col("pos_a") <= F.col("nd_a") - o) & (F.col("pos_b") <= F.col("nd_b") - o)
    return rows.join(pairs, on).where((F.col("comp_a") != F.col("comp_b")) & near & may_match(percent))


def _needed(n: Column, m: Column, v: Column, w: Column, percent: int) -> Column:
    """Tokens that differences of v and w tokens share if sets of n and m tokens are similar: half of what v + w has beyond the tokens that may be in one set only."""
    return F.ceil((v + w - F.floor((n + m) * (100 - percent) / (100 + percent))) / 2)


def _side(x: str) -> list[Column]:
    return [F.col("doc_id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "nd", "pos", "comp", "sig")]]


def around_leaders(others: DataFrame, comp: DataFrame, sigs: DataFrame, percent: int, salt: int = 0) -> DataFrame:
    """Pairs (a, b) of documents with the first one, in an order that goes by the salt, that shares a token of their difference: one at most for each place of a token."""
    rows = others.join(comp, "doc_id").join(sigs, "doc_id")
    first = rows.groupBy("pivot", "token").agg(F.min_by(F.struct("doc_id", "n", "nd", "pos", "comp", "sig"), F.struct(F.xxhash64("doc_id", F.lit(salt)), "doc_id")).alias("_l")).select("pivot", "token", "_l.*")
    met = _met(rows.select("pivot", "token", *_side("b")), first.select("pivot", "token", *_side("a")), percent, ["pivot", "token"])
    return met.select("a", "b").distinct()


def around_pivots(others: DataFrame, comp: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) among the documents of a pivot, in different components.

    Sets of x and y tokens are similar if at most s = (x + y) * (100 - percent)
    / (100 + percent) tokens are in one of them only. These are the tokens in
    which their differences from the pivot differ, so with differences of v and
    w tokens they share o = (v + w - s) / 2 of them. If that is no more than 0,
    both are similar to the pivot, with which they are linked already. Else
    the first shared token, rare ones first, is among the first v - o + 1 and
    w - o + 1. So documents that all share most of a text, but no more than
    that, do not meet: what counts is what they share beyond it.
    """
    rows = others.join(comp, "doc_id").join(sigs, "doc_id")
    # a has the smaller difference; the largest set that can be similar to one of n tokens has n * 100 / percent
    n, v = F.col("n").cast("long"), F.col("nd").cast("long")
    least = F.greatest(F.lit(1), _needed(n, F.floor(n * 100 / percent), v, v, percent))
    x = rows.where(F.col("pos") <= v - least).select("pivot", "token", *_side("a"))
    smaller = (F.col("nd_a") < F.col("nd_b")) | (F.col("nd_a") == F.col("nd_b")) & (F.col("a") < F.col("b"))
    met = _met(x, rows.select("pivot", "token", *_side("b")), percent, ["pivot", "token"]).where(smaller)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near copies: of each component the smallest doc_id stays. Same columns as docs.

    A row without a doc_id is a document of its own, after all others.
    """
    docs, _ = keyed_rows(docs)
    kept = _key_components(docs.select(F.col("_key").alias("doc_id"), "text"), n, percent).where("doc_id = component_id").select(F.col("doc_id").alias("_key")).distinct()
    return docs.join(kept, "_key", "left_semi").select("row.*")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """similar_components() of all documents over three-word shingles, at 90 percent."""
    return similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, percent=90)
