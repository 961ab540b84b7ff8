"""Exact search among vectors by pivot cells.

Some rows, chosen by a hash, are pivots; each row belongs to the cell of its
nearest pivot. By the triangle inequality, a cell can be left out for a vector
when the vector is farther from the cell's pivot than the cell's radius and the
wanted distance together. Cells of any size are cut into blocks, and two blocks
that must meet are a matrix product: for pairs they are a group of rows, for
neighbours one row.

What comes to the driver is a row for each pivot, MOST_PIVOTS at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..places import stored

#: Rows of a block, and pivots at most.
BLOCK, MOST_PIVOTS = 512, 4096
#: For pairs: rows of a block, cells at most (a row visits up to half of them), tasks at most, and rows of a block that are multiplied at once.
PAIR_BLOCK, PAIR_CELLS, PAIR_TASKS, TILE = 4096, 64, 4096, 512
#: Distances between rows and pivots that a task holds at once.
HELD_DISTANCES = 1 << 19
#: What rounding may add to an angle or distance.
SLACK = 1e-6


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors of an array column of equal lengths, in double precision."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = c.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(c), -1) if len(c) else np.zeros((0, 0))


def unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=-1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def _pivots(rows: DataFrame, n: int) -> np.ndarray:
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(min(n, MOST_PIVOTS)).select("vector").collect()
    return np.array([r.vector for r in picked], np.float64)


def _blocks_of(cells: dict[int, int]) -> dict[int, int]:
    return {c: math.ceil(n / BLOCK) for c, n in cells.items()}


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table with a row for each cell."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles between unit vectors."""
    return np.arccos(np.clip(a @ b.T, -1, 1))


def _slices(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of n rows at most."""
    for b in batches:
        for k in range(0, b.num_rows, n):
            yield b.slice(k, n)


class PairPlan:
    """Which rows meet in which cells, for pairs of at least `threshold`.

    A row is in its own cell, and visits each other cell that may hold a
    partner; of two cells only one's rows visit the other, so that a pair meets
    once. x may have a partner in cell j only if it lies within the cell's
    radius and the angle of the threshold from pivot j, and not more than twice
    that angle farther from it than from its own pivot.

    A row goes to half of PAIR_CELLS cells at most, and there once for each
    block that its own must meet. Blocks are larger than cells for up to
    PAIR_CELLS * PAIR_BLOCK rows, so that what is sent grows with the rows, not
    with their pairs; beyond that a block's rows are held against more blocks,
    and a task still holds two blocks only.
    """

    def __init__(self, rows: DataFrame, threshold: float, cells: int | None = None, carry: tuple[str, ...] = ()):
        self.spark, self.limit = rows.sparkSession, math.acos(max(-1.0, min(1.0, threshold - 1e-9))) + SLACK if threshold > 0 else math.inf
        self.carry = list(carry)
        # below a threshold of 0 blocks are small, as every pair comes out
        self.block = PAIR_BLOCK if threshold > 0 else BLOCK
        kept = rows.where("vector is not null").select("id", "vector", F.array_sort("groups").alias("groups"), *self.carry)
        if threshold > 0:  # a zero vector is like none
            kept = kept.where(F.exists("vector", lambda x: x != 0))
        self.rows = stored(kept)
        self.n = self.rows.count()
        if not self.n:
            return
        pivots = unit(_pivots(self.rows, cells or min(math.ceil(self.n / BLOCK), PAIR_CELLS)))
        first = len(self.rows.columns)

        def home(batches):
            for b in batches:
                d = _apart(unit(matrix(b.column(1))), pivots)
                at = d.argmin(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at), pa.array(d[np.arange(len(at)), at])], names=[*b.schema.names, "home", "angle"])

        homes = stored(self.rows.mapInArrow(home, T.StructType([*self.rows.schema.fields, T.StructField("home", T.IntegerType()), T.StructField("angle", T.DoubleType())])))
        stats = {r.home: (r.r, r.n) for r in homes.groupBy("home").agg(F.max("angle").alias("r"), F.count(F.lit(1)).alias("n")).collect()}
        radius = np.array([stats[j][0] if j in stats else -np.inf for j in range(len(pivots))])
        limit, p = self.limit, len(pivots)

        def visit(batches):
            for b in batches:
                own, angle = b.column(first).to_numpy(), b.column(first + 1).to_numpy()
                d = _apart(unit(matrix(b.column(1))), pivots)
                ahead = (np.arange(p)[None, :] - own[:, None]) % p
                goes = (ahead > 0) & ((2 * ahead < p) | ((2 * ahead == p) & (own[:, None] < np.arange(p)[None, :])))
                goes &= (d <= radius + limit) & (d - angle[:, None] <= 2 * limit) & np.isfinite(radius)
                i, j = np.nonzero(goes)
                bounds = pa.array(np.searchsorted(i, np.arange(b.num_rows + 1)), pa.int32())
                at = pa.StructArray.from_arrays([pa.array(j.astype(np.int32)), pa.array(d[i, j])], names=["cell", "angle"])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(bounds, at)], names=[*b.schema.names, "visits"])

        self.placed = stored(homes.mapInArrow(visit, T.StructType([*homes.schema.fields, T.StructField("visits", T.ArrayType(T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])))])))
        self.residents = {c: n for c, (_, n) in stats.items()}
        self.visitors = {r.cell: r.n for r in self.placed.select(F.explode("visits.cell").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}

    def work(self) -> dict[str, int]:
        """Rows, cells, rows sent to cells, pairs compared, and all pairs there are."""
        if not self.n:
            return dict.fromkeys(["rows", "cells", "sent", "compared", "all"], 0)
        inside = sum(n * (n - 1) // 2 for n in self.residents.values())
        return {"rows": self.n, "cells": len(self.residents), "sent": self.n + sum(self.visitors.values()), "compared": inside + sum(n * self.residents[c] for c, n in self.visitors.items()), "all": self.n * (self.n - 1) // 2}

    def meetings(self) -> DataFrame:
        """(key, side, id, vector, groups, angle, ...): the rows of a key are two blocks that meet, sides 0 and 1, or one that meets itself, side 2."""
        sizes, at, used = [], 0, 0
        for c, n in self.residents.items():
            here, guests = math.ceil(n / self.block), math.ceil(self.visitors.get(c, 0) / self.block)
            sizes.append((c, at, here, guests))
            at, used = at + here * (here + guests), used + here * (here + 1) // 2 + here * guests
        sizes = _small(self.spark, sizes, "cell int, first long, here int, guests int")
        t, k = (F.pmod(F.xxhash64("id", F.lit(7)), F.col(c)) for c in ("here", "guests"))
        number = lambda x, y: F.col("first") + x * F.col("here") + y
        upto = lambda n, f: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.col(n) - 1), f))
        place = lambda x, y, side: F.struct(number(x, y).alias("key"), side.cast("int").alias("side"))
        none = F.array().cast("array<struct<key:bigint,side:int>>")
        inside = upto("here", lambda u: place(F.least(u, t), F.greatest(u, t), F.when(u == t, 2).when(u > t, 0).otherwise(1)))
        hosts = F.coalesce(upto("guests", lambda u: place(F.col("here") + u, t, F.lit(1))), none)
        visits = upto("here", lambda u: place(F.col("here") + k, u, F.lit(0)))
        own = ["id", "vector", "groups", *self.carry]
        home = self.placed.select(F.col("home").alias("cell"), "angle", *own).join(sizes, "cell").select(F.inline(F.concat(inside, hosts)), *own, "angle")
        away = self.placed.select(F.inline("visits"), *own).join(sizes, "cell").select(F.inline(visits), *own, "angle")
        return home.union(away).repartition(max(1, min(used, PAIR_TASKS)), "key")


def _exact(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Cosines of rows with rows, summed from first to last as SQL does."""
    dot, n, m = (np.cumsum(x * y, axis=1)[:, -1] for x, y in ((v, w), (v, v), (w, w)))
    return np.clip(np.divide(dot, np.sqrt(n * m), out=np.zeros(len(dot)), where=n * m > 0), -1, 1)


def _half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as SQL does: halves of what is multiplied go away from zero."""
    y = x * 10.0**digits
    whole = np.trunc(y)
    return (whole + np.where(np.abs(y - whole) >= 0.5, np.copysign(1.0, y), 0.0)) / 10.0**digits


def _group_codes(columns: list) -> list[np.ndarray]:
    """A number for each set of groups, and those sets."""
    known: dict[frozenset, int] = {}
    codes = [np.array([known.setdefault(frozenset(g or ()), len(known)) for g in c.to_pylist()], np.int64) for c in columns]
    return [*codes, list(known)]


def similar_pairs(rows: DataFrame, threshold: float = S.SIMILAR, exclude: str = "equal", cells: int | None = None, digits: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, score) with a < b and cosine >= threshold.

    rows: (id, vector, groups array). exclude `equal`: pairs whose sets of
    groups are equal are left out, whatever they share; `overlap`: pairs that
    share a group. Null vectors are in no pair, and zero vectors are like no
    other. Below a threshold of 0 every two rows are compared. Cosines are held
    against the threshold as they are, and rounded once. carry: columns of
    rows that come out for both ends, as c_a and c_b.
    """
    kind, fields = rows.schema["id"].dataType, [rows.schema[c] for c in carry]
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("score", T.DoubleType()), *[T.StructField(f"{f.name}_{x}", f.dataType) for f in fields for x in "ab"]])
    plan = PairPlan(rows, threshold, cells, carry)
    if not plan.n:
        return rows.sparkSession.createDataFrame([], schema)
    limit, names, tile = plan.limit, schema.names, TILE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).combine_chunks()
        side = t["side"].to_numpy()
        alone = bool((side == 2).any())
        one = t.filter(pa.array(side != 1)).sort_by("angle")
        two = one if alone else t.filter(pa.array(side == 1)).sort_by("angle")
        if not one.num_rows or not two.num_rows:
            return
        m1, m2 = matrix(one["vector"]), matrix(two["vector"])
        u1, u2, a1, a2 = unit(m1), unit(m2), one["angle"].to_numpy(), two["angle"].to_numpy()
        id1, id2 = (x["id"].to_numpy() for x in (one, two))
        g1, g2, sets = _group_codes([one["groups"], two["groups"]])
        for i in range(0, len(u1), tile):
            # of the angles to the same pivot only those near each other can be near
            j, end = np.searchsorted(a2, [a1[i] - limit, a1[min(i + tile, len(a1)) - 1] + limit])
            like = u1[i : i + tile] @ u2[j:end].T
            x, y = np.nonzero(like >= threshold - 1e-9)
            s, x, y = like[x, y], x + i, y + j
            ok = (x < y) if alone else np.ones(len(x), bool)
            ok &= id1[x] != id2[y]
            if exclude == "equal":
                ok &= g1[x] != g2[y]
            else:
                each, at = np.unique(g1[x] * len(sets) + g2[y], return_inverse=True)
                ok &= np.array([sets[p // len(sets)].isdisjoint(sets[p % len(sets)]) for p in each.tolist()], bool)[at]
            s, x, y = s[ok], x[ok], y[ok]
            # where the last bits decide, the order of the sum counts
            close = np.flatnonzero((np.abs(s - threshold) < 1e-9) | (np.abs(np.abs(s * 10.0**digits) % 1 - 0.5) < 1e-7))
            s[close] = _exact(m1[x[close]], m2[y[close]])
            ok = s >= threshold
            s, x, y = _half_up(s[ok], digits), x[ok], y[ok]
            if not len(s):
                continue
            p, q = id1[x], id2[y]
            first = p < q
            out = [np.where(first, p, q), np.where(first, q, p), s]
            for c in carry:
                v = pa.concat_arrays([*one[c].chunks, *two[c].chunks])
                out += [v.take(pa.array(np.where(first, x, y + len(u1)))), v.take(pa.array(np.where(first, y + len(u1), x)))]
            yield pa.RecordBatch.from_arrays([o if isinstance(o, pa.Array) else pa.array(o, w) for o, w in zip(out, (one["id"].type, one["id"].type, pa.float64(), *[None] * (2 * len(carry))))], names=names)

    return plan.meetings().groupBy("key").applyInArrow(run, schema)


def _scores(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """V1 or the squared distance of all queries (rows) and vectors, rounded."""
    if metric == "cosine":
        n = [np.linalg.norm(m, axis=1) + 1e-10 for m in (q, v)]
        return np.round(q @ v.T / np.outer(*n), 6)
    out = np.empty((len(q), len(v)))
    for i, x in enumerate(q):
        out[i] = ((v - x) ** 2).sum(axis=1)
    return np.round(out, 6)


def _best(products: DataFrame, k: int, metric: str, fields: list[T.StructField]) -> DataFrame:
    """(query_id, id, score): of products (queries, rows) the k best of each query, of those at least as good as its bound."""
    sign = -1.0 if metric == "cosine" else 1.0

    def run(batches):
        for batch in batches:
            for queries, rows in zip(batch.column(0), batch.column(1)):
                qs, rs = queries.values, rows.values
                ids, far = rs.field(0), sign * _scores(matrix(qs.field(1)), matrix(rs.field(1)), metric)
                order = np.array(ids.to_pylist(), dtype=object).argsort(kind="stable")  # ties go by id
                far = far[:, order]
                at = np.argsort(far, axis=1, kind="stable")[:, :k]
                picked = np.take_along_axis(far, at, axis=1)
                x, y = np.nonzero(picked <= qs.field(2).to_numpy()[:, None])
                if len(x):
                    yield pa.RecordBatch.from_arrays([qs.field(0).take(pa.array(x)), ids.take(pa.array(order[at[x, y]])), pa.array(sign * picked[x, y] + 0.0)], names=["query_id", "id", "score"])

    return products.mapInArrow(run, T.StructType([*fields, T.StructField("score", T.DoubleType())]))


def _ranked(hits: DataFrame, k: int, metric: str) -> DataFrame:
    key = F.desc("score") if metric == "cosine" else F.asc("score")
    # row_number() <= k is taken before the shuffle too
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(key, "id"))).where(F.col("rank") <= k)


def nearest(queries: DataFrame, rows: DataFrame, k: int = S.CANDIDATES, metric: str = "cosine", by: str | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k rows nearest to each query, ties by id.

    queries: (query_id, vector); rows: (id, vector); any number of both.
    metric: `cosine` (higher is nearer) or `l2` (squared distance). by: a column
    of both sides, for filtered search: only rows of the query's own value.
    Null vectors neither ask nor are found.

    A query first visits the cells next to it that hold k rows. Its k-th score
    there bounds what can still be found, and it then visits all cells that
    may hold something as good. A filtered search compares all rows of a value.
    """
    q = queries.where("vector is not null").select("query_id", "vector", *([F.col(by).alias("_by")] if by else []))
    r = rows.where("vector is not null").select("id", "vector", *([F.col(by).alias("_by")] if by else []))
    fields = [T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("id", rows.schema["id"].dataType)]
    spark = rows.sparkSession
    if by:
        return _ranked(_best(_by_value(q, r), k, metric, fields), k, metric)
    r = stored(r)
    n = r.count()
    if not n:
        return _ranked(spark.createDataFrame([], T.StructType([*fields, T.StructField("score", T.DoubleType())])), k, metric)
    flat = unit if metric == "cosine" else (lambda m: m)
    pivots = flat(_pivots(r, math.ceil(n / BLOCK)))
    at_once = max(1, HELD_DISTANCES // len(pivots))

    longest = np.sqrt((pivots**2).sum(axis=1)).max()

    def apart(m):
        """Distances to the pivots."""
        return np.sqrt(np.maximum((m**2).sum(axis=1)[:, None] - 2 * m @ pivots.T + (pivots**2).sum(axis=1)[None, :], 0))

    def aimless(m):
        """Whether vectors are too short to have a direction; such rows may be near anything."""
        return np.linalg.norm(m, axis=1) < 1e-4 if metric == "cosine" else np.zeros(len(m), bool)

    def home(batches):
        for b in _slices(batches, at_once):
            m = matrix(b.column(1))
            d, none = apart(flat(m)), aimless(m)
            at = d.argmin(axis=1).astype(np.int32)
            at[none] = -1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at), pa.array(np.where(none, np.inf, d[np.arange(len(at)), np.maximum(at, 0)]))], names=["id", "vector", "cell", "far"])

    homes = stored(r.mapInArrow(home, T.StructType([*r.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])))
    stats = {x.cell: (x.r, x.n) for x in homes.groupBy("cell").agg(F.max("far").alias("r"), F.count(F.lit(1)).alias("n")).collect()}
    cells = sorted(stats)
    radius, held = np.array([stats[c][0] for c in cells]), np.array([stats[c][1] for c in cells])
    number = np.array(cells)

    def bounds(m):
        """The least distance that a cell's rows can have to each query."""
        d = apart(m)
        rounding = 1e-7 * (np.linalg.norm(m, axis=1)[:, None] + longest + np.where(np.isfinite(radius), radius, 0))
        return np.where(np.isfinite(radius)[None, :], np.maximum(d[:, np.maximum(number, 0)] - radius - rounding, 0), 0.0), d

    def first(batches):
        for b in _slices(batches, at_once):
            least, d = bounds(flat(matrix(b.column(1))))
            near = np.argsort(np.where(number >= 0, d[:, np.maximum(number, 0)], -1.0), axis=1, kind="stable")
            enough = np.cumsum(held[near], axis=1)
            goes = np.zeros_like(least, bool)
            np.put_along_axis(goes, near, np.concatenate([np.ones((len(d), 1), bool), enough[:, :-1] < k], axis=1), axis=1)
            yield _visits(b, goes, np.full(len(d), np.inf))

    def rest(batches):
        for b in _slices(batches, at_once):
            m = matrix(b.column(1))
            least, worst = bounds(flat(m))[0], b.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
            # scores are rounded; the k-th becomes a distance between the points that cells are made of
            reach = np.sqrt(np.maximum(2 + 2 * worst, 0) + 1e-5) if metric == "cosine" else np.sqrt(np.maximum(worst, 0) + 1e-5)
            goes = least <= (reach * (1 + SLACK) + SLACK)[:, None]
            goes |= aimless(m)[:, None]
            for i, seen in enumerate(b.column(2).to_pylist()):
                goes[i, np.searchsorted(number, seen)] = False
            yield _visits(b, goes, np.where(np.isnan(worst), np.inf, worst))

    def _visits(b, goes, bound):
        i, j = np.nonzero(goes)
        at = pa.ListArray.from_arrays(pa.array(np.searchsorted(i, np.arange(b.num_rows + 1)), pa.int32()), pa.array(number[j].astype(np.int32)))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), at, pa.array(bound)], names=["query_id", "vector", "cells", "bound"])

    asked = T.StructType([*q.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType())), T.StructField("bound", T.DoubleType())])
    blocks = {c: math.ceil(m / BLOCK) for c, m in zip(cells, held.tolist())}
    sizes = _small(spark, list(blocks.items()), "cell int, blocks int")
    packed_rows = stored(homes.join(sizes, "cell").withColumn("t", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int")).groupBy("cell", "t").agg(F.collect_list(F.struct("id", "vector")).alias("rows")))

    def meet(visits):
        """Blocks of queries with each block of the cells they visit."""
        each = visits.select("query_id", "vector", "bound", F.explode("cells").alias("cell"))
        counted = each.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()
        if not counted:
            return None
        own = _small(spark, [(x.cell, math.ceil(x.n / BLOCK), blocks[x.cell]) for x in counted], "cell int, parts int, blocks int")
        packed = each.join(own, "cell").groupBy("cell", "blocks", F.pmod(F.xxhash64("query_id", F.lit(7)), F.col("parts")).alias("_k")).agg(F.collect_list(F.struct("query_id", "vector", "bound")).alias("queries"))
        left = packed.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("t"), "queries")
        return _best(left.join(packed_rows, ["cell", "t"]).select("queries", "rows"), k, metric, fields)

    one = stored(q.mapInArrow(first, asked))
    hits = meet(one)
    if hits is None:
        return _ranked(spark.createDataFrame([], T.StructType([*fields, T.StructField("score", T.DoubleType())])), k, metric)
    near = stored(_ranked(hits, k, metric))
    sign = F.lit(-1.0 if metric == "cosine" else 1.0)
    worst = near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.max(sign * F.col("score"))).alias("worst"))
    two = stored(one.join(worst, "query_id").select("query_id", "vector", "cells", F.coalesce("worst", F.lit(float("inf"))).alias("worst")).mapInArrow(rest, asked))
    more = meet(two)
    found = near.select("query_id", "id", "score")
    return _ranked(found if more is None else found.unionByName(more), k, metric)


def _by_value(q: DataFrame, r: DataFrame) -> DataFrame:
    """(queries, rows): blocks of queries and of rows that have the same value."""
    own = r.groupBy("_by").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    packed = r.join(own, "_by").groupBy("_by", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int").alias("t")).agg(F.collect_list(F.struct("id", "vector")).alias("rows"))
    asks = q.groupBy("_by").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    left = q.join(asks, "_by").groupBy("_by", F.pmod(F.xxhash64("query_id", F.lit(7)), F.col("parts")).alias("_k")).agg(F.collect_list(F.struct("query_id", "vector", F.lit(float("inf")).alias("bound"))).alias("queries"))
    left = left.join(own, "_by").select("_by", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("t"), "queries")
    return left.join(packed, ["_by", "t"]).select("queries", "rows")
