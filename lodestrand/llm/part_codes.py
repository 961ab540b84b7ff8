"""Compression of vectors to one code per part, by Lloyd's rounds with Hamerly's bounds.

Components become whole numbers, and vectors are cut into equal parts. Each part
position has a codebook. A round assigns every part to its nearest entry and
then moves each entry to the mean of its parts, all in whole numbers. Beside its
entry a part keeps two bounds from round to round: no more than `upper` to its
own entry, no less than `lower` to any other. Entries that move widen the bounds
by as much. Only where upper is not strictly below lower (or half the way to the
nearest other entry) is the part compared with all entries, exactly; ties go to
the lower index. Bounds are floats that are rounded away from each other.

Vectors stay where they are: a round reads and writes a table without a shuffle.
What meets on the driver are sums per entry, as many as the codebooks have
numbers, whatever the table's size.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, load, removed, staged

#: What components are multiplied by.
SCALE = 4096
#: Components are kept within this, so that all squares and sums are exact.
LIMIT = 1 << 26
#: Rows that are compared with entries together.
ROWS = 8192

FIGURES = "scans long, skips long"
STATE = f"vec_id long, label string, vec binary, code binary, upper binary, lower binary, sums array<long>, counts array<long>, {FIGURES}"


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.asarray(x).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.asarray(x).astype(np.float32), np.float32(-np.inf))


def squared(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances, exactly, of each part (rows) to each entry."""
    return ((parts[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)


@dataclass
class Codebooks:
    """entries[part, entry, component], and how far each entry came from where it was a round before."""

    entries: np.ndarray
    moved: np.ndarray | None = None
    #: Half the way from each entry to the nearest other, rounded down
    half: np.ndarray = field(init=False)

    def __post_init__(self):
        parts, k, _ = self.entries.shape
        self.half = np.empty((parts, k), np.float32)
        for p in range(parts):
            d = squared(self.entries[p], self.entries[p]).astype(np.float64)
            np.fill_diagonal(d, np.inf)
            self.half[p] = _down(np.sqrt(d.min(axis=1)) / 2)

    def after(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """Entries moved to floor(sum / count); those without parts stay."""
        new = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], self.entries)
        return Codebooks(new, _up(np.sqrt(((new - self.entries) ** 2).sum(axis=2).astype(np.float64))))

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def assign(books: Codebooks, vecs: np.ndarray, code: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest entries of all parts of vecs[row, part, component], with bounds (row, part); and how many parts were compared with all entries.

    code, upper, lower: those of the round before, or None in the first one.
    """
    n, parts, _ = vecs.shape
    if code is None:
        code, upper, lower = np.zeros((n, parts), np.uint8), np.full((n, parts), np.inf, np.float32), np.zeros((n, parts), np.float32)
    else:
        code, upper, lower = code.copy(), upper.copy(), lower.copy()
    scanned = 0
    for p in range(parts):
        entries, mine = books.entries[p], code[:, p]
        if books.moved is not None:
            moved = books.moved[p]
            upper[:, p] = _up(upper[:, p] + moved[mine])
            # the entry that moved most, or the next if it's the part's own
            order = np.argsort(-moved, kind="stable")
            most = np.full(len(moved), moved[order[0]], np.float32)
            most[order[0]] = moved[order[1]] if len(moved) > 1 else 0
            lower[:, p] = _down(lower[:, p] - most[mine])
        bound = np.maximum(lower[:, p], books.half[p][mine])
        rows = np.flatnonzero(~(upper[:, p] < bound))
        if len(rows):  # first tighten the upper bound
            own = ((vecs[rows, p] - entries[mine[rows]]) ** 2).sum(axis=1)
            upper[rows, p] = _up(np.sqrt(own.astype(np.float64)))
            rows = rows[~(upper[rows, p] < bound[rows])]
        scanned += len(rows)
        for at in range(0, len(rows), ROWS):
            r = rows[at : at + ROWS]
            d = squared(vecs[r, p], entries)
            best = d.argmin(axis=1)  # the lowest index of equal ones
            code[r, p] = best
            upper[r, p] = _up(np.sqrt(d[np.arange(len(r)), best].astype(np.float64)))
            d = d.astype(np.float64)
            d[np.arange(len(r)), best] = np.inf
            lower[r, p] = _down(np.sqrt(d.min(axis=1))) if len(entries) > 1 else np.float32(np.inf)
    return code, upper, lower, scanned


def _binary(x: np.ndarray) -> pa.Array:
    """The rows of an array as binary values."""
    x = np.ascontiguousarray(x)
    width = x.nbytes // len(x) if len(x) else 0
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * width), pa.py_buffer(x.tobytes())])


def _rows(column: pa.Array, kind, *shape) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _round(state: DataFrame, books: Codebooks, parts: int, sums: bool = True) -> DataFrame:
    """The state after one assignment; the last row of each partition has its sums and counts per entry."""

    def run(batches):
        k, width = books.entries.shape[1:]
        total, count, figures = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64), [0, 0]
        names = [c.split()[0] for c in STATE.split(", ")]
        empty = lambda n, t: pa.nulls(n, t)
        for batch in batches:
            for at in range(0, batch.num_rows, 4 * ROWS):
                b = batch.slice(at, 4 * ROWS)
                col, n = {name: b.column(i) for i, name in enumerate(names[:6])}, b.num_rows
                vecs = _rows(col["vec"], np.int32, parts, width).astype(np.int64)
                first = col["code"].null_count == n
                code, upper, lower, scanned = assign(books, vecs, *([None] * 3 if first else [_rows(col[c], t, parts) for c, t in (("code", np.uint8), ("upper", np.float32), ("lower", np.float32))]))
                figures[0] += scanned
                figures[1] += n * parts - scanned
                for p in range(parts if sums else 0):
                    np.add.at(total[p], code[:, p], vecs[:, p])
                    count[p] += np.bincount(code[:, p], minlength=k)
                yield pa.RecordBatch.from_arrays([col["vec_id"], col["label"], col["vec"], _binary(code), _binary(upper), _binary(lower), empty(n, pa.list_(pa.int64())), empty(n, pa.list_(pa.int64())), empty(n, pa.int64()), empty(n, pa.int64())], names=names)
        yield pa.RecordBatch.from_arrays([empty(1, pa.int64()), empty(1, pa.string()), *(empty(1, pa.binary()) for _ in range(4)), pa.array([total.ravel()], pa.list_(pa.int64())), pa.array([count.ravel()], pa.list_(pa.int64())), pa.array([figures[0]]), pa.array([figures[1]])], names=names)

    return state.mapInArrow(run, STATE)


def _sums(state: DataFrame, column: str, size: int) -> np.ndarray:
    """A column of sums over all partitions; `size` rows come to the driver."""
    rows = state.where("sums is not null").select(F.posexplode(column).alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(size, np.int64)
    for r in rows:
        out[r.at] = r.x
    return out


def whole_vectors(rows: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """(vec_id, label, comps) of the rows whose vector is whole, with components as whole numbers, and the number of components in a part.

    Null vectors and those with null or non-finite components are left out.
    Vectors shorter than the longest are filled up with zeros, and all to a
    multiple of the number of parts.
    """
    x = F.col("embedding")
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), x.cast("array<double>").alias("v"))
    kept = kept.where(F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    width = -(-(kept.agg(F.max(F.size("v"))).first()[0] or 0) // parts) or 1
    bounded = lambda c: F.greatest(F.lit(float(-LIMIT)), F.least(F.lit(float(LIMIT)), F.floor(F.greatest(F.lit(-1e12), F.least(F.lit(1e12), c * SCALE))).cast("double"))).cast("int")
    comps = F.transform("v", bounded)
    return kept.select("vec_id", "label", F.concat(comps, F.array_repeat(F.lit(0), F.lit(parts * width) - F.size("v"))).alias("comps")), width


def first_books(vectors: DataFrame, parts: int, entries: int, width: int) -> np.ndarray:
    """The parts of the vectors with the smallest ids: entries[part, entry, component]. Rows without an id come last; equal ids go by components."""
    rows = vectors.orderBy(F.asc_nulls_last("vec_id"), "comps").limit(entries).select("comps").collect()
    return np.array([r.comps for r in rows], np.int64).reshape(len(rows), parts, width).transpose(1, 0, 2)


def train_codes(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[DataFrame, Codebooks | None, list[tuple[int, int]]]:
    """The final state (STATE, without sums), the codebooks, and for each assignment how many parts were compared with all entries and how many were not.

    rows: vec_id, embedding (array of numbers), label. A table with fewer
    vectors than entries has that many entries; without any the codebooks are
    None. At most 256 entries.
    """
    if not 1 <= entries <= 256:
        raise ValueError("codes are single bytes")
    vectors, width = whole_vectors(rows, parts)
    pack = F.lit(None).cast("binary")
    ints = staged(vectors, "vectors")
    first = first_books(ints, parts, entries, width)

    def packed(batches):
        for b in batches:
            flat = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(b.num_rows, parts * width)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _binary(flat)], names=["vec_id", "label", "vec"])

    none = [pack.alias(c) for c in ("code", "upper", "lower")]
    state = ints.mapInArrow(packed, "vec_id long, label string, vec binary").select("*", *none)
    if not first.size:
        return state, None, []
    books, held, figures = Codebooks(first), ints, []
    k = first.shape[1]
    for r in range(rounds + 1):
        after = staged(_round(state.select("vec_id", "label", "vec", "code", "upper", "lower"), books, parts, r < rounds), "codes")
        removed(held)
        held, state = after, after.where("sums is null")
        figures.append(tuple(after.agg(F.sum("scans"), F.sum("skips")).first()))
        if r < rounds:
            books = books.after(_sums(after, "sums", first.size).reshape(first.shape), _sums(after, "counts", parts * k).reshape(parts, k))
    return held, books, figures


def coded(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every row whose vector is whole.

    Vectors that are null or hold null or non-finite components have no row.
    code: two hex digits for each part. error: final squared distances, summed
    over the parts. label_error: error summed over equal labels, nulls
    together. Rows that repeat count each by itself. Vectors shorter than the
    longest are filled up with zeros; components beyond LIMIT / SCALE count as
    that. Other columns are ignored; an empty table gives no rows.
    """
    state, books, _ = train_codes(rows, parts, entries, rounds)
    schema = "vec_id long, label string, code string, error long"
    if books is None:
        return state.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    final = books.entries

    def measure(batches):
        for b in batches:
            vecs, code = _rows(b.column(2), np.int32, parts, final.shape[2]).astype(np.int64), _rows(b.column(3), np.uint8, parts)
            error = ((vecs - final[np.arange(parts), code]) ** 2).sum(axis=(1, 2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.hex() for x in map(bytes, code)], pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    each = staged(state.where("sums is null").select("vec_id", "label", "vec", "code").mapInArrow(measure, schema).select("*", F.struct(F.isnull("label").alias("none"), F.coalesce("label", F.lit("")).alias("l")).alias("of")), "code-errors")
    removed(state)
    totals = each.groupBy("of").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    return join_counted(each, totals, ["of"], "n").select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op12_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """coded() of all embeddings: 8 parts, 16 entries, 6 rounds; null and broken vectors have no row, an empty table gives none, repeated rows count each by itself."""
    return coded(load(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def oracle(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """coded() in DuckDB's SQL, round by round and without bounds; all vectors of one length that the parts divide."""
    distance = "list_sum(list_transform(range(1, CAST(len({v}) AS BIGINT) + 1), lambda i: ({v}[i] - {c}[i]) * ({v}[i] - {c}[i])))"
    nearest = lambda k: f"a{k} AS MATERIALIZED (SELECT rid, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT x.rid, x.p, c.e, {distance.format(v='x.v', c='c.v')} AS d FROM cut x JOIN c{k} c ON x.p = c.p) GROUP BY rid, p)"
    steps = [nearest(0)]
    for k in range(rounds):
        steps.append(
            f"m{k} AS (SELECT p, e, i, sum(v) AS s, count(*) AS n FROM (SELECT a.p, a.e, unnest(x.v) AS v, unnest(range(len(x.v))) AS i FROM a{k} a JOIN cut x ON a.rid = x.rid AND a.p = x.p) GROUP BY p, e, i)"
            f", n{k} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY i) AS v FROM m{k} GROUP BY p, e)"
            f", c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(n.v, c.v) AS v FROM c{k} c LEFT JOIN n{k} n ON c.p = n.p AND c.e = n.e)"
        )
        steps.append(nearest(k + 1))
    last = rounds
    return f"""
WITH whole AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS MATERIALIZED (
  SELECT rid, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS v FROM whole, range({parts}) AS r(p)
), c0 AS MATERIALIZED (SELECT p, rid - 1 AS e, v FROM cut WHERE rid <= {entries}),
{', '.join(steps)},
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS h FROM c{last}),
coded AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{last} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM coded JOIN whole USING (rid), books
"""
