"""Document quality by a linear-chain conditional random field over lines.

Every line gets a state, good or bad. A line's potential depends on features
of the line and of its neighbours, and a transition weight ties a line to the
next. Forward-backward gives each line's probability of being good; their mean,
weighted by the lines' bytes, is the document's quality.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name
from .token_count import text_buffer
from .words import SEPARATORS, find_words, span_hashes

#: Labelled documents that a model is fitted on at most, taken by a hash of the doc_id.
TRAIN_DOCS = 4000
#: Lines that it is fitted on at most, and the number of stretches that a document's are taken from if that is too few for all.
TRAIN_LINES, STRETCHES = 400_000, 8
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
BLOCK_BYTES = 2 << 20
#: Texts of more bytes are read in windows.
LONG_BYTES = 64 << 10

#: Byte classes whose shares of a line are features (fixed values).
CLASSES = {
    "upper": range(0x41, 0x5B), "lower": range(0x61, 0x7B), "wide": range(0x80, 0x100), "digit": range(0x30, 0x3A), "space": [0x20, 0x09, 0x0D],
    "dot": b".?", "comma": b",;:", "shout": b"!", "bar": b"|", "sign": b"#$%&*@^~=+_", "bracket": b"()[]{}<>/\\", "quote": b"\"'`-",
}
OWN = len(CLASSES) + 8
FEATURES = 3 * OWN + 1


#: What is counted of a line: bytes of each class; words like the one before and like the one before that, words, words that begin with a capital.
COUNTS = len(CLASSES) + 4
#: Bytes whose running sums are held at a time.
PIECE = 1 << 20
_TABLES = np.zeros((len(CLASSES), 256), np.int32)
for _k, _members in enumerate(CLASSES.values()):
    _TABLES[_k, list(_members)] = 1
NO_WORDS = np.zeros(0, np.uint64)


def line_counts(b: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, tail: np.ndarray = NO_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the lines b[start:end], which follow each other, and the hashes of the last line's last two words.

    offsets part words like separators do. tail holds the last two words of the
    part of the first line that came before b.
    """
    out = np.zeros((len(starts), COUNTS), np.int64)
    for lo in range(0, len(b), PIECE):
        hi = min(lo + PIECE, len(b))
        i, j = int(np.searchsorted(ends, lo, side="right")), int(np.searchsorted(starts, hi))
        s, e = np.clip(starts[i:j], lo, hi) - lo, np.clip(ends[i:j], lo, hi) - lo
        for k, table in enumerate(_TABLES):
            total = np.concatenate([[0], np.cumsum(table[b[lo:hi]], dtype=np.int32)])
            out[i:j, k] += total[e] - total[s]
    ws, we = find_words(b, offsets)
    first, last = np.searchsorted(ws, starts), np.searchsorted(ws, ends)
    words, t = np.concatenate([tail, span_hashes(b, ws, we)]), len(tail)
    k = len(CLASSES)
    for gap in (1, 2):
        hit = np.zeros(len(words) + 1, np.int32)
        hit[gap + 1 :] = words[gap:] == words[:-gap]
        same = np.cumsum(hit)
        begin = first + t + gap
        begin[:1] = max(t, gap)  # the first line goes on after the tail
        out[:, k + gap - 1] = np.maximum(same[last + t] - same[np.minimum(begin, last + t)], 0)
    out[:, k + 2] = last - first
    capital = np.concatenate([[0], np.cumsum((b[ws] >= 0x41) & (b[ws] <= 0x5A), dtype=np.int32)])
    out[:, k + 3] = capital[last] - capital[first]
    return out, words[max(0 if len(starts) == 1 else int(first[-1]) + t, len(words) - 2) :]


def own_features(counts: np.ndarray, size: np.ndarray, again: np.ndarray) -> np.ndarray:
    """Features of lines by themselves: counts, bytes, and whether their text has had the line before."""
    k = len(CLASSES)
    f = np.zeros((len(size), OWN), np.float32)
    length, words = np.maximum(size, 1).astype(np.float32), np.maximum(counts[:, k + 2], 1).astype(np.float32)
    f[:, :k] = counts[:, :k] / length[:, None]
    f[:, k : k + 2] = counts[:, k : k + 2] / words[:, None]
    f[:, k + 2] = again
    f[:, k + 3] = counts[:, k + 2] / length * 5
    f[:, k + 4] = np.log1p(size) / 8
    f[:, k + 5] = size < 20
    f[:, k + 6] = size == 0
    f[:, k + 7] = counts[:, k + 3] / words
    return f


def line_features(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their bytes (1 at least) and the number of lines before each text and in all.

    A text is cut at line feeds; an empty text is one empty line.
    """
    breaks = np.flatnonzero(b == 0x0A) + 1
    # a text's start, and each place after a line feed that is not the text's end
    inner = breaks[~np.isin(breaks, offsets)] if len(breaks) else breaks
    starts = np.concatenate([offsets[:-1], inner])
    doc = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, inner, side="right") - 1])
    order = np.lexsort((starts, doc))
    starts, doc = starts[order], doc[order]
    ends = np.append(starts[1:], len(b))
    size = ends - starts
    lh = span_hashes(b, starts, ends)
    by = np.lexsort((lh, doc))
    again = np.zeros(len(lh), bool)
    again[by[1:]] = (lh[by[1:]] == lh[by[:-1]]) & (doc[by[1:]] == doc[by[:-1]]) & (size[by[1:]] > 1)
    f = own_features(line_counts(b, offsets, starts, ends)[0], size, again)
    bounds = np.searchsorted(doc, np.arange(len(offsets)))
    out = np.zeros((len(starts), FEATURES), np.float32)
    out[:, :OWN] = f
    out[1:, OWN : 2 * OWN] = np.where((doc[1:] == doc[:-1])[:, None], f[:-1], 0)
    out[:-1, 2 * OWN : 3 * OWN] = np.where((doc[1:] == doc[:-1])[:, None], f[1:], 0)
    out[:, -1] = 1
    return out, np.maximum(size, 1), bounds


class Seen:
    """Hashes met so far, as sorted arrays of which each is longer than the next."""

    def __init__(self):
        self.parts: list[np.ndarray] = []

    def again(self, h: np.ndarray) -> np.ndarray:
        """Whether each hash was met before, earlier in h or in an earlier call."""
        by = np.argsort(h, kind="stable")
        out = np.zeros(len(h), bool)
        out[by[1:]] = h[by[1:]] == h[by[:-1]]
        for part in self.parts:
            out |= part[np.minimum(np.searchsorted(part, h), len(part) - 1)] == h
        new = np.sort(h[~out])
        while len(new) and self.parts and len(self.parts[-1]) <= len(new):
            new = np.union1d(self.parts.pop(), new)
        if len(new):
            self.parts.append(new)
        return out


def cuts(b: np.ndarray, step: int) -> Iterator[tuple[int, int]]:
    """Windows of about `step` bytes that end after a separator (or with the text)."""
    lo = 0
    while lo < len(b):
        hi = lo + step
        while hi < len(b):
            gap = np.flatnonzero(np.isin(b[hi - 1 : hi - 1 + step], SEPARATORS))
            if len(gap):
                hi += int(gap[0])
                break
            hi += step
        yield lo, min(hi, len(b))
        lo = hi


def own_windows(b: np.ndarray, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """own_features() and bytes of one text's lines, those that end in one window at a time."""
    seen, counts, begin, tail = Seen(), None, 0, NO_WORDS
    for lo, hi in cuts(b, step):
        w = b[lo:hi]
        breaks = np.flatnonzero(w == 0x0A) + 1
        starts = np.concatenate([[0], breaks[breaks < len(w)]])
        ends = np.append(starts[1:], len(w))
        more, tail = line_counts(w, np.array([0, len(w)]), starts, ends, tail)
        at = starts + lo
        if counts is not None:
            more[0] += counts
            at[0] = begin
        counts = None
        size = ends + lo - at
        if hi < len(b) and w[-1] != 0x0A:  # the last line goes on
            counts, begin = more[-1], int(at[-1])
            more, size, starts, ends = more[:-1], size[:-1], starts[:-1], ends[:-1]
        else:
            tail = NO_WORDS
        if not len(size):
            continue
        lh = span_hashes(w, starts, ends)
        if at[0] < lo:
            lh[:1] = span_hashes(b[at[0] : lo + ends[0]], np.array([0]), size[:1])
        yield own_features(more, size, seen.again(lh) & (size > 1)), size


def text_features(b: np.ndarray, step: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """line_features() of one text, some lines after the other, in memory that does not grow with the text but for its lines' hashes."""
    if not len(b):
        yield line_features(b, np.zeros(2, np.int64))[:2]
        return
    before, f, size = np.zeros((1, OWN), np.float32), np.zeros((0, OWN), np.float32), np.zeros(0, np.int64)
    nothing = np.zeros((1, OWN), np.float32)
    windows, more = own_windows(b, step), True
    while more:
        g, n = next(windows, (None, None))
        more = g is not None
        f, size = (np.concatenate([f, g]), np.concatenate([size, n])) if more else (np.concatenate([f, nothing]), size)
        k = len(f) - 1  # the last line's next is not known yet
        if k > 0:
            yield _beside(before, f), size[:k]
            before = f[k - 1 : k]
        f, size = f[k:], size[k:]


def _beside(before: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Features of all lines of f but the last, with those of the line before and after each."""
    own = f[:-1]
    return np.concatenate([own, np.concatenate([before, own[:-1]]), f[1:], np.ones((len(own), 1), np.float32)], axis=1)


def chain(potential: np.ndarray, ties: np.ndarray, message: float) -> tuple[np.ndarray, float]:
    """The message (log odds of "good") that reaches each line from its left, and the one that leaves the last line.

    Segments of the chain are composed side by side to maps of both states,
    messages at their borders follow one after the other, and then those within.
    """
    n = len(potential)
    k = max(int(np.sqrt(n)), 1)
    s = n // k
    (aa, ab), (ba, bb) = ties
    grid = potential[: s * k].reshape(s, k)
    bad, good = np.array([[0.0], [-np.inf]]).repeat(s, 1), np.array([[-np.inf], [0.0]]).repeat(s, 1)
    for j in range(k):
        good = good + grid[:, j]
        bad, good = np.logaddexp(bad + aa, good + ba), np.logaddexp(bad + ab, good + bb)
    enter = np.zeros(s)
    for i in range(s):
        enter[i] = message
        message = np.logaddexp(good[0, i], message + good[1, i]) - np.logaddexp(bad[0, i], message + bad[1, i])
    out, m = np.zeros(n), enter
    over = lambda odds: np.logaddexp(ab, bb + odds) - np.logaddexp(aa, ba + odds)
    for j in range(k):
        out[j : s * k : k] = m
        m = over(m + grid[:, j])
    for i in range(s * k, n):
        out[i] = message
        message = over(message + potential[i])
    return out, float(message)


@dataclass
class LineCrf:
    """weights: of the state "good" over a line's scaled features; ties: of a transition from state to state."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    ties: np.ndarray

    def potentials(self, features: np.ndarray) -> np.ndarray:
        return (np.clip((features - self.mean) / self.scale, -6, 6) * self.weights).sum(1)  # by row, whatever rows are beside it

    def marginals(self, potential: np.ndarray, bounds: np.ndarray, pairs: bool = False):
        """Each line's probability of "good"; with pairs also log Z and the summed transition probabilities.

        Chains run side by side, longest first; messages are kept as log odds
        of "good", normalised at every line.
        """
        size = np.diff(bounds)
        order = np.argsort(-size, kind="stable")
        at, size = bounds[:-1][order], size[order]
        more = len(size) - np.cumsum(np.bincount(size)) if len(size) else np.zeros(0, int)
        (aa, ab), (ba, bb) = self.ties  # from bad (a) or good (b)
        over = lambda odds: np.logaddexp(ab, bb + odds) - np.logaddexp(aa, ba + odds)
        before, after = np.zeros(len(potential)), np.zeros(len(potential))
        logz = np.zeros(len(size))
        m = np.zeros(len(size))
        for k, n in enumerate(more.tolist()):
            if not n:
                break
            i = at[:n] + k
            if k:
                before[i] = over(m[:n])
                logz[:n] += np.logaddexp(aa, ba + m[:n]) - np.logaddexp(0, m[:n]) + np.logaddexp(0, before[i] + potential[i])
            else:
                logz[:n] = np.logaddexp(0, potential[i])
            m[:n] = before[i] + potential[i]
        back = lambda odds: np.logaddexp(ba, bb + odds) - np.logaddexp(aa, ab + odds)
        for k in range(len(more) - 1, 0, -1):
            n = int(more[k])
            if n:
                i = at[:n] + k
                after[i - 1] = back(potential[i] + after[i])
        odds = before + potential + after
        p = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        if not pairs:
            return p
        linked = np.ones(len(potential), bool)
        linked[bounds[1:][bounds[1:] > 0] - 1] = False
        i = np.flatnonzero(linked)
        left, right = before[i] + potential[i], potential[i + 1] + after[i + 1]
        joint = np.stack([np.full(len(i), aa), ab + right, ba + left, bb + left + right])
        joint = np.exp(joint - joint.max(0))
        joint = (joint / joint.sum(0)).sum(1).reshape(2, 2)
        return p, logz.sum(), joint

    def scores(self, features: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        p = self.marginals(self.potentials(features).astype(np.float64), bounds)
        at = bounds[:-1]  # a text has a line at least
        return np.clip(np.add.reduceat(p * size, at) / np.add.reduceat(size, at), 0, 1) if len(at) else np.zeros(0)

    def text_score(self, b: np.ndarray, step: int = PIECE) -> float:
        """scores() of one text of any length: twelve bytes are held for each line, the rest is done a window at a time."""
        kept, edges, message = [], [], 0.0
        for f, size in text_features(b, step):
            potential = self.potentials(f).astype(np.float64)
            kept.append((potential, size.astype(np.int32)))
            edges.append(message)
            message = chain(potential, self.ties, message)[1]
        good, total, message = 0.0, 0, 0.0
        while kept:
            potential, size = kept.pop()
            before = chain(potential, self.ties, edges.pop())[0]
            after, message = chain(potential[::-1], self.ties.T, message)
            p = 1 / (1 + np.exp(-np.clip(before + potential + after[::-1], -60, 60)))
            size = np.maximum(size, 1)
            good, total = good + float((p * size).sum()), total + int(size.sum(dtype=np.int64))
        return min(max(good / total, 0.0), 1.0)

    @classmethod
    def fit(cls, features: np.ndarray, bounds: np.ndarray, good: np.ndarray, rounds: int = 300, ridge: float = 2e-3, step: float = 0.05) -> LineCrf:
        """Maximum likelihood with a ridge, by Adam; a document's label is the label of all its lines."""
        n = features.shape[1]
        if not len(features):
            return cls(np.zeros(n), np.ones(n), np.zeros(n), np.zeros((2, 2)))
        mean, scale = features.mean(0), features.std(0) + 1e-3
        mean[-1], scale[-1] = 0, 1
        x = np.clip((features - mean) / scale, -6, 6).astype(np.float64)
        y = np.repeat(good.astype(np.float64), np.diff(bounds))
        linked = np.ones(len(x), bool)
        linked[bounds[1:][bounds[1:] > 0] - 1] = False
        i = np.flatnonzero(linked)
        seen = np.array([[((1 - y[i]) * (1 - y[i + 1])).sum(), ((1 - y[i]) * y[i + 1]).sum()], [(y[i] * (1 - y[i + 1])).sum(), (y[i] * y[i + 1]).sum()]])
        w, docs = np.zeros(n + 4), max(len(bounds) - 1, 1)
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, rounds + 1):
            crf = cls(mean, scale, w[:n], w[n:].reshape(2, 2))
            p, _, joint = crf.marginals(x @ w[:n], bounds, pairs=True)
            g = np.concatenate([x.T @ (y - p), (seen - joint).ravel()]) / docs - ridge * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w + step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        return cls(mean, scale, w[:n], w[n:].reshape(2, 2))


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def level(counts: list[int], total: int) -> int:
    """The largest number of lines that each text may give so that all give `total` at most (1 at least)."""
    left = sorted(counts)
    for k, n in enumerate(left):
        if n * (len(left) - k) > total:
            return max(total // (len(left) - k), 1)
        total -= n
    return max(left, default=1)


def chosen(n: int, most: int) -> list[tuple[int, int]]:
    """Stretches of a text's n lines, `most` in all: the whole text, or up to STRETCHES evenly placed ones from its first line to its last."""
    if n <= most:
        return [(0, n)]
    parts = min(STRETCHES, most)
    size = most // parts
    return [(a, a + size) for a in ((n - size) * k // max(parts - 1, 1) for k in range(parts))]


def line_number() -> Column:
    """The number of a text's lines: its line feeds, and what follows the last."""
    text = F.col("text")
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1)


def train(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS, max_lines: int = TRAIN_LINES) -> LineCrf:
    """Fits a model on at most max_docs labelled documents outside the held-out fold, and max_lines of their lines.

    The sample is drawn by a hash of the doc_id, so it does not depend on how
    the rows lie. Documents give all their lines if that is max_lines at most;
    else the longest give stretches from all over the text, so many that all
    lines are max_lines. Rows without a label or text teach nothing.
    """
    known = labels.where(F.col("quality").isNotNull() & (fold() != HELD_OUT)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    every = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(drawn), "doc_id")  # max_docs rows at most
    by = ["doc_id", "_text"]  # rows that repeat a doc_id are told apart by their text
    sample = every.withColumn("_text", F.xxhash64("text"))
    numbers = sample.select(*by, line_number().alias("n")).orderBy(*by).limit(max_docs).collect()
    most = level([r.n for r in numbers], max_lines)

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for i, (a, b) in enumerate(zip(offsets, offsets[1:])):
                n = batch.column(4)[i].as_py()
                parts: list[list[bytes]] = [[] for _ in chosen(n, most)]
                at = 0
                for f, _ in text_features(data[a:b]):
                    for part, (lo, hi) in zip(parts, chosen(n, most)):
                        if lo < at + len(f) and hi > at:
                            part.append(f[max(lo - at, 0) : hi - at].tobytes())
                    at += len(f)
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([row.column(0), row.column(2), row.column(3), pa.array([[b"".join(p) for p in parts]], pa.list_(pa.binary()))], names=["doc_id", "quality", "_text", "f"])

    rows = sample.select("doc_id", "text", "quality", "_text", line_number().alias("n")).mapInArrow(run, "doc_id long, quality int, _text long, f array<binary>")
    rows = rows.orderBy(*by).limit(max_docs).collect()
    parts = [(r.quality, np.frombuffer(p, np.float32).reshape(-1, FEATURES)) for r in rows for p in r.f]
    bounds = np.cumsum([0, *(len(f) for _, f in parts)])
    return LineCrf.fit(np.concatenate([f for _, f in parts]) if parts else np.zeros((0, FEATURES), np.float32), bounds, np.array([y for y, _ in parts]))


def scored(docs: DataFrame, model: LineCrf, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the quality of each whole text in column `out` (which is replaced if it is there).

    Null and empty texts are one empty line and get its score.
    """
    keep = [c for c in docs.columns if c != out]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(out, T.DoubleType())])

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(keep.index(text)))
            result, i, n = np.zeros(len(offsets) - 1), 0, len(offsets) - 1
            while i < n:
                if offsets[i + 1] - offsets[i] > LONG_BYTES:
                    result[i] = model.text_score(data[offsets[i] : offsets[i + 1]])
                    i += 1
                    continue
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, side="right")) - 1)
                j = min([j, *(k for k in range(i + 1, j) if offsets[k + 1] - offsets[k] > LONG_BYTES)])
                result[i:j] = model.scores(*line_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                i = j
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(result)], names=[*keep, out])

    return docs.select(*keep).mapInArrow(run, schema)


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose quality is at least the threshold; same columns as docs, whatever their names.

    Every row is judged by its own text, also rows that repeat or have no
    doc_id; null and empty texts have the quality of an empty line. An empty
    table gives an empty result.
    """
    score = free_name(docs, "score")
    return scored(docs, train(docs, labels), out=score).where(F.col(score) >= threshold).drop(score)


def op6_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by a model of the labelled ones. Null and empty texts score as one empty line; held_out is null for a row without a doc_id; without labels all scores are one half."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("doc_id", (fold() == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
