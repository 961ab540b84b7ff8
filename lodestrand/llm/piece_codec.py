"""SentencePiece unigram encoding and decoding.

Pieces and their log scores are compiled into a double-array trie. Texts get a
leading whitespace marker, spaces become markers, and a text is cut where no
piece can reach across (before a marker, around a line end), which leaves the
best segmentation as it is. Distinct units are segmented by Viterbi, all of a
block side by side; a character that no piece covers falls back to its bytes.
Decoding joins the pieces, with byte pieces as bytes, and turns markers back
into spaces.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
#: What a character outside all pieces scores below the worst piece, as unigram models have it.
UNKNOWN_PENALTY = 10.0
#: Bytes of distinct units whose pieces are kept by a worker, each counted with what a dictionary needs for it.
MEMO_BYTES, ENTRY_BYTES = 12 << 20, 120
#: Characters of text that are encoded at once, and bytes of a unit that is segmented on its own, a window at a time.
BLOCK_CHARS, LONG_UNIT, WINDOW = 1 << 19, 256, 1 << 15


class DoubleArray:
    """A trie over bytes: from node s, byte c leads to t = base[s] + c if check[t] == s."""

    def __init__(self, keys: dict[bytes, int]):
        root: dict = {}
        for key in keys:
            node = root
            for c in key:
                node = node.setdefault(c, {})
        size = 1 << 12
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.check[0], free, top, queue = 0, 1, 1, [(root, 0, b"")]
        used = bytearray(size)
        used[0] = 1
        for children, s, prefix in queue:  # grows while it is walked
            if not children:
                continue
            cs = sorted(children)
            if len(cs) == 1:  # fills the gaps that others left
                while used[free] or free <= cs[0]:
                    free += 1
                b = free - cs[0]
            else:
                b = top = max(1, top)
                while any(used[b + c] for c in cs):
                    b += 1
                top = b
            if b + 512 > len(used):
                used.extend(bytes(len(used)))
            if len(used) > len(self.base):
                grow = len(used) - len(self.base)
                self.base, self.check, self.value = np.pad(self.base, (0, grow)), np.pad(self.check, (0, grow), constant_values=-1), np.pad(self.value, (0, grow), constant_values=-1)
            self.base[s] = b
            for c in cs:
                used[b + c] = 1
                self.check[b + c] = s
                key = prefix + bytes([c])
                self.value[b + c] = keys.get(key, -1)
                queue.append((children[c], b + c, key))
        self.base = np.pad(self.base, (0, 256))
        self.check = np.pad(self.check, (0, 256), constant_values=-1)
        self.value = np.pad(self.value, (0, 256), constant_values=-1)
        self.check[0] = -1  # nothing leads to the root


class PieceCodec:
    """pieces: text, log score and kind ('piece', 'byte', 'unknown' or 'control') by id."""

    def __init__(self, pieces: list[tuple[str, float, str]]):
        own = {p.encode(): i for i, (p, _, kind) in enumerate(pieces) if kind == "piece" and p}
        self.score = np.array([s for _, s, _ in pieces], np.float64)
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == "unknown"), 0)
        self.byte_ids = [next((i for i, (p, _, kind) in enumerate(pieces) if kind == "byte" and p == f"<0x{x:02X}>"), None) for x in range(256)]
        self.has_bytes = None not in self.byte_ids
        self.unknown_score = min((self.score[i] for i in own.values()), default=0.0) - UNKNOWN_PENALTY
        self.trie = DoubleArray(own)
        self.longest = max(map(len, own), default=1)
        self.bytes = [bytes([int(p[1:-1], 16)]) if kind == "byte" else p.encode() if kind == "piece" else b"" for p, _, kind in pieces]
        texts = [p for p, _, kind in pieces if kind == "piece"]
        # cuts that no piece reaches across
        self.cut_mark = not any(MARK in p.lstrip(MARK) for p in texts)
        self.cut_line = not any("\n" in p and len(p) > 1 for p in texts)
        self.units = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+" if self.cut_line else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.memo: dict[str, bytes] = {"": b""}
        self.held = 0

    @classmethod
    def load(cls, path: str) -> PieceCodec:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        kind = lambda i: "byte" if m.is_byte(i) else "unknown" if m.is_unknown(i) else "control" if m.is_control(i) or m.is_unused(i) else "piece"
        return cls([(m.id_to_piece(i), m.get_score(i), kind(i)) for i in range(m.get_piece_size())])

    def split(self, text: str, whole: bool = True) -> list[str]:
        """The units of a text, or of a part of one that starts with a space."""
        marked = (MARK if whole else "") + text.replace(" ", MARK)
        if not self.cut_mark:
            return [marked]
        if not whole or "  " in text or text[0] == " " or MARK in text:
            return self.units.findall(marked)
        marked = marked.replace(MARK, " " + MARK)
        return (marked.replace("\n", " \n ") if self.cut_line else marked).split(" ")

    def slices(self, text: str) -> list[str]:
        """The text in parts of about BLOCK_CHARS, cut where units end."""
        out, at = [], 0
        while self.cut_mark and len(text) - at > BLOCK_CHARS:
            cut = text.find(" ", at + BLOCK_CHARS)
            while cut >= 0 and text[cut - 1] in " " + MARK:
                cut = text.find(" ", cut + 1)
            if cut < 0:
                break
            out.append(text[at:cut])
            at = cut
        return [*out, text[at:] if at else text]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as int32; an empty text has none."""
        parts = [self.slices(t) if t else [] for t in texts]
        if all(len(p) < 2 for p in parts):
            return self._encode([(t, True) for t in texts])
        out = []
        for part in parts:
            ids = [self._encode([(x, not k)])[0] for k, x in enumerate(part)]
            out.append(np.concatenate(ids) if ids else np.zeros(0, np.int32))
        return out

    def _encode(self, texts: list[tuple[str, bool]]) -> list[np.ndarray]:
        units = [self.split(t, whole) if t else [] for t, whole in texts]
        new = set().union(*units) - self.memo.keys() if units else set()
        size = sum(map(len, new)) * 2 + ENTRY_BYTES * len(new)
        if self.held + size > MEMO_BYTES:
            self.memo, self.held = {"": b""}, 0
            new = set().union(*units) - {""}
            size = sum(map(len, new)) * 2 + ENTRY_BYTES * len(new)
        listed = list(new)
        self.memo.update(zip(listed, self.segment(listed)))
        self.held += size
        out = [np.frombuffer(b"".join(map(self.memo.__getitem__, u)), np.int32) for u in units]
        if self.held > MEMO_BYTES:
            self.memo, self.held = {"": b""}, 0
        return out

    def segment(self, units: list[str]) -> list[bytes]:
        """Viterbi over each unit; of equal scores the one whose last piece is longest wins."""
        raw = [u.encode() for u in units]
        short = [i for i, r in enumerate(raw) if len(r) <= LONG_UNIT]
        out = [b"" if len(r) <= LONG_UNIT else self.segment_long(r) for r in raw]
        for i, ids in zip(short, self._side_by_side([raw[i] for i in short])):
            out[i] = ids
        return out

    def matches(self, text: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces that begin at the first `last` bytes of text: where, their bytes and their ids, by place and length."""
        row, s, d = np.arange(last), np.zeros(last, np.int64), 0
        found = []
        while len(row):
            t = self.trie.base[s] + text[row + d]
            ok = self.trie.check[t] == s
            row, s, d = row[ok], t[ok].astype(np.int64), d + 1
            v = self.trie.value[s]
            hit = v >= 0
            found.append((row[hit], np.full(int(hit.sum()), d), v[hit]))
            ok = row + d < len(text)
            row, s = row[ok], s[ok]
        at, size, ids = (np.concatenate(c) for c in zip(*found))
        by = np.lexsort((size, at))
        return at[by], size[by], ids[by]

    def segment_long(self, raw: bytes) -> bytes:
        """Viterbi over one long unit. Pieces are looked up a window at a time, so beyond the unit and four bytes for each of its bytes no memory grows with it."""
        text, n = np.frombuffer(raw, np.uint8), len(raw)
        reach = max(self.longest, 4) + 1
        best = [-math.inf] * (WINDOW + reach)  # of the places from the window's first on
        best[0] = 0.0
        step = np.zeros(n + 1, np.int32)  # bytes of the last piece (below 0: a character without one)
        piece = np.full(n + 1, -1, np.int32)
        score, unknown = self.score, self.unknown_score
        for lo in range(0, n, WINDOW):
            last = min(WINDOW, n - lo)
            at, size, ids = self.matches(text[lo : lo + last + self.longest], last)
            worth = score[ids].tolist()
            begin = np.searchsorted(at, np.arange(last + 1)).tolist()
            size_, ids_ = size.tolist(), ids.tolist()
            steps, pieces = [0] * (last + reach), [-1] * (last + reach)
            steps[: min(reach, n + 1 - lo)] = step[lo : lo + reach].tolist()
            pieces[: min(reach, n + 1 - lo)] = piece[lo : lo + reach].tolist()
            for k in range(last):
                x = raw[lo + k]
                if x & 0xC0 == 0x80:
                    continue
                here, width = best[k], 1 if x < 0xC0 else 2 if x < 0xE0 else 3 if x < 0xF0 else 4
                whole = False
                for e in range(begin[k], begin[k + 1]):
                    d = size_[e]
                    new = here + worth[e]
                    if new > best[k + d]:
                        best[k + d], steps[k + d], pieces[k + d] = new, d, ids_[e]
                    whole |= d == width
                if not whole and here + unknown > best[k + width]:
                    best[k + width], steps[k + width], pieces[k + width] = here + unknown, -width, -1
            end = min(n + 1, lo + last + reach)
            step[lo:end], piece[lo:end] = steps[: end - lo], pieces[: end - lo]
            best = best[last : last + reach] + [-math.inf] * WINDOW
        out, p = [], n
        while p > 0:
            d = int(step[p])
            if d > 0:
                out.append(int(piece[p]))
            else:
                d = -d
                out += [self.byte_ids[x] for x in reversed(raw[p - d : p])] if self.has_bytes else [self.unknown]
            p -= d
        return np.array(out[::-1], np.int32).tobytes()

    def _side_by_side(self, raw: list[bytes]) -> list[bytes]:
        """Viterbi over many units, the bytes of which are walked together."""
        if not raw:
            return []
        size = np.array([len(r) for r in raw])
        order = np.argsort(-size, kind="stable")
        size = size[order]
        text = np.frombuffer(b"".join(raw[i] for i in order), np.uint8)
        at = np.cumsum(size) - size  # a unit's first byte
        node0 = at + np.arange(len(at))  # and its first position: one more than bytes for each unit
        best = np.full(len(text) + len(at), -np.inf)
        best[node0] = 0.0
        piece, came = np.full(len(best), -1, np.int32), np.zeros(len(best), np.int64)
        head = (text & 0xC0) != 0x80
        width = np.where(text < 0xC0, 1, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4)))
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        more = len(size) - np.cumsum(np.bincount(size))
        for k, n in enumerate(more.tolist()):
            if not n:
                break
            live = np.flatnonzero(head[at[:n] + k])  # units in which a character starts here
            first, start = at[live] + k, node0[live] + k
            left, score, w = size[live] - k, best[start], width[first]
            whole = np.zeros(len(live), bool)  # a piece covers just this character
            s, d, row = np.zeros(len(live), np.int64), 0, np.arange(len(live))
            while len(row):
                c = text[first[row] + d]
                t = base[s] + c
                ok = check[t] == s
                row, s, d = row[ok], t[ok].astype(np.int64), d + 1
                v = value[s]
                hit = v >= 0
                if hit.any():
                    r, ids = row[hit], v[hit]
                    to, new = start[r] + d, score[r] + self.score[ids]
                    better = new > best[to]
                    best[to[better]], piece[to[better]], came[to[better]] = new[better], ids[better], start[r][better]
                    whole[r] |= w[r] == d
                ok = left[row] > d
                row, s = row[ok], s[ok]
            r = np.flatnonzero(~whole)
            to, new = start[r] + w[r], score[r] + self.unknown_score
            better = new > best[to]
            best[to[better]], piece[to[better]], came[to[better]] = new[better], -1, start[r][better]
        out: list[bytes] = [b""] * len(raw)
        piece_of, came_from, ends, begins = piece.tolist(), came.tolist(), (node0 + size).tolist(), node0.tolist()
        for i, (p, begin) in enumerate(zip(ends, begins)):
            ids = []
            while p > begin:
                q = came_from[p]
                if piece_of[p] >= 0:
                    ids.append(piece_of[p])
                else:
                    gone = raw[order[i]][q - begin : p - begin]
                    ids += [self.byte_ids[x] for x in reversed(gone)] if self.has_bytes else [self.unknown]
                p = q
            out[order[i]] = np.array(ids[::-1], np.int32).tobytes()
        return out

    def decode(self, ids) -> str:
        """The text of ids. Bytes that are no UTF-8 become U+FFFD; control pieces are left out."""
        ids = np.asarray(ids, np.int64)
        parts = [b"".join(map(self.bytes.__getitem__, ids[k : k + WINDOW].tolist())) for k in range(0, len(ids), WINDOW)]
        text = b"".join(parts).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec.load(path)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _blocks(column: pa.Array):
    """Texts of a batch in blocks of about BLOCK_CHARS; null counts as empty."""
    block, size = [], 0
    for x in column:
        block.append(x.as_py() or "")
        size += len(block[-1])
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def encoded(docs: DataFrame, path: str | None = None, text: str = "text", out: str = "token_ids", check: str | None = None) -> DataFrame:
    """docs with the ids of each whole text in an array column `out`.

    check: name of a further column that tells whether decoding gives the text back.

    path: the model file on every executor (default: the installed
    piece_bpe_32k.model, whose scores serve as log scores). Null and empty
    texts have no ids. A column that is named like `out` is replaced.
    """
    keep = [c for c in docs.columns if c not in (out, check)]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(out, T.ArrayType(T.IntegerType()))] + ([T.StructField(check, T.BooleanType())] if check else []))

    def run(batches):
        c = codec(path or model_path())
        for batch in batches:
            at = 0
            for block in _blocks(batch.column(keep.index(text))):
                ids = c.encode_all(block)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(flat))
                same = [pa.array([c.decode(x) == t for x, t in zip(ids, block)], pa.bool_())] if check else []
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(block)).columns, lists, *same], names=schema.fieldNames())
                at += len(block)

    return docs.select(*keep).mapInArrow(run, schema)


def decoded(rows: DataFrame, path: str | None = None, ids: str = "token_ids", out: str = "text") -> DataFrame:
    """rows with the text of an array of ids in column `out`; null for null ids."""
    keep = [c for c in rows.columns if c != out]
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField(out, T.StringType())])

    def run(batches):
        c = codec(path or model_path())
        for batch in batches:
            texts = [None if x is None else c.decode(x) for x in batch.column(keep.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*keep, out])

    return rows.select(*keep).mapInArrow(run, schema)


def encoding_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, n_byte_tokens, ids_sha256 (of little-endian 32-bit ids), round_trip.

    round_trip: whether decoding gives the text back. It is false for texts
    that hold the marker U+2581 itself, which decodes to a space.
    """
    schema = "doc_id long, n_bytes long, n_tokens long, n_byte_tokens long, ids_sha256 string, round_trip boolean"

    def run(batches):
        c = codec(path or model_path())
        is_byte = np.zeros(len(c.bytes), bool)
        is_byte[[i for i in c.byte_ids if i is not None]] = True
        for batch in batches:
            at = 0
            for block in _blocks(batch.column(1)):
                ids = c.encode_all(block)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(block)), pa.array([len(t.encode()) for t in block], pa.int64()), pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([int(is_byte[x].sum()) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]), pa.array([c.decode(x) == t for x, t in zip(ids, block)]),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "n_byte_tokens", "ids_sha256", "round_trip"],
                )
                at += len(block)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encoding_digest() of all documents, each row by itself; null and empty texts have no pieces, an empty table no rows."""
    return encoding_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
