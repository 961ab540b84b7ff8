"""Alignment of two tokenizers' tokens by a label for each byte.

Tokenizer A is a byte-level BPE of the `tokenizers` library over space + text,
tokenizer B a `sentencepiece` model over the text, to which it adds the space
itself; both cover the same bytes. Each byte gets a label: no token ends there,
one of A does, one of B, or both. A regular expression reads the labels up to
each place where both end; the labels of such a span count the tokens of a
group. Inside a group each place where a token ends closes one link, a pair of
tokens that overlap.

Texts are read in units: neither tokenizer joins bytes over the white space
that follows another character, so a word with the space before it has the same
tokens and groups everywhere, and is aligned once for all its places.

How often two ids are linked is counted over the whole corpus. Documents go
through in blocks: a block asks once for each pair of ids in it, however many
documents have it, and gets the pair's count from a table of all pairs.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, load, removed, staged

#: Characters of texts that are read together; longer texts are read in parts.
CHUNK_CHARS = 1 << 18
#: Entries (document, unit) of a block, and links of its units.
BLOCK_SIZE = 1 << 20
#: Longer spans of labels are counted each time.
SPAN = 48
#: The split of byte-level BPE before merging (fixed value of the file format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Units begin at a space or line end that follows what is neither white space nor B's marker.
UNIT = re.compile(r"[\s▁]*[^\s▁]+(?:(?![ \n])[\s▁]+[^\s▁]*)*|[\s▁]+")
#: A place where a part of a long text can begin.
CUT = re.compile(r"(?<=[^\s▁])[ \n]")


def _byte_of() -> dict[str, int]:
    """Byte-level alphabets: printable characters stand for themselves, other bytes for those from 256 on (fixed values of the file format)."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}


class ByteTokens:
    """Tokenizer A: ids by the `tokenizers` library, and the bytes of each id.

    Where the file's ids follow its merges, `tiktoken` gives the same ids some
    times faster and is used for chunks of ordinary length.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.encode_special_tokens = True  # their strings are plain text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter, vocab = _byte_of(), spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(letter[c] for c in token) if all(c in letter for c in token) else token.encode()
        for token, i in special.items():
            self.bytes[i] = token.encode()
        self.fast = None
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        pre = spec["pre_tokenizer"]
        if merged == list(range(256, 256 + len(merged))) and pre["type"] == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"] and not spec["normalizer"]:
            import tiktoken

            self.fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks={self.bytes[i]: i for i in range(256 + len(merged))}, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None and len(text) <= 4 * CHUNK_CHARS:
            return np.asarray(self.fast.encode_ordinary(text), np.int64)
        return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, np.int64)


class PieceTokens:
    """Tokenizer B: ids by the `sentencepiece` library, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n, mark = self.model.get_piece_size(), "▁"
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(mark, " ").encode() for i, p in enumerate(pieces)]
        # no merge runs over from another character to a marker, and line ends are in no piece: texts can be cut there
        joined = [p for i, p in enumerate(pieces) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        whole = "a  b \n\n c "
        self.cuts = not any("\n" in p or mark in p.lstrip(mark) for p in joined) and b"".join(self.bytes[i] for i in self.model.encode(whole)) == b" " + whole.encode()
        self.mark = self.model.piece_to_id(mark)

    def encode(self, text: str) -> np.ndarray:
        return np.asarray(self.model.encode(text), np.int64)


@dataclass
class Aligned:
    """Tokens of texts whose bytes agree, text by text: ids, and per group how many there are of each."""

    a: np.ndarray
    b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    #: Tokens and groups before each text, and in all
    at_a: np.ndarray
    at_b: np.ndarray
    at_group: np.ndarray
    #: Ids of each link, and links before each text
    link_a: np.ndarray
    link_b: np.ndarray
    at_link: np.ndarray


class _SpanCounts(dict):
    """Tokens of A and B that end in a span of labels, as one number."""

    def __missing__(self, span: bytes) -> int:
        n = (span.count(b"a") + 1) << 32 | (span.count(b"b") + 1)
        if len(span) <= SPAN:
            if len(self) > 1 << 18:
                self.clear()
            self[span] = n
        return n


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.A, self.B = ByteTokens(path_a), PieceTokens(path_b)
        self.n_a, self.n_b = len(self.A.bytes), len(self.B.bytes)
        self.len_a, self.len_b = (np.array([len(x) for x in t.bytes], np.int64) for t in (self.A, self.B))
        self.digits = []
        for n in (self.n_a, self.n_b):
            width = len(str(n - 1))
            self.digits.append(np.frombuffer("".join(str(i).rjust(width, "\0") for i in range(n)).encode(), np.uint8).reshape(n, width))
        self.counts, self.span = _SpanCounts(), re.compile(b"[^c]*c")

    def units(self, text: str, first: bool = True) -> list[str]:
        """The units of space + text (of the text alone, if it is a later part)."""
        text = " " + text if first else text
        return UNIT.findall(text) if self.B.cuts else [text]

    def parts(self, text: str) -> Iterator[str]:
        """A text in parts of about CHUNK_CHARS, cut between units."""
        at = 0
        while self.B.cuts and len(text) - at > CHUNK_CHARS and (m := CUT.search(text, at + CHUNK_CHARS)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def tokens(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids by A and B, where each unit's begin, and whether both cover just its bytes (a unit where not has none).

        Units that can stand in one text are encoded as one: tokens end where units do.
        """
        plain = [k for k, u in enumerate(units) if self.B.cuts and u[0] in " \n" and u[-1] != "▁" and not u[-1].isspace()]
        good, ids = np.ones(len(units), bool), []
        if (one := self._encode("".join([units[k] for k in plain]))) if plain else None:
            ends = np.cumsum([len(units[k].encode()) for k in plain])
            bounds = [np.searchsorted(np.cumsum(size[x]), ends, side="right") for x, size in zip(one, (self.len_a, self.len_b))]
        else:
            plain, one, bounds = [], (np.zeros(0, np.int64),) * 2, [np.zeros(0, np.int64)] * 2
        rest = sorted(set(range(len(units))) - set(plain))
        each = [self._encode(units[k]) for k in rest]
        good[[k for k, x in zip(rest, each) if x is None]] = False
        order = np.argsort(np.concatenate([plain, rest]).astype(np.int64))
        for t in (0, 1):
            more = [x[t] if x else np.zeros(0, np.int64) for x in each]
            n = np.concatenate([np.diff(bounds[t], prepend=0), np.array([len(x) for x in more], np.int64)])
            flat, at = np.concatenate([one[t], *more]), np.cumsum(n) - n
            to = np.concatenate([[0], np.cumsum(n[order])])
            if rest:
                flat = flat[np.repeat(at[order] - to[:-1], n[order]) + np.arange(to[-1])]
            ids += [flat, to]
        return *ids, good

    def _encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a text by A and B, or None if they don't cover just its bytes."""
        a = self.A.encode(text)
        if text == " ":
            b = np.array([self.B.mark], np.int64)
        else:
            # B puts a space before what it reads: it stands for the text's own one, or is taken away again
            b = self.B.encode(text[1:] if text[0] == " " else text)
            b = b[1:] if text[0] != " " and len(b) and b[0] == self.B.mark else b
        want = text.encode()
        same = b"".join(map(self.A.bytes.__getitem__, a.tolist())) == want and b"".join(map(self.B.bytes.__getitem__, b.tolist())) == want
        return (a, b) if same else None

    def align(self, a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray) -> Aligned:
        """Groups and links of units by their tokens, which cover the same bytes."""
        end_a, end_b = np.cumsum(self.len_a[a]) - 1, np.cumsum(self.len_b[b]) - 1
        label = np.zeros(end_a[-1] + 1 if len(a) else 0, np.uint8)
        label[end_a] = 1
        label[end_b] |= 2
        spans = self.span.findall(np.frombuffer(b".abc", np.uint8)[label].tobytes())
        both = np.fromiter(map(self.counts.__getitem__, spans), np.int64, len(spans))
        group_a, group_b = both >> 32, both & 0xFFFFFFFF
        at_group = np.searchsorted(np.cumsum(group_a), at_a, side="right")
        last = label[label > 0]
        in_a, in_b = last & 1, last >> 1
        link_a, link_b = a[np.cumsum(in_a, dtype=np.int64) - in_a], b[np.cumsum(in_b, dtype=np.int64) - in_b]
        return Aligned(a, b, group_a, group_b, at_a, at_b, at_group, link_a, link_b, at_a + at_b - at_group)

    def written(self, x: Aligned) -> tuple[bytes, np.ndarray]:
        """The groups as text, `a1,a2|b1;` and so on, and where each text's begin and end."""
        (da, db), na, nb = self.digits, len(x.a), len(x.b)
        to_a, to_b, groups = np.cumsum(x.group_a), np.cumsum(x.group_b), np.arange(len(x.group_a))
        at = np.arange(na) + np.repeat(to_b - x.group_b, x.group_a), np.arange(nb) + np.repeat(to_a, x.group_b)
        cells = np.zeros((na + nb, max(da.shape[1], db.shape[1]) + 1), np.uint8)
        cells[at[0], : da.shape[1]] = da[x.a]
        cells[at[1], : db.shape[1]] = db[x.b]
        cells[:, -1] = ord(",")
        cells[at[0][to_a[groups] - 1], -1] = ord("|")
        cells[at[1][to_b[groups] - 1], -1] = ord(";")
        full = cells != 0
        ends = np.concatenate([[0], np.cumsum(full.sum(axis=1))])
        return cells[full].tobytes(), ends[x.at_a + x.at_b]


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _paths(path_a: str | None, path_b: str | None) -> tuple[str, str]:
    if path_a and path_b:
        return path_a, path_b
    import public_tokenizers

    return path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")


def _batches(texts: Iterator[str | None]) -> Iterator[list[str | None]]:
    """Texts that are encoded together; one of more than CHUNK_CHARS comes alone."""
    held, size = [], 0
    for t in texts:
        n = len(t or "")
        if held and size + n > CHUNK_CHARS:
            yield held
            held, size = [], 0
        held.append(t)
        size += n
    if held:
        yield held


class Units:
    """Units seen so far with their figures, groups as text, and links as numbers a * n_b + b."""

    def __init__(self, al: Aligner):
        self.al, self.number, self.bytes = al, {}, 0
        self.good, self.groups = array("b"), []
        self.n_a, self.n_b, self.n_groups, self.links, self.at = array("q"), array("q"), array("q"), array("q"), array("q", [0])

    def read(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the units of all texts, and where each text's begin."""
        flat = [u for units in texts for u in units]
        if new := [u for u in dict.fromkeys(flat) if u not in self.number]:
            self._add(new)
        return np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat)), np.cumsum([0, *map(len, texts)])

    def _add(self, new: list[str]) -> None:
        *ids, good = self.al.tokens(new)
        x = self.al.align(*ids)
        text, at = self.al.written(x)
        for column, bounds in ((self.n_a, x.at_a), (self.n_b, x.at_b), (self.n_groups, x.at_group)):
            column.frombytes(np.diff(bounds).tobytes())
        self.at.frombytes((len(self.links) + x.at_link[1:]).tobytes())
        self.links.frombytes((x.link_a * self.al.n_b + x.link_b).tobytes())
        self.good.frombytes(good.astype(np.int8).tobytes())
        at = at.tolist()
        self.groups += [text[lo:hi] for lo, hi in zip(at, at[1:])]
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        self.bytes += sum(map(len, new)) + len(text)

    def of(self, column: array, units: np.ndarray) -> np.ndarray:
        return np.frombuffer(column, np.int8 if column.typecode == "b" else np.int64)[units].astype(np.int64)


class Block:
    """Documents, their figures, and how often each has each unit."""

    def __init__(self, units: Units):
        self.units, self.ids, self.figures, self.keys, self.counts, self.size = units, [], [], [], [], 0

    def add(self, ids: list, texts: list[str | None]) -> None:
        """Texts of a chunk together, or one long text."""
        al, first = self.units.al, len(self.ids)
        self.ids += ids
        if len(texts) == 1 and len(texts[0] or "") > CHUNK_CHARS:
            self.figures.append(self._long(texts[0], first))
            return
        u, at = self.units.read([al.units(t) if t else [] for t in texts])
        good = np.diff(np.concatenate([[0], np.cumsum(self.units.of(self.units.good, u))])[at]) == np.diff(at)
        good &= np.diff(at) > 0
        totals = [np.diff(np.concatenate([[0], np.cumsum(self.units.of(c, u))])[at]) for c in (self.units.n_a, self.units.n_b, self.units.n_groups)]
        groups, own = self.units.groups, u.tolist()
        for k, ok in enumerate(good.tolist()):
            n_a, n_b, n_groups = (int(t[k]) for t in totals)
            self.figures.append((n_a, n_b, n_groups, n_a + n_b - n_groups, hashlib.sha256(b"".join([groups[i] for i in own[at[k] : at[k + 1]]])[:-1]).hexdigest()) if ok else NONE)
        doc = np.repeat(np.arange(first, first + len(texts)), np.diff(at))
        self._tally(doc[good[doc - first]], u[good[doc - first]])

    def _tally(self, doc: np.ndarray | int, units: np.ndarray) -> None:
        k, n = np.unique((doc << 32) | units, return_counts=True)
        self.keys.append(k)
        self.counts.append(n)
        self.size += len(k)

    def _long(self, text: str, doc: int) -> tuple:
        n, digest, rest, before = np.zeros(3, np.int64), hashlib.sha256(), b"", (len(self.keys), self.size)
        for k, part in enumerate(self.units.al.parts(text)):
            u, _ = self.units.read([self.units.al.units(part, not k)])
            if not self.units.of(self.units.good, u).all():
                del self.keys[before[0] :], self.counts[before[0] :]
                self.size = before[1]
                return NONE
            n += [int(self.units.of(c, u).sum()) for c in (self.units.n_a, self.units.n_b, self.units.n_groups)]
            groups = rest + b"".join([self.units.groups[i] for i in u.tolist()])
            digest.update(groups[:-1])
            rest = groups[-1:]
            self._tally(doc, u)
            if self.size - before[1] > 4 * BLOCK_SIZE:
                self._merge(before[0])
        return *n.tolist(), int(n[0] + n[1] - n[2]), digest.hexdigest()

    def _merge(self, first: int = 0) -> None:
        """Puts equal keys together."""
        if len(self.keys) - first > 1:
            k, inverse = np.unique(np.concatenate(self.keys[first:]), return_inverse=True)
            n = np.bincount(inverse, np.concatenate(self.counts[first:])).astype(np.int64)
            self.size += len(k) - sum(map(len, self.keys[first:]))
            self.keys[first:], self.counts[first:] = [k], [n]

    def full(self) -> bool:
        return self.size >= BLOCK_SIZE or len(self.units.links) >= 2 * BLOCK_SIZE or self.units.bytes >= 32 * BLOCK_SIZE

    def packed(self, block: int) -> pa.RecordBatch:
        rows = pa.table([pa.array(self.ids, pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*self.figures), [pa.int64()] * 4 + [pa.string()]))], names=["doc_id", *FIGURES, "groups_sha256"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(rows)
        self._merge()
        keys, counts = (x[0] if x else np.zeros(0, np.int64) for x in (self.keys, self.counts))
        doc, (own, number) = keys >> 32, np.unique(keys & 0xFFFFFFFF, return_inverse=True)
        # the units' links one unit after the other, and each as the number of its pair
        at = np.frombuffer(self.units.at, np.int64)
        per = at[own + 1] - at[own]
        links = np.frombuffer(self.units.links, np.int64)[np.repeat(at[own] - np.concatenate([[0], np.cumsum(per)[:-1]]), per) + np.arange(per.sum())] if len(own) else np.zeros(0, np.int64)
        pairs, of = np.unique(links, return_inverse=True)
        times = np.bincount(number, counts, len(own))
        total = np.bincount(of, np.repeat(times, per), len(pairs)).astype(np.int64)
        sizes = [np.bincount(doc, minlength=len(self.ids)), number, counts, per, of]
        held = np.concatenate([[len(x) for x in sizes], *sizes]).astype("<u4")
        # byte by byte: the upper ones are mostly zeros
        data = zstandard.ZstdCompressor(level=1).compress(held.view(np.uint8).reshape(-1, 4).T.tobytes())
        lists = [pa.array([x], pa.list_(pa.int64())) for x in (pairs, total)]
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([data], pa.binary()), *lists], names=["block", "rows", "links", "pairs", "counts"])


NONE = (0, 0, 0, 0, "")
FIGURES = ["n_a", "n_b", "n_groups", "n_links"]
BLOCK_SCHEMA = "block long, rows binary, links binary, pairs array<long>, counts array<long>"


def _blocks(docs: DataFrame, path_a: str | None, path_b: str | None) -> DataFrame:
    """Documents in blocks: their figures, their links by number of the pair within the block, and the block's pairs with counts."""

    def run(batches):
        from pyspark import TaskContext

        al, number = aligner(*_paths(path_a, path_b)), TaskContext.get().partitionId() << 32
        block = Block(Units(al))
        for batch in batches:
            at, doc_ids = 0, batch.column(0).to_pylist()
            for texts in _batches(x.as_py() for x in batch.column(1)):
                block.add(doc_ids[at : at + len(texts)], texts)
                at += len(texts)
                if block.full():
                    yield block.packed(number)
                    block, number = Block(block.units if block.units.bytes < 16 * BLOCK_SIZE and len(block.units.links) < BLOCK_SIZE else Units(al)), number + 1
        if block.ids:
            yield block.packed(number)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, BLOCK_SCHEMA)


def _counted(blocks: DataFrame, n_b: int) -> tuple[DataFrame, DataFrame]:
    """(pair, n, blocks, best) of all pairs of ids: links, blocks that have it, and whether no pair of its B id has more. Also the staged table that it reads."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("x.pairs", "x.counts")
    counted = staged(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("n"), F.count(F.lit(1)).alias("blocks")), "pair-counts")
    # one row for each id of B's vocabulary at most
    most = F.broadcast(counted.groupBy((F.col("pair") % n_b).alias("b")).agg(F.max("n").alias("most")))
    return counted.join(most, F.col("pair") % n_b == F.col("b")).select("pair", "n", "blocks", (F.col("n") == F.col("most")).alias("best")), counted


def pair_counts(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(a_id, b_id, n_links, best) of all pairs of ids that are linked anywhere in docs."""
    n_b = aligner(*_paths(path_a, path_b)).n_b
    blocks = staged(_blocks(docs, path_a, path_b).select("pairs", "counts"), "alignment")
    counted, _ = _counted(blocks, n_b)
    removed(blocks)
    return counted.select(F.floor(F.col("pair") / n_b).cast("int").alias("a_id"), (F.col("pair") % n_b).cast("int").alias("b_id"), F.col("n").alias("n_links"), "best")


def token_groups(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(doc_id, seq, start, end, a_ids, b_ids): each document's token groups with their bytes of space + text."""
    schema = "doc_id long, seq long, start long, end long, a_ids array<int>, b_ids array<int>"

    def run(batches):
        al = aligner(*_paths(path_a, path_b))
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                parts = [al.tokens(al.units(p, not k)) for k, p in enumerate(al.parts(text.as_py()))] if text.as_py() else []
                done, seq = 0, 0
                if not all(good.all() for *_, good in parts):
                    continue
                for *ids, _ in parts:
                    x = al.align(*ids)
                    to_a, to_b = (np.concatenate([[0], np.cumsum(g)]) for g in (x.group_a, x.group_b))
                    ends, n = done + np.cumsum(al.len_a[x.a])[to_a[1:] - 1], len(x.group_a)
                    lists = [pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(v, pa.int32())) for to, v in ((to_a, x.a), (to_b, x.b))]
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id] * n, pa.int64()), pa.array(np.arange(seq, seq + n)), pa.array(np.concatenate([[done], ends[:-1]])), pa.array(ends), *lists], names=["doc_id", "seq", "start", "end", "a_ids", "b_ids"])
                    done, seq = int(ends[-1]), seq + n

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def alignment_digest(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of docs.

    Null and empty texts, and those whose tokens' bytes by A or B are not just
    space + text (a text that holds U+2581, which B reads as a space), have
    zeros and an empty digest. Rows that repeat, also those without a doc_id,
    count each by itself. Special tokens' strings are plain text. Other columns
    are ignored; an empty table gives no rows. Long texts are read in parts; a
    run of text without white space is one unit and held with all its tokens.
    """
    n_b = aligner(*_paths(path_a, path_b)).n_b
    blocks = staged(_blocks(docs, path_a, path_b), "alignment")
    counted, table = _counted(blocks, n_b)
    asked = blocks.select("block", F.posexplode("pairs").alias("number", "pair"))
    answers = join_counted(asked, counted, ["pair"], "blocks").select("block", "number", "n", "best")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def put(block, answered):
        rows = pa.ipc.open_stream(block.column("rows")[0].as_buffer()).read_all()
        held = np.frombuffer(zstandard.ZstdDecompressor().decompress(block.column("links")[0].as_py()), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)
        per_doc, unit, times, per_unit, of = np.split(held[5:], np.cumsum(held[:4]))
        sums, number = [], answered.column("number").to_numpy()
        for name in ("best", "n"):
            value = np.zeros(answered.num_rows, np.int64)
            value[number] = answered.column(name).to_numpy(zero_copy_only=False)
            of_unit = np.diff(np.concatenate([[0], np.cumsum(value[of])])[np.concatenate([[0], np.cumsum(per_unit)])])
            sums.append(np.diff(np.concatenate([[0], np.cumsum(times * of_unit[unit])])[np.concatenate([[0], np.cumsum(per_doc)])]))
        return pa.table([rows.column("doc_id"), *(rows.column(c) for c in FIGURES), pa.array(sums[0]), pa.array(sums[1]), rows.column("groups_sha256")], names=["doc_id", *FIGURES, "n_best", "count_sum", "groups_sha256"])

    own = blocks.select(F.col("block").alias("of_block"), "rows", "links").groupBy("of_block")
    out = staged(own.cogroup(answers.groupBy("block")).applyInArrow(put, schema), "aligned")
    removed(blocks, table)
    return out


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """alignment_digest() of all documents; null, empty and unequal texts have zeros, each row counts by itself, an empty table gives no rows."""
    return alignment_digest(load(spark, sf_dir, "documents").select("doc_id", "text"))
