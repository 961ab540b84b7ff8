"""Token counts by compiled finite-state transducers.

A byte-level BPE tokenizer is compiled into two deterministic machines.

1. The splitter reads UTF-8 bytes as character classes and marks where the
   tokenizer's pattern starts a piece. It has twelve states, and the effect of
   any chunk of text is one of 25 state maps, so the table of their products is computed once. Chunks of a block are mapped side by side,
   their maps are composed by a parallel prefix scan, and with every chunk's
   true start state known, a second pass marks the pieces.
2. The merger reads the bytes of a piece through a deterministic automaton
   whose node is the longest suffix that begins a token. Each of its moves
   names the tokens that end there, longest first; the last token of a prefix
   is the longest of them that may follow the last token before it, and this
   fixes the encoding. The move then emits the change in the number of tokens
   (less than 0 where tokens merge). Its memory is the last token and the count
   at each byte of the piece. All pieces of a block run side by side, but for
   very long ones: what a chunk of a piece does depends on the tokens before
   it in too many ways for a table of maps, so a piece is read from its start.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that a block of texts holds, if one text isn't larger.
BLOCK_BYTES = 2 << 20
#: Bytes of a chunk of a block.
CHUNK = 64
#: Bytes from which a piece is read on its own, without a step of all pieces for each of its bytes.
LONG_PIECE = 256
#: Pairs of tokens whose answer is kept; later ones take the place of earlier ones.
PAIRS = 1 << 20

OTHER, LETTER, NUMBER, SPACE, BLANK, QUOTE, STMD, R, V, L, E = range(11)
CONT = 22  # a byte within a character; classes 11 to 21 are 0 to 10 at the start of a text
(START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AT_QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, ONE_SPACE, ONE_BLANK, RUN_SPACE, RUN_BLANK) = range(12)
STATES = 12
HERE, BEFORE = 1, 2  # marks: a piece starts at this character, at the one before
#: White space as Unicode has it (fixed values).
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _opened(c: int) -> int:
    """The state after the first character of a piece."""
    if c in (LETTER, STMD, R, V, L, E):
        return IN_LETTERS
    return {NUMBER: IN_NUMBERS, SPACE: ONE_SPACE, BLANK: ONE_BLANK, QUOTE: AT_QUOTE, OTHER: IN_OTHERS}[c]


def _move(state: int, c: int) -> tuple[int, int]:
    """Next state and marks, for a character of a class."""
    letter, white = _opened(c) == IN_LETTERS, c in (SPACE, BLANK)
    joined = IN_OTHERS if c == QUOTE else _opened(c)  # the piece that a space before it begins
    if state == IN_LETTERS and letter or state == IN_NUMBERS and c == NUMBER or state == IN_OTHERS and c in (OTHER, QUOTE):
        return state, 0
    if state == AT_QUOTE:
        if c == STMD:
            return START, 0
        if c in (R, V, L):
            return {R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}[c], 0
        if c in (OTHER, QUOTE):
            return IN_OTHERS, 0
    if state in (QUOTE_R, QUOTE_V, QUOTE_L):
        if c == (L if state == QUOTE_L else E):
            return START, 0
        after, marks = _move(IN_LETTERS, c)  # the letter was no contraction: a piece began there
        return after, marks | BEFORE
    if state in (ONE_SPACE, ONE_BLANK, RUN_SPACE, RUN_BLANK) and white:
        return RUN_SPACE if c == SPACE else RUN_BLANK, 0
    if state == ONE_SPACE:
        return joined, 0
    if state == RUN_SPACE:
        return joined, BEFORE
    if state == RUN_BLANK:
        return _opened(c), BEFORE | HERE
    return _opened(c), HERE


class Splitter:
    def __init__(self):
        self.next = np.zeros((STATES, 23), np.uint8)
        self.marks = np.zeros((STATES, 23), np.uint8)
        for s in range(STATES):
            for c in range(11):
                self.next[s, c], self.marks[s, c] = _move(s, c)
                self.next[s, c + 11], self.marks[s, c + 11] = _opened(c), HERE | self.at_end(s)
            self.next[s, CONT] = s
        maps, rows = {tuple(range(STATES)): 0}, [tuple(range(STATES))]
        gens = [tuple(self.next[:, c].tolist()) for c in range(23)]
        for m in rows:  # grows while it is walked
            for g in gens:
                if (n := tuple(g[s] for s in m)) not in maps:
                    maps[n] = len(rows)
                    rows.append(n)
        self.maps = np.array(rows, np.uint8)
        self.of_class = np.array([maps[g] for g in gens], np.uint16)
        self.product = np.array([[maps[tuple(b[s] for s in a)] for b in rows] for a in rows], np.uint16)
        kinds = np.zeros(0x110000, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                kinds[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
        kinds[WHITE] = BLANK
        kinds[[ord(x) for x in "stmd"]] = STMD
        for x, c in ((" ", SPACE), ("'", QUOTE), ("r", R), ("v", V), ("l", L), ("e", E)):
            kinds[ord(x)] = c
        self.kinds = kinds

    @staticmethod
    def at_end(state: int) -> int:
        return BEFORE if state in (QUOTE_R, QUOTE_V, QUOTE_L) else 0

    def classes(self, b: np.ndarray) -> np.ndarray:
        """Classes of UTF-8 bytes; a character's class stands at its first byte."""
        out = self.kinds[:256][b]
        high = np.flatnonzero(b >= 0x80)
        if len(high):
            out[high] = CONT
            lead = high[b[high] >= 0xC0]
            wide = np.concatenate([b, np.zeros(3, np.uint8)]).astype(np.uint32) if len(lead) * 4 > len(b) else None
            at = (lambda i: wide[i]) if wide is not None else (lambda i: b[np.minimum(i, len(b) - 1)].astype(np.uint32))
            x, y = at(lead), at(lead + 1) & 63
            cp = (x & 31) << 6 | y
            for least, mask, n in ((0xE0, 15, 3), (0xF0, 7, 4)):
                k = np.flatnonzero(x >= least)
                if len(k):
                    v = x[k] & mask
                    for i in range(1, n):
                        v = v << 6 | at(lead[k] + i) & 63
                    cp[k] = v
            out[lead] = self.kinds[np.minimum(cp, 0x10FFFF)]
        return out

    def starts(self, b: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Where pieces start in b; firsts: offsets at which the machine starts anew."""
        n = len(b)
        c = self.classes(b)
        c[firsts] += 11
        rows = -(-n // CHUNK)
        laid = np.full(rows * CHUNK, CONT, np.uint8)
        laid[:n] = c
        laid = np.ascontiguousarray(laid.reshape(rows, CHUNK).T)
        m = self.of_class[laid[0]]
        for k in range(1, CHUNK):
            m = self.product[m, self.of_class[laid[k]]]
        step = 1
        while step < rows:  # prefix scan: after each round m covers twice as many chunks
            m[step:] = self.product[m[:-step], m[step:]]
            step *= 2
        state = np.empty(rows, np.uint8)
        state[0], state[1:] = START, self.maps[m[:-1], START]
        marks = np.empty((CHUNK, rows), np.uint8)
        for k in range(CHUNK):
            marks[k] = self.marks[state, laid[k]]
            state = self.next[state, laid[k]]
        marks = np.ascontiguousarray(marks.T).reshape(-1)[:n]
        here = (marks & HERE).astype(bool)
        back = np.flatnonzero(marks & BEFORE) - 1
        if self.at_end(int(state[-1])):
            back = np.append(back, n - 1)
        for _ in range(3):
            back = np.where((b[back] & 0xC0) == 0x80, back - 1, back)
        here[back] = True
        return np.flatnonzero(here)


class Merger:
    """The transducer of the merges over all pieces of a block at once.

    Tokens are numbered as bytes (0 to 255), then in order of the merge that
    makes them. left and right: the two tokens that a merge joined.
    """

    def __init__(self, texts: list[bytes], left: list[int], right: list[int]):
        n = self.n = len(texts)
        self.left, self.right = np.array(left, np.int32), np.array(right, np.int32)
        keys = self.left[256:].astype(np.int64) * n + self.right[256:]
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_made = np.append(keys[order], 1 << 62), np.append(order + 256, 0).astype(np.int32)
        made = np.arange(256, n, dtype=np.int32)
        # a token whose own text is encoded otherwise is never the last token of anything
        sound = np.concatenate([np.ones(256, bool), self._apart(self.left[256:], self.right[256:], made)])
        self._automaton([(t, i) for i, t in enumerate(texts) if sound[i]])
        self.length = np.array([len(t) for t in texts], np.int32)
        self.pairs: dict[int, bool] = {}
        self.known, self.known_ok = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)

    def _automaton(self, tokens: list[tuple[bytes, int]]) -> None:
        """next: the node of the longest suffix of the input that begins a token; longest: the longest token that ends there."""
        child, own = [{}], [-1]
        for t, i in tokens:
            node = 0
            for x in t:
                to = child[node].get(x)
                if to is None:
                    to = child[node][x] = len(child)
                    child.append({})
                    own.append(-1)
                node = to
            own[node] = i
        self.next = np.zeros((len(child), 256), np.int32)
        self.longest = np.full(len(child), -1, np.int32)
        self.shorter = np.full(self.n, -1, np.int32)
        level = [(0, 0)]
        while level:
            below = []
            for node, fail in level:
                if node:
                    self.next[node] = self.next[fail]
                    self.longest[node] = own[node] if own[node] >= 0 else self.longest[fail]
                    if own[node] >= 0:
                        self.shorter[own[node]] = self.longest[fail]
                for x, to in child[node].items():
                    below.append((to, int(self.next[node, x]) if node else 0))
                    self.next[node, x] = to
            level = below

    def _made(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The token that x and y merge into, or a number above all tokens."""
        key = x.astype(np.int64) * self.n + y
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_made[at], self.n + 1)

    def _apart(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | int) -> np.ndarray:
        """Whether no merge below the limit joins a's end to b's start.

        The merges inside a and b are undone from the last to the first. The
        parts that then face each other must not have a merge that comes before
        the one undone (of one rank, the left merge comes first).
        """
        x, y, ok, live = a.copy(), b.copy(), np.ones(len(a), bool), np.arange(len(a))
        limit = np.broadcast_to(np.asarray(limit, np.int32), len(a)).copy()
        while len(live):
            u, v = x[live], y[live]
            joined = self._made(u, v) < limit[live]
            ok[live[joined]] = False
            live = live[~joined & ((u >= 256) | (v >= 256))]
            u, v = x[live], y[live]
            later = u > v
            p, q = live[later], live[~later]
            limit[p], x[p] = u[later], self.right[u[later]]
            limit[q], y[q] = v[~later] + 1, self.left[v[~later]]
        return ok

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the text of tokens a, b is encoded as a, b; a of -1: b is the first."""
        key = (a.astype(np.int64) + 1) * self.n + b
        slot = (key * 0x9E3779B1 >> 13) & (PAIRS - 1)
        ok = self.known_ok[slot]
        new = np.flatnonzero(self.known[slot] != key)
        if len(new):
            p, q = a[new], b[new]
            good = p < 0
            rest = np.flatnonzero(~good)
            good[rest] = self._apart(p[rest], q[rest], self.n)
            ok[new] = good
            self.known[slot[new]], self.known_ok[slot[new]] = key[new], good
            # of two new pairs in one slot the last is kept with its own answer
            self.known_ok[slot[new]] = np.where(self.known[slot[new]] == key[new], good, self.known_ok[slot[new]])
        return ok

    def count_long(self, piece: np.ndarray) -> int:
        """Tokens of one long piece: the same moves, a byte at a time. Its memory is the last token and the count at each byte."""
        move, longest, shorter, length = (memoryview(x) for x in (self.next.reshape(-1), self.longest, self.shorter, self.length))
        last, count, known, n, node = array("i", [-1]), array("i", [0]), self.pairs, self.n, 0  # at k + 1: after byte k
        for k, x in enumerate(piece.tobytes()):
            node = move[node << 8 | x]
            token = longest[node]
            while True:
                before = k + 1 - length[token]
                prior = last[before]
                key = (prior + 1) * n + token
                ok = known.get(key)
                if ok is None:
                    if len(known) >= PAIRS:
                        known.clear()
                    ok = known[key] = bool(self.may_follow(np.array([prior], np.int32), np.array([token], np.int32))[0])
                if ok:
                    break
                token = shorter[token]
            last.append(token)
            count.append(count[before] + 1)
        return count[-1]

    def counts(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each piece b[start:end]."""
        size = ends - starts
        if len(size) and size.max() > LONG_PIECE:
            out, far = np.empty(len(size), np.int64), size > LONG_PIECE
            out[far] = [self.count_long(b[x:y]) for x, y in zip(starts[far].tolist(), ends[far].tolist())]
            out[~far] = self.counts(b, starts[~far], ends[~far])
            return out
        order = np.argsort(-size, kind="stable")
        first, size = starts[order], size[order]
        # how many pieces are longer than k bytes
        more = len(size) - np.cumsum(np.bincount(size)) if len(size) else np.zeros(0, np.int64)
        last, count = np.empty(len(b), np.int32), np.empty(len(b), np.int32)
        node, flat = np.zeros(len(first), np.int64), self.next.reshape(-1)
        for k, n in enumerate(more.tolist()):
            if not n:
                break
            at = first[:n] + k
            node[:n] = here = flat[node[:n] << 8 | b[at]]
            token, live = self.longest[here], None
            while True:
                length = self.length[token]
                before = at - length
                inside = length <= k
                prior = np.where(inside, last[np.where(inside, before, 0)], -1)
                ok = self.may_follow(prior, token)
                n_tokens = np.where(inside, count[np.where(inside, before, 0)], 0) + 1
                if live is None and ok.all():
                    last[at], count[at] = token, n_tokens
                    break
                last[at[ok]], count[at[ok]] = token[ok], n_tokens[ok]
                if ok.all():
                    break
                live = ~ok
                at, token = at[live], self.shorter[token[live]]
        out = np.empty(len(first), np.int64)
        out[order] = count[ends[order] - 1]
        return out


class Transducer:
    """A byte-level BPE tokenizer of the `tokenizers` library's .json form, compiled to count."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("only byte-level BPE without a normalizer is compiled")
        # bytes that are printable characters stand for themselves, the others follow from 256 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letter = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
        to_bytes = lambda t: bytes(letter[x] for x in t)
        special = {t["content"] for t in spec["added_tokens"]}
        number = {bytes([x]): x for x in range(256)}
        left, right = list(range(256)), list(range(256))
        for m in spec["model"]["merges"]:
            a, b = map(to_bytes, m if isinstance(m, list) else m.split(" "))
            if a + b in number:
                raise ValueError("two merges make one token")
            number[a + b] = len(left)
            left.append(number[a])
            right.append(number[b])
        self.special = [t.encode() for t in special]
        self.split, self.merge = Splitter(), Merger(list(number), left, right)

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of the texts data[offsets[i]:offsets[i + 1]]."""
        out, i, n = np.zeros(len(offsets) - 1, np.int64), 0, len(offsets) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, side="right")) - 1)
            out[i:j] = self._block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            i = j
        return out

    def _block(self, b: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not len(b):
            return np.zeros(len(offsets) - 1, np.int64)
        firsts = offsets[:-1][np.diff(offsets) > 0]
        whole = self._special(b, firsts)
        cuts = np.unique(np.concatenate([firsts, whole[:, 0], whole[:, 1][whole[:, 1] < len(b)]])) if len(whole) else firsts
        starts = self.split.starts(b, cuts)
        for lo, hi in whole:  # a special token's text is one piece, and one token
            starts = starts[(starts <= lo) | (starts >= hi)]
        ends = np.append(starts[1:], len(b))
        counts = np.ones(len(starts), np.int32)
        run = ~np.isin(starts, whole[:, 0]) if len(whole) else np.ones(len(starts), bool)
        counts[run] = self.merge.counts(b, starts[run], ends[run])
        total = np.concatenate([[0], np.cumsum(counts)])
        return np.diff(total[np.searchsorted(starts, offsets)])

    def _special(self, b: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Start and end of each special token's text; one that runs over from text to text is none."""
        raw, found = b.tobytes(), []
        for t in self.special:
            at = raw.find(t)
            while at >= 0:
                if not ((firsts > at) & (firsts < at + len(t))).any():
                    found.append((at, at + len(t)))
                    at = raw.find(t, at + len(t))
                else:
                    at = raw.find(t, at + 1)
        return np.array(sorted(found), np.int64).reshape(-1, 2)


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their offsets; null: empty."""
    a = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    a = a.fill_null(b"") if a.null_count else a
    at = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def with_token_counts(docs: DataFrame, path: str | None = None, text: str = "text", out: str = "n_tokens", drop_text: bool = False) -> DataFrame:
    """docs with the number of tokens of each whole text in column `out`.

    path: the tokenizer's .json on every executor (default: the installed
    byte_bpe_50k.json). Null and empty texts have 0 tokens. Special tokens'
    strings in a text count as one token each, as by the library's default. A
    column that is named like `out` is replaced; all others stay. Texts of any
    length are read whole. There is no shuffle.
    """
    keep = [c for c in docs.columns if c != out and not (drop_text and c == text)]
    docs = docs.select(*[c for c in docs.columns if c in keep], F.col(text).alias("\0text"))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(out, T.LongType())])

    def run(batches):
        machine = transducer(path or tokenizer_path())
        for batch in batches:
            data, offsets = text_buffer(batch.column(len(keep)))
            n = pa.array(machine.count(data, offsets), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], n], names=[*keep, out])

    return docs.mapInArrow(run, schema)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """with_token_counts() of all documents, each row by itself, also repeated ones and those without a doc_id; null and empty texts have 0 tokens, an empty table no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return with_token_counts(docs, drop_text=True).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
