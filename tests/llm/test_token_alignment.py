import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lodestrand.llm import token_alignment as ta

from ..conftest import SMALL

NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def brute(libraries, texts):
    """The figures of each text, token by token and byte by byte."""
    a, b = libraries
    letter, docs, counts = ta._byte_of(), [], Counter()
    for text in texts:
        pieces = []
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids
            left = [(i, bytes(letter[c] for c in a.id_to_token(i))) for i in ids]
            right = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
            if b"".join(x for _, x in left) == b"".join(x for _, x in right) == (" " + text).encode():
                pieces = [left, right]
        if not pieces:
            docs.append(None)
            continue
        spans = []
        for side in pieces:
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        both = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, lo = [], 0
        for hi in both:
            groups.append("|".join(",".join(str(i) for i, s, e in side if lo <= s and e <= hi) for side in spans) if len(text) < 400 else "")
            lo = hi
        links, k = [], 0
        for i, s, e in spans[0]:
            while k and spans[1][k - 1][2] > s:
                k -= 1
            while k < len(spans[1]) and spans[1][k][1] < e:
                if spans[1][k][2] > s:
                    links.append((i, spans[1][k][0]))
                k += 1
        counts.update(links)
        docs.append((len(spans[0]), len(spans[1]), len(both), links, ";".join(groups)))
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(most.get(j, 0), n)
    rows = []
    for text, d in zip(texts, docs):
        if d is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
        else:
            digest = hashlib.sha256(d[4].encode()).hexdigest() if len(text) < 400 else None
            rows.append((*d[:3], len(d[3]), sum(counts[x] == most[x[1]] for x in d[3]), sum(counts[x] for x in d[3]), digest))
    return rows


def check(spark, libraries, texts):
    df = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, block int").repartition(3)
    got = {r.doc_id: tuple(r[n] for n in NAMES) for r in ta.alignment_digest(df).collect()}
    for k, want in enumerate(brute(libraries, texts)):
        assert (got[k] if want[-1] is not None else (*got[k][:-1], None)) == want, repr(texts[k][:80] if texts[k] else texts[k])
    assert len(got) == len(texts)


EDGE = ["", None, " ", "  ", "\n", "a", "a ", " a", "a\n", "a \n b", "a\n\n  b\t", "x▁y", "fine x▁y fine", "▁", "<|endoftext|> and </s> <s> <0x41>", "don't  we'll", "é中文字 日本　語", " x y", "a\rb;\r\n)\r x", "😀 \U0001f9ff‍", "\x00\x1c a\x1c b", "same words here", "same words here", "ﬁ Å Ａ x²"]


def test_edge_cases(spark, libraries):
    check(spark, libraries, EDGE)


def test_random_texts(spark, libraries):
    rnd = random.Random(3)
    alphabet = [" ", " ", "\n", "\t", "\r", "a", "b", "the", "ing", ";", ")", "'s", "1", "é", "中", "😀", "  ", " ", ".", "▁" if rnd.random() < 0 else "_", "<s>"]
    check(spark, libraries, ["".join(rnd.choices(alphabet, k=rnd.randrange(60))) for _ in range(300)])


def test_table(spark, libraries):
    check(spark, libraries, pq.read_table(f"{SMALL}/documents.parquet")["text"].to_pylist())


def test_small_blocks_and_parts(spark, libraries, monkeypatch):
    """The same figures whatever a block holds and however texts are cut."""
    rnd = random.Random(4)
    texts = [" ".join(rnd.choices(["mole", "digs", "tunnels", "under\n", "\tthe", "wall.", "x" * 30, "\n"], k=rnd.randrange(1, 200))) for _ in range(60)] + ["x▁y " + "word " * 500, "word " * 500 + "x▁y", "y" * 5000]
    al = ta.aligner(*ta._paths(None, None))
    figures = []
    for chunk, size in ((1 << 18, 1 << 20), (50, 100), (300, 5)):
        monkeypatch.setattr(ta, "CHUNK_CHARS", chunk)
        monkeypatch.setattr(ta, "BLOCK_SIZE", size)
        blocks, out = [ta.Block(ta.Units(al))], []
        for t in ta._batches(iter(texts)):
            blocks[-1].add([0] * len(t), t)
            if blocks[-1].full():
                blocks.append(ta.Block(blocks[-1].units))
        for b in blocks:
            out += b.figures
        pairs = Counter()
        for b in blocks:
            r = b.packed(0) if b.ids else None
            pairs.update(dict(zip(r.column("pairs")[0].as_py(), r.column("counts")[0].as_py())) if r else {})
        figures.append((out, pairs))
    assert figures[0] == figures[1] == figures[2]
    assert [f[:4] for f in figures[0][0]] == [r[:4] for r in brute(libraries, texts)]


def test_fast_ids_are_the_librarys(libraries):
    """Characters of all planes are split alike by both libraries."""
    fast = ta.aligner(*ta._paths(None, None)).A
    for lo in range(0, 0x110000, 4096):
        text = "".join(f" a{chr(c)}b1{chr(c)}{chr(c)}2 {chr(c)}!  {chr(c)}\n" for c in range(lo, lo + 4096, 7) if not 0xD800 <= c < 0xE000)
        assert fast.encode(text).tolist() == libraries[0].encode(text, add_special_tokens=False).ids


def test_groups_and_counts(spark):
    rows = spark.createDataFrame([(1, "tokenizers tokenise"), (2, None), (3, "x▁y"), (4, "tokenise\nagain")], "doc_id long, text string")
    groups = ta.token_groups(rows).orderBy("doc_id", "seq").collect()
    al = ta.aligner(*ta._paths(None, None))
    assert {r.doc_id for r in groups} == {1, 4}
    for r in groups:
        text = " tokenizers tokenise" if r.doc_id == 1 else " tokenise\nagain"
        assert b"".join(al.A.bytes[i] for i in r.a_ids) == b"".join(al.B.bytes[i] for i in r.b_ids) == text.encode()[r.start : r.end]
    digest = {r.doc_id: r for r in ta.alignment_digest(rows).collect()}
    for k in (1, 4):
        own = [r for r in groups if r.doc_id == k]
        said = ";".join(",".join(map(str, r.a_ids)) + "|" + ",".join(map(str, r.b_ids)) for r in own)
        assert (len(own), hashlib.sha256(said.encode()).hexdigest()) == (digest[k].n_groups, digest[k].groups_sha256)
    counts = ta.pair_counts(rows).collect()
    assert sum(r.n_links for r in counts) == sum(r.n_links for r in digest.values())
    assert all(r.best == (r.n_links == max(x.n_links for x in counts if x.b_id == r.b_id)) for r in counts)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, rows string, links int")
    assert ta.alignment_digest(empty).count() == 0 and ta.pair_counts(empty).count() == 0 and ta.token_groups(empty).count() == 0
    rows = ta.alignment_digest(spark.createDataFrame([(None, "same text"), (None, "same text"), (5, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.n_a, r.n_links) for r in rows) == [(False, 0, 0), (True, 2, 2), (True, 2, 2)]


def test_long_texts_in_parts(spark):
    """A text of 8 MB has the figures of its line, times its lines."""
    line = "the mole digs a long tunnel under the wall\n"
    n = 8_000_000 // len(line)
    one = ta.alignment_digest(spark.createDataFrame([(1, line)], "doc_id long, text string")).first()
    many = ta.alignment_digest(spark.createDataFrame([(1, line * n)], "doc_id long, text string")).first()
    assert many.n_links == many.n_a + many.n_b - many.n_groups
    assert (many.n_a - one.n_a) % (n - 1) == 0 and re.fullmatch("[0-9a-f]{64}", many.groups_sha256)
