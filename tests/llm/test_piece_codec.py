import hashlib
import random
import time

import pytest

from lodestrand.llm import piece_codec as pc


@pytest.fixture(scope="module")
def codec():
    return pc.codec(pc.model_path())


def brute(c, text):
    """Viterbi by all splits of the whole text."""
    if not text:
        return []
    s = pc.MARK + text.replace(" ", pc.MARK)
    ids = {b: i for i, b in enumerate(c.bytes) if b and c.byte_ids.count(i) == 0}
    most = max(map(len, ids))
    best = [(0.0, -1, None)] + [None] * len(s)
    for i in range(len(s)):
        for j in range(i + 1, min(len(s), i + most) + 1):
            k = ids.get(s[i:j].encode())
            if k is None and j > i + 1:
                continue
            new = best[i][0] + (c.score[k] if k is not None else c.unknown_score)
            if best[j] is None or new > best[j][0]:
                best[j] = (new, i, k)
    out, p = [], len(s)
    while p:
        _, i, k = best[p]
        out[:0] = [k] if k is not None else [c.byte_ids[x] for x in s[i:p].encode()]
        p = i
    return out


PARTS = ["the", " ", "\n", "ing", "é", "中", "hello", " world", "  ", "😀", "tion", "ab", "\t", "'s", "12", "   ", "\n\n", "zq"]


def test_brute_force(codec):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 10))) for _ in range(300)] + ["", " ", "\n", "  a", "a  ", "x" * 60]
    for t, ids in zip(texts, codec.encode_all(texts)):
        assert ids.tolist() == brute(codec, t)
        assert codec.decode(ids.tolist()) == t


def test_marker_and_bad_bytes(codec):
    ids = codec.encode_all([f"a{pc.MARK}b"])[0].tolist()
    assert codec.decode(ids) == "a b"
    assert codec.decode([codec.byte_ids[0xFF]]) == "�"


def test_trie(codec):
    for key in (b"the", "▁the".encode(), "é".encode()):
        s = 0
        for x in key:
            t = codec.trie.base[s] + x
            assert codec.trie.check[t] == s
            s = t
        assert codec.bytes[codec.trie.value[s]] == key


def test_small_memo(codec, monkeypatch):
    monkeypatch.setattr(pc, "MEMO_BYTES", 500)
    texts = ["one two three four five six seven", "one two"]
    fresh = pc.PieceCodec.load(pc.model_path())
    assert [x.tolist() for x in fresh.encode_all(texts)] == [x.tolist() for x in codec.encode_all(texts)]


def test_long_units(codec, monkeypatch):
    """A unit segmented on its own, a window at a time, as among others."""
    rnd = random.Random(7)
    units = ["".join(rnd.choice("abcdeéß中😀tionsing") for _ in range(rnd.randint(1, 300))).encode() for _ in range(100)]
    for window in (50, 64, 1 << 15):
        monkeypatch.setattr(pc, "WINDOW", window)
        assert [codec.segment_long(u) for u in units] == codec._side_by_side(units)
    text = "a" * 3_000 + "é" * 300 + "hello" * 100
    assert codec.encode_all([text])[0].tolist() == brute(codec, text)


def test_slices(codec, monkeypatch):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice(f" ab{pc.MARK}\n.") for _ in range(rnd.randint(0, 200))) for _ in range(100)]
    whole = [x.tolist() for x in codec.encode_all(texts)]
    monkeypatch.setattr(pc, "BLOCK_CHARS", 7)
    assert [x.tolist() for x in codec.encode_all(texts)] == whole


def test_ten_megabytes_of_one_letter():
    fresh, start = pc.PieceCodec.load(pc.model_path()), time.process_time()
    ids = fresh.encode_all(["a" * 10_000_000])[0]
    assert fresh.decode(ids) == "a" * 10_000_000 and time.process_time() - start < 60


def test_digests(spark, codec):
    rnd = random.Random(9)
    rows = [(k, "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 12)))) for k in range(40)] + [(40, None), (41, f"a{pc.MARK}b")]
    got = {r.doc_id: r for r in pc.encoding_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in rows:
        t = t or ""
        ids = brute(codec, t) if pc.MARK not in t else codec.encode_all([t])[0].tolist()
        r = got[k]
        assert (r.n_bytes, r.n_tokens, r.n_byte_tokens) == (len(t.encode()), len(ids), sum(i in codec.byte_ids for i in ids))
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.round_trip == (pc.MARK not in t)


def test_as_the_library_for_a_unigram_model(tmp_path):
    """A unigram model put together by hand; scores are multiples of 1/8, so that sums are exact in any order."""
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    rnd, alphabet = random.Random(3), "abcdeé中"
    pieces = {c: -rnd.randint(24, 72) / 8 for c in alphabet[:-1] + pc.MARK}
    while len(pieces) < 300:
        t = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 5)))
        pieces.setdefault(pc.MARK + t if rnd.random() < 0.4 else t, -rnd.randint(32, 112) / 8)
    m, kind = proto.ModelProto(), proto.ModelProto.SentencePiece
    rows = [("<unk>", 0, kind.UNKNOWN), *((f"<0x{x:02X}>", 0, kind.BYTE) for x in range(256)), *((t, x, kind.NORMAL) for t, x in sorted(pieces.items()))]
    for t, x, k in rows:
        one = m.pieces.add()
        one.piece, one.score, one.type = t, x, k
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback, m.trainer_spec.unk_id = proto.TrainerSpec.UNIGRAM, True, 0
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = "identity", True, False, True
    path = tmp_path / "unigram.model"
    path.write_bytes(m.SerializeToString())
    lib, own = sentencepiece.SentencePieceProcessor(model_file=str(path)), pc.PieceCodec.load(str(path))
    for _ in range(3000):
        t = "".join(rnd.choice(alphabet + "  \n😀") for _ in range(rnd.randint(0, 60)))
        ids = lib.encode(t)
        assert own.encode_all([t])[0].tolist() == ids and own.decode(ids) == lib.decode(ids)


def test_operator_cases(spark):
    rows = [(1, None, 3), (2, "", 3), (3, "Hello  wörld", 3), (3, "Hello  wörld", 3), (4, "much text " * 20000, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, token_ids int")
    out = pc.encoded(df, check="ok")
    assert out.columns == ["doc_id", "text", "token_ids", "ok"] and out.where("ok").count() == 5
    back = pc.decoded(out.drop("text")).select("doc_id", "text").collect()
    assert sorted((r.doc_id, r.text) for r in back) == sorted((i, t or "") for i, t, _ in rows)
    assert pc.encoded(df.limit(0)).count() == 0 and pc.encoding_digest(df.limit(0)).count() == 0
