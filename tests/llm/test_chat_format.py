import hashlib
import random

from lodestrand.llm import chat_format as cf


def test_escapes_are_reversible():
    m, rnd = cf.ChatMachine(), random.Random(3)
    parts = [*m.controls, "\\", "#", "<", "</tur", "### Ass", "a", "\n", " ", ": ", "</turn>", cf.SPOOF]
    for _ in range(3000):
        turns = [(rnd.choice(["user", "assistant", "system", "tool", "", "</role> x\\"]), "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 8)))) for _ in range(3)]
        text = "".join(s.text for r, t in turns for s in m.turn(r, t))
        assert list(m.read(cf.TEMPLATE["begin"] + text + cf.TEMPLATE["end"])) == turns
        assert all(m.unescape(m.turn(r, t)[1].text) == t for r, t in turns)


def expected(turns):
    t = hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
    loss = "".join(x for r, x in turns if r == "assistant")
    return len(turns), t, len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_query_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (2, 0, None, "x"), (2, 0, None, "a"), (3, 0, "assistant", cf.SPOOF), (3, 1, "assistant", "é😀")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in cf.read_back(df).collect()}
    want = {1: [("user", ""), ("assistant", "b")], 2: [("", "a"), ("", "x")], 3: [("assistant", cf.SPOOF), ("assistant", "é😀")]}
    for c, turns in want.items():
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == expected(turns)
    assert (got[1].n_out_of_order, got[2].n_out_of_order, got[3].n_out_of_order) == (0, 2, 2)
    assert cf.read_back(df.limit(0)).count() == 0


def test_segments(spark):
    df = spark.createDataFrame([(1, k, "user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(9000)], "conv_id long, turn long, role string, text string")
    segs = cf.format_segments(df).orderBy("conv_id", "seq").collect()
    text = "".join(s.text for s in segs)
    assert [s.seq for s in segs] == list(range(len(segs)))
    assert [t for _, t in cf.ChatMachine().read(text)] == [f"t{k}" for k in range(9000)]
    assert "".join(s.text for s in segs if s.loss) == "".join(f"t{k}" for k in range(1, 9000, 2))
    assert cf.read_back(df).first().formatted_chars == len(text)


def test_long_conversations_and_extra_columns(spark, tmp_path):
    """Output that is read back in several parts, texts of megabytes, repeated rows, other columns, and the query's own conversation."""
    rnd = random.Random(5)
    turns = [("user" if k % 2 == 0 else "assistant", rnd.choice(["x" * 400_000, cf.SPOOF * 2000, "\\", ""])) for k in range(40)]
    rows = [(1, k, r, t, k) for k, (r, t) in enumerate(turns)] + [(2, 0, "user", "same", 0)] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in cf.op3_chat_format(spark, str(tmp_path)).collect()}
    want = {1: turns, 2: [("user", "same")] * 2, -7: [("user", cf.SPOOF), ("assistant", cf.SPOOF)]}
    assert got.keys() == want.keys()
    m = cf.ChatMachine()
    for c, listed in want.items():
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == expected(listed)
        assert r.formatted_chars == len(cf.TEMPLATE["begin"]) + len(cf.TEMPLATE["end"]) + sum(len(s.text) for role, t in listed for s in m.turn(role, t))
