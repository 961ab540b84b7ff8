import random
import re
from collections import defaultdict

import numpy as np

from lodestrand.llm import ngram_join as nj

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    at, shared = defaultdict(list), defaultdict(int)
    for i, s in sets.items():
        for x in s:
            for j in at[x]:
                shared[j, i] += 1
            at[x].append(i)
    for (a, b), c in shared.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus(seed, families=12):
    rnd, rows = random.Random(seed), []
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 4)))
    common = " ".join(word() for _ in range(15))
    for _ in range(families):
        base = [word() for _ in range(rnd.choice([2, 6, 30, 120]))]
        for _ in range(rnd.randint(1, 9)):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 5])):
                w[rnd.randrange(len(w))] = word()
            rows.append(" ".join(w) + (" " + common if rnd.random() < 0.3 else ""))
    rows += [None, "", "  \n", "one", "ONE", "two words", "Two\twords", "a b c", "a b c a b c"]
    rnd.shuffle(rows)
    return list(enumerate(rows))


def check(spark, rows, n, percent):
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.similar_components(df, n, percent).collect()}
    assert got == brute(rows, n, percent)


def test_brute_force(spark):
    check(spark, corpus(1), 3, 90)
    check(spark, corpus(2), 5, 80)


def test_chain_of_near_copies(spark):
    base = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join(base[:k] + [f"x{j}" for j in range(k)] + base[k:])) for k in range(0, 30)]
    check(spark, rows, 3, 90)


def test_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert nj.similar_components(df).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in nj.similar_components(twice).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 3)]
    kept = nj.keep_one(twice)
    assert kept.columns == ["doc_id", "text"] and sorted({r.doc_id for r in kept.collect()}) == [1, 3]


def thue_morse(k, x="a", y="b"):
    a, b = x, y
    for _ in range(k):
        a, b = a + b, b + a
    return a, b


def test_words_that_a_polynomial_confuses(spark):
    one, two = thue_morse(10)
    check(spark, [(1, f"x {one} y"), (2, f"x {two} y"), (3, f"x {one} y z"), (4, f"x {two[:100]} y"), (5, f"x {one[:100]} y")], 3, 90)


def test_several_texts_of_one_id(spark):
    a, b, c = ("alpha beta gamma delta", "one two three four five", "red green blue grey")
    rows = [(0, a), (1, a), (1, b), (2, b), (3, c)]
    got = sorted((r.doc_id, r.component_id) for r in nj.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 0), (3, 3)]


def test_crowd_below_and_above_the_threshold(spark):
    """Many documents share most of their words with all others, and are similar to few of them."""
    rnd = random.Random(5)
    base, rows = [f"w{k}" for k in range(60)], []
    for i in range(150):
        own = random.Random(i // 3)
        cut = own.randrange(10, 40)
        rows.append((i, " ".join(base[:cut] + [f"f{i // 3}x{k}" for k in range(16)] + base[cut:] + [f"t{rnd.randrange(9)}"])))
    check(spark, rows, 3, 80)
    check(spark, rows, 5, 60)


def test_clashing_columns_and_long_texts(spark):
    long = " ".join(f"v{k % 5000}q{k % 7}" for k in range(60_000))
    rows = [(1, long, "x", 1), (2, long + " tail", "y", 2), (3, "a b c d e f", None, None), (4, None, "z", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _c string, copies int")
    kept = nj.keep_one(df)
    assert kept.columns == df.columns and sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[2], rows[3]]


def test_crowd_without_similar_texts_makes_few_pairs(spark, monkeypatch):
    """The pipeline's near: texts that share most of a text and single edits, but are not similar, are told apart before they are paired."""
    rnd, seen, in_all_orders = random.Random(3), [], nj.in_all_orders
    monkeypatch.setattr(nj, "in_all_orders", lambda pairs, *rest: seen.append(pairs.count()) or in_all_orders(pairs, *rest))
    rows = []
    for i in range(150):
        gone = set(rnd.sample(range(0, 200, 5), 8))
        rows.append((i, " ".join(f"w{k}" for k in range(200) if k not in gone)))
    check(spark, [*rows, (150, rows[7][1] + " z")], 5, 80)
    assert sum(seen) < 5 * len(rows)


def test_signatures_never_hide_similar_sets():
    rnd = np.random.default_rng(2)
    base = rnd.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: rnd.integers(1, 400)], rnd.integers(0, 1 << 63, rnd.integers(0, 60), dtype=np.uint64)])) for _ in range(40)] + [base[:0]]
    sig = nj.signatures(np.concatenate(sets), np.cumsum([0, *map(len, sets)])).view(np.uint64)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            bits = int(np.bitwise_count(sig[i] ^ sig[j]).sum())
            assert bits <= len(np.setxor1d(x, y)) and (i == j or len(x) + len(y) > 0)
    assert not sig[-1].any() and sig[0].any()


def test_rounds_around_pivots_have_other_leaders(spark):
    sig = f"named_struct({', '.join(f'{chr(39)}s{k}{chr(39)}, 0L' for k in range(nj.SIGNATURE_WORDS))}) sig"
    others = spark.range(40).selectExpr("100L pivot", "7L token", "id doc_id", "100 n", "30 nd", "0 pos")
    comp, sigs = spark.range(40).selectExpr("id doc_id", "id % 2 comp"), spark.range(40).selectExpr("id doc_id", sig)
    leaders = set()
    for k in range(nj.PIVOT_ROUNDS):
        rows = nj.around_leaders(others, comp, sigs, 80, k).collect()
        assert len({r.a for r in rows}) == 1 and sorted(r.b for r in rows) == [b for b in range(40) if b % 2 != rows[0].a % 2]
        leaders.add(rows[0].a)
    assert len(leaders) > 1
