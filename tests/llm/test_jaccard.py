import random

import pytest

from lodestar.llm import jaccard

SCHEMA = "doc_id long, text string"


def brute(rows, n, percent):
    """doc_id -> (set size, smallest id reached)."""
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(d, set()).update({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d)) for d in sets}


def corpus(seed, copies, edits):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = []
    for base in range(2):
        text = [word() for _ in range(120 + 40 * base)]
        for _ in range(copies):
            t = list(text)
            for _ in range(r.randint(0, edits)):
                t[r.randrange(len(t))] = word()
            rows.append(" ".join(t))
    line = " ".join(word() for _ in range(12))
    rows += [" ".join([word() for _ in range(r.randint(5, 60))]) + "\n" + line for _ in range(60)]
    rows += ["", None, "one", "One", "two words", "two  WORDS", "x y z", " \t\n", rows[0], rows[0].upper()]
    r.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("n", "percent", "edits", "block"), [(3, 90, 5, 2000), (5, 80, 7, 1 << 20)])
def test_hot_groups_match_brute_force(spark, monkeypatch, n, percent, edits, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = corpus(7, 70, edits)
    got = {r[0]: (r[1], r[2]) for r in jaccard.join(spark.createDataFrame(rows, SCHEMA), n, percent).collect()}
    want = brute(rows, n, percent)
    assert got == want
    assert len({c for _, c in want.values()}) > 60


def test_nulls_repeats_and_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text, 1, 1), (5, text, 2, 2), (5, text, 2, 2), (7, "", 3, 3), (None, "alone " * 3, 4, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, token int, key int")
    got = sorted(tuple(r) for r in jaccard.join(df).select("doc_id", "component_id").na.fill(-1).collect())
    assert got == [(-1, -1), (-1, 5), (5, 5), (5, 5), (7, 7)]
    kept = jaccard.one_of_each(df, 5, 80)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or -1, r["token"]) for r in kept.collect()) == [(-1, 1), (-1, 4), (5, 2), (7, 3)]


def test_empty(spark):
    assert jaccard.join(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("start", [2**63 - 400, -(2**63), 2**62])
def test_any_number_is_an_id(spark, start):
    rows = [(start + 3 * i, t) for i, (_, t) in enumerate(corpus(5, 25, 4))]
    got = {r[0]: (r[1], r[2]) for r in jaccard.join(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows, 3, 90)


def test_null_ids_join_what_they_are_near_to(spark):
    base = [f"w{i}" for i in range(80)]
    text = lambda *gone: " ".join("x" if i in gone else w for i, w in enumerate(base))
    # 40 and 9 are linked by the null between them alone; two nulls reach no id
    rows = [(40, text(1, 2, 3)), (None, text(2)), (9, text(2, 40, 41)), (None, "only nulls here"), (None, "only nulls here"), (-7, "apart from all")]
    got = sorted(((r[0], r[2]) for r in jaccard.join(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(40, 9), (None, 9), (9, 9), (None, None), (None, None), (-7, -7)], key=str)


def test_two_sets_of_one_size_under_one_id(spark):
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows = [(1, " ".join(a)), (1, " ".join(b)), (5, " ".join([*a[:-1], "x"])), (6, " ".join([*b[:-1], "y"])), (7, "z " * 9)]
    got = {(r[0], r[2]) for r in jaccard.join(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 1), (5, 1), (6, 1), (7, 7)}


def test_very_long_text(spark):
    r = random.Random(1)
    words = [f"t{r.randrange(10**6)}" for _ in range(200_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-50])), (3, " ".join(words[:100]))]
    assert {(x[0], x[2]) for x in jaccard.join(spark.createDataFrame(rows, SCHEMA)).collect()} == {(1, 1), (2, 1), (3, 3)}
