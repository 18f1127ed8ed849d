import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import lm_scoring, mixing, quality_classifier, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = {}
    for x in tri:
        count[x] = count.get(x, 0) + 1
    cover = {j for i, x in enumerate(tri) if count[x] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)


def texts(seed=1, n=120):
    r = random.Random(seed)
    out = [None, "", "\n\n", "a b", "a b c", "x y z x y z", "é ñ\x0bq\x0c€ | # $", "same\nsame\n\nsame \n \n", "  ", "w " * 3000, "a b c d " * 700, "nb sp line em"]
    for _ in range(n):
        v = [f"w{r.randrange(r.choice((5, 40, 4000)))}" for _ in range(200)]
        out.append(" ".join(r.choice(v) + r.choice(["", "", "", "\n", "***", " |"]) for _ in range(r.randrange(200))))
    return out


def test_base_counts(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i, _ in rows[::2]], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules.score_rules(docs, labels, bits=10).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t), t
        assert not (r.kept and r.base_failed)


def test_ratio_parts_good_from_junk(spark):
    r = random.Random(5)
    good = [" ".join(r.choice([f"the{r.randrange(30)}", f"n{r.randrange(200)}"]) for _ in range(120)) for _ in range(60)]
    junk = [" ".join(r.choice([f"the{r.randrange(30)}***", f"n{r.randrange(200)}##"]) for _ in range(120)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(good + junk)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 60, 2)], "doc_id long, quality int")
    got = {x.doc_id: x for x in quality_rules.score_rules(docs, labels, bits=12).collect()}
    assert all(got[i].kept for i in range(60))
    assert not any(got[i].kept for i in range(60, 90))
    kept = quality_rules.kept(docs.withColumnRenamed("doc_id", "DOC_ID").selectExpr("DOC_ID as doc_id", "text", "1 as words", "2 as llr"), labels, bits=12)
    assert kept.columns == ["doc_id", "text", "words", "llr"] and kept.count() == 60
    none = quality_rules.score_rules(docs, labels.limit(0), bits=8)
    assert {x.llr for x in none.collect()} == {0.0}
    assert quality_rules.score_rules(docs.limit(0), labels, bits=8).count() == 0


def test_target_is_counted_from_every_good_document(spark):
    n = 20_500
    docs = spark.range(n + 700).selectExpr("id as doc_id", "'a b' as text")
    docs = docs.union(spark.createDataFrame([(None, "c d e"), (5, "x y z")], "doc_id long, text string"))
    labels = spark.range(n).selectExpr("id as doc_id", "1 as quality")
    labels = labels.union(labels.limit(3)).union(spark.createDataFrame([(None, 1), (n + 1, 0)], "doc_id long, quality int"))
    got = quality_rules.weights_rows(docs, labels, bits=8)
    assert got.count() == 2**8
    raw, target = got.selectExpr("sum(raw)", "sum(target)").first()
    assert (raw, target) == (3 * (n + 700) + 2 * 5, 3 * n + 5)
    # a map so full that it lets everything through changes nothing
    every = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    assert quality_rules.labelled(docs, every, bits=6).selectExpr("count(*)", "count(good)").first()[:] == (n + 702, n + 1)


def test_lm_prefers_the_target(spark):
    r = random.Random(9)
    a = [" ".join(r.choice(["sun", "moon", "star", "sky"]) for _ in range(60)) for _ in range(40)]
    b = [" ".join(r.choice(["tax", "law", "fee", "due"]) for _ in range(60)) for _ in range(40)]
    docs = spark.createDataFrame([*enumerate(a + b), (100, None), (101, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 40, 2)] + [(0, 1)], "doc_id long, quality int")
    got = {x.doc_id: x for x in lm_scoring.score(docs, labels).collect()}
    assert len(got) == 82
    assert max(got[i].score for i in range(40)) < min(got[i].score for i in range(40, 80))
    assert got[100].score == 0.0 and not got[100].selected
    # the background counts are those of all documents
    placed = docs.selectExpr("0L as block", "doc_id", "text")
    found = lm_scoring.totals(lm_scoring.counts(placed, spark.range(3).selectExpr("0L as block", "id as doc_id"), 2)).where("block is null").collect()
    assert (sum(x.n_words for x in found), sum(x.t_words for x in found), sum(x.words for x in found)) == (80 * 60, 3 * 60, 8)
    assert lm_scoring.score(docs.limit(0), labels).count() == 0


def lm_brute(rows, good):
    """Losses by whole counts of words and pairs; the background is whole (every document is labelled, or none)."""
    full, aim = [{}, {}], [{}, {}]
    split = [(t or "").split() for _, t in rows]
    for (d, _), w in zip(rows, split):
        for models in [full, aim][: 1 + (d in good)]:
            for kind, keys in enumerate((w, list(zip([None, *w], w)))):
                for k in keys:
                    models[kind][k] = models[kind].get(k, 0) + 1
    V, out = len(full[0]), []
    for (d, _), w in zip(rows, split):
        loss = []
        for (ones, twos), inside in ((aim, d in good), (full, True)):
            n = sum(ones.values()) - inside * len(w)
            c1 = lambda x: ones.get(x, 0) - inside * w.count(x)
            pairs = list(zip([None, *w], w))
            total = 0.0
            for v, x in pairs:
                p1 = (c1(x) + 0.1) / (n + 0.1 * V)
                before = c1(v) if v is not None else 0
                total -= math.log((min(twos.get((v, x), 0) - inside * pairs.count((v, x)), before) + 4 * p1) / (before + 4))
            loss.append(total / max(1, len(w)))
        out.append((d, len(w), *loss))
    return out


def test_lm_counts_every_word_and_pair_on_its_own(spark):
    # more different words and pairs than 2**18 and 2**20 places could hold apart
    docs = spark.range(300).selectExpr("id % 7 as block", "id as doc_id", "array_join(transform(sequence(0, 3999), i -> concat('w', id * 4000 + i)), ' ') as text")
    rows = lm_scoring.totals(lm_scoring.counts(docs, docs.limit(0).select("block", "doc_id"), 3)).where("block is null")
    assert rows.selectExpr("sum(words)", "sum(n_words)", "sum(t_words)", "count(*)").first()[:] == (1_200_000, 1_200_000, 0, 8)


def test_lm_losses_match_brute_force(spark):
    r = random.Random(6)
    rows = [(i, " ".join(r.choice("a b c d e f g".split()) + r.choice(["", "", str(r.randrange(40))]) for _ in range(r.randrange(60)))) for i in range(30)]
    rows += [(40, None), (41, "alone"), (3, rows[3][1]), (5, "another text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(d, 1) for d, _ in rows], "doc_id long, quality int")
    got = sorted((x.doc_id, x.n_words, x.target_loss, x.background_loss) for x in lm_scoring.score(df, labels, block_bytes=200, bucket_bytes=150).collect())
    want = sorted(lm_brute(rows, {d for d, _ in rows}))
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert all(abs(a - b) < 1e-9 for x, y in zip(got, want) for a, b in zip(x[2:], y[2:]))


@pytest.mark.parametrize("rate", [0.001, 0.3, 0.5, 0.97])
def test_lm_thins_binomially(rate):
    g = np.random.default_rng(1).integers(0, 2**63, 60_000).astype(np.uint64)
    n = np.array([1, 5, 100, 10_000])[np.arange(60_000) % 4]
    got = lm_scoring.thin(g, n, rate)
    for k in (1, 5, 100, 10_000):
        one, spread = got[n == k], math.sqrt(k * rate * (1 - rate))
        assert 0 <= one.min() and one.max() <= k
        assert abs(one.mean() - k * rate) < 5 * spread / math.sqrt(len(one))
        assert abs(one.var() - spread**2) < 5 * spread**2 * math.sqrt((2 + 1 / spread**2) / len(one))
    assert (lm_scoring.thin(g[::-1], n[::-1], rate)[::-1] == got).all()
    assert (lm_scoring.thin(g, n, 1.0) == n).all() and not lm_scoring.thin(g, n, 0.0).any()


def test_lm_thinned_background_matches_slow_counts(spark):
    """A tenth is labelled: losses from dictionaries of words and pairs, the thinned counts by the operator's own share of each."""
    r = random.Random(16)
    rows = [(i, " ".join(r.choice("a b c d e f g".split()) + str(r.randrange(9)) for _ in range(r.randrange(1, 80)))) for i in range(60)] + [(None, "a1 b2"), (2**63 - 1, "c3 d4"), (-5, "e5")]
    good = {i for i in range(0, 60, 6)}
    df = spark.createDataFrame([(*x, 1, "b") for x in rows], "doc_id long, text string, n long, block string")
    got = {x.doc_id: x for x in lm_scoring.score(df, spark.createDataFrame([(d, 1) for d in good], "doc_id long, quality int"), block_bytes=300, bucket_bytes=500).collect()}
    full, aim = {}, {}
    for d, t in rows:
        w = t.split()
        for k in w + list(zip([None, *w], w)):
            full[k] = full.get(k, 0) + 1
            if d in good:
                aim[k] = aim.get(k, 0) + 1
    words = [k for k in full if isinstance(k, str)]
    n_full, n_aim = sum(full[k] for k in words), sum(aim.get(k, 0) for k in words)
    h = {k: lm_scoring.word_hashes([k.encode()]) for k in words}
    key = lambda k: h[k] & ~np.uint64(1) if isinstance(k, str) else lm_scoring.mix(lm_scoring._START if k[0] is None else h[k[0]], h[k[1]], 61) | np.uint64(1)
    thin = {k: int(lm_scoring.thin(key(k), np.array([c]), n_aim / n_full)[0]) for k, c in full.items()}
    for d, t in rows:
        w = t.split()
        mine = {}
        for k in w + list(zip([None, *w], w)):
            mine[k] = mine.get(k, 0) + 1
        loss = []
        for model, whole, part, total, everything in ((aim, aim, d in good, n_aim, n_aim), (thin, full, True, n_aim, n_full)):
            c = lambda k: model.get(k, 0) * (1 - part * mine[k] / max(whole.get(k, 0), mine[k]))
            n = total * (1 - part * len(w) / everything)
            loss.append(sum(-math.log((min(c((v, x)), c(v) if v else 0) + 4 * (c(x) + 0.1) / (n + 0.1 * len(words))) / ((c(v) if v else 0) + 4)) for v, x in zip([None, *w], w)) / len(w))
        assert abs(got[d].target_loss - loss[0]) < 1e-9 and abs(got[d].background_loss - loss[1]) < 1e-9
        assert got[d].selected == (got[d].score <= lm_scoring.THRESHOLD)


def test_classifier_learns_without_held_out(spark):
    r = random.Random(2)
    good = [" ".join(r.choice(["The", "of", "tion.", "and"]) + str(r.randrange(3)) for _ in range(40)) for _ in range(150)]
    bad = [" ".join(r.choice(["THE!!", "$$$", "BUY|", "a***"]) for _ in range(40)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(999, None), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(210)], "doc_id long, quality int")
    got = {x.doc_id: x for x in quality_classifier.classify(docs, labels).collect()}
    assert len(got) == 212 and all(0 <= x.score <= 1 for x in got.values())
    held = [i for i in range(210) if got[i].held_out]
    assert 20 < len(held) < 100
    assert min(got[i].score for i in held if i < 150) > max(got[i].score for i in held if i >= 150)
    assert all(got[i].predicted == (got[i].score >= 0.7) for i in got)
    # labels of the held-out quarter change nothing
    other = spark.createDataFrame([(i, int(i < 150) if not got[i].held_out else int(i >= 150)) for i in range(210)], "doc_id long, quality int")
    again = {x.doc_id: x.score for x in quality_classifier.classify(docs, other).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-9 for i in again)
    assert {x.score for x in quality_classifier.classify(docs, labels.limit(0)).collect()} == {0.5}


@pytest.fixture(scope="module")
def sources(spark):
    r = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(r.randint(1, 30))), "big" if i < 4000 else f"s{i % 5}" if i % 7 else None) for i in range(6000)]
    return rows, spark.createDataFrame([(*x, 1, "k") for x in rows], "doc_id long, text string, source string, weight int, _s string")


def test_mix_meets_the_limit_and_uses_all(spark, sources):
    rows, df = sources
    got = mixing.mix(df, max_repeat=3.0).collect()
    n = {}
    for x in got:
        n.setdefault(x.doc_id, []).append(x.epoch)
    assert set(n) == {i for i, _, _ in rows}
    assert all(sorted(e) == list(range(len(e))) for e in n.values())
    repeats = {x.source: x.repeats for x in got}
    assert abs(max(repeats.values()) - 3.0) < 1e-3 and abs(min(repeats.values()) - 1.0) < 1e-9
    assert abs(sum({x.source: x.weight for x in got}.values()) - 1) < 1e-9
    tokens = {}
    for x in got:
        tokens[x.source] = tokens.get(x.source, 0) + x.n_tokens
    total = {}
    for _, t, s in rows:
        total[s] = total.get(s, 0) + len(t.split())
    for s, k in tokens.items():
        assert repeats[s] * total[s] - 31 <= k <= repeats[s] * total[s] + 1e-6 * total[s] + 1
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(7), max_repeat=3.0).collect()), key=str)


def test_mix_entropy_and_budget(spark, sources):
    rows, df = sources
    got = mixing.mix(df, target_entropy=1.6, max_repeat=None, budget=20_000.0).collect()
    w = {x.source: x.weight for x in got}
    assert abs(-sum(v * math.log(v) for v in w.values()) - 1.6) < 1e-4
    assert sum(x.n_tokens for x in got) <= 20_000
    assert sum(x.n_tokens for x in got) > 20_000 - 31 * len(w)
    kept = mixing.mixed(df, max_repeat=2.0)
    assert kept.columns == df.columns


def test_mix_edges(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, "", None), (2, "", None)], schema)).collect()
    assert sorted(x.doc_id for x in got) == [1, 2, 2]
    assert mixing.mix(spark.createDataFrame([(1, "x y", "a")], schema)).count() == 1


def test_mix_matches_a_slow_bisection(spark, sources):
    """Exponent and weights against a plain bisection over dictionaries; every block against its budget."""
    rows, df = sources
    got = mixing.mix(df, entropy_share=0.5, max_repeat=None).collect()
    total = {}
    for _, t, s in rows:
        total[s] = total.get(s, 0) + len(t.split())
    share = [v / sum(total.values()) for v in total.values()]

    def entropy(a):
        w = [p**a for p in share]
        return -sum(x / sum(w) * math.log(x / sum(w)) for x in w)

    aim, low, high = (entropy(1.0) + math.log(len(share))) / 2, 0.0, 1.0
    for _ in range(60):
        low, high = ((low + high) / 2, high) if entropy((low + high) / 2) >= aim else (low, (low + high) / 2)
    assert 0.01 < low < 0.99 and {abs(x.exponent - low) < 1e-6 and abs(x.entropy - aim) < 1e-5 for x in got} == {True}
    z = sum(p**low for p in share)
    weight = {s: (v / sum(total.values())) ** low / z for s, v in total.items()}
    assert all(abs(x.weight - weight[x.source]) < 1e-6 for x in got)
    budget = max(total[s] / weight[s] for s in total)
    held, last = {}, {}
    for x in got:
        held[x.source, x.block] = held.get((x.source, x.block), 0) + x.n_tokens
        last[x.source] = max(last.get(x.source, 0), x.block)
        assert x.block == min(int(x.start / (weight[x.source] * budget) * 64 + 1e-9), 63) or abs(x.start / (weight[x.source] * budget) * 64 % 1) < 1e-3
    assert set(last.values()) == {63}
    for s in total:
        quota = weight[s] * budget / 64
        assert all(abs(held.get((s, b), 0) - quota) <= 30.01 for b in range(64)), s
    # a source's copies follow each other without a gap
    for s in total:
        mine = sorted((x.start, x.n_tokens) for x in got if x.source == s)
        assert all(a + n == b for (a, n), (b, _) in zip(mine, mine[1:])) and mine[0][0] == 0


def test_no_block_is_empty_where_documents_are_longer_than_blocks(spark):
    """Every block of every source is covered by the spans of its copies, whatever their lengths; repeated rows included."""
    r = random.Random(8)
    rows = [(i, "w " * r.choice((3, 40, 2000)), r.choice("aab")) for i in range(60)] + [(60, "w " * 900, "c"), (61, "w " * 7, "c"), (61, "w " * 7, "c"), (None, "w " * 5, "c")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), entropy_share=0.6, max_repeat=None).collect()
    for s in "abc":
        mine = [x for x in got if x.source == s]
        assert {b for x in mine for b in range(x.block, x.last_block + 1)} == set(range(64)), s
        weight, total = mine[0].weight, sum(len(t.split()) for _, t, z in rows if z == s)
        quota = mine[0].repeats * total
        # a gap is at most a block's part, an overshoot at most a document
        assert quota - quota / 64 - 1e-3 * total <= sum(x.n_tokens for x in mine) <= quota + 2000 and weight > 0


def test_running_sums_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SPAN", 3)
    rows = [("a" if i % 2 else "b", i, i * i) for i in range(40)]
    got = mixing.running(spark.createDataFrame(rows, "k string, at long, n long"), ["k"], "at", "n").collect()
    assert all(x.before == sum(n for k, i, n in rows if k == x.k and i < x["at"]) for x in got) and len(got) == 40


def test_sample_holds_a_row_an_id(spark, monkeypatch):
    """An id that repeats ten thousand times comes to the driver once, and counts once."""
    rows = [(7, f"bad {i % 3} text *** ### again and again") for i in range(10_000)] + [(i, f"some good words of text {i}") for i in range(100, 180)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(100, 140)] + [(7, 0)], "doc_id long, quality int")
    seen = []
    real = quality_classifier.fit
    monkeypatch.setattr(quality_classifier, "fit", lambda pos, unl, prior: seen.append((len(pos), len(unl))) or real(pos, unl, prior))
    once = docs.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))
    w, prior = quality_classifier.train(docs, labels, rows=100)
    v, same = quality_classifier.train(once, labels, rows=100)
    assert seen[0] == seen[1] and sum(seen[0]) <= 100
    assert prior == same and np.allclose(w, v)


def slow_adam(grad, dim, steps, decay, rate):
    w, m, v = [0.0] * dim, [0.0] * dim, [0.0] * dim
    for t in range(1, steps + 1):
        g = [a + decay * b for a, b in zip(grad(w), w)]
        m = [0.9 * a + 0.1 * b for a, b in zip(m, g)]
        v = [0.999 * a + 0.001 * b * b for a, b in zip(v, g)]
        w = [x - rate * (a / (1 - 0.9**t)) / (math.sqrt(b / (1 - 0.999**t)) + 1e-8) for x, a, b in zip(w, m, v)]
    return w


def test_risk_matches_a_slow_version():
    """Non-negative positive-unlabelled risk: its gradient by differences of the risk itself, point by point."""
    r = np.random.default_rng(3)
    pos, unl = r.normal(0.6, 1, (40, 4)), np.concatenate([r.normal(0.6, 1, (15, 4)), r.normal(-0.8, 1, (50, 4))])
    prior = 0.25

    def loss(w, rows, sign):
        return sum(math.log1p(math.exp(-sign * sum(a * b for a, b in zip(w, x)))) for x in rows) / len(rows)

    def grad(w):
        negative = lambda w: loss(w, unl, -1) - prior * loss(w, pos, -1)
        part = (lambda w: prior * loss(w, pos, 1) + negative(w)) if negative(w) >= 0 else (lambda w: -negative(w))
        return [(part([x + (1e-5 if i == k else 0) for k, x in enumerate(w)]) - part([x - (1e-5 if i == k else 0) for k, x in enumerate(w)])) / 2e-5 for i in range(len(w))]

    import inspect

    given = {k: p.default for k, p in inspect.signature(quality_classifier._adam).parameters.items() if p.default is not p.empty}
    slow = slow_adam(grad, 4, given["steps"], given["decay"], given["rate"])
    fast = quality_classifier.fit(pos, unl, prior)
    assert np.allclose(fast, slow, atol=2e-3) and (unl[15:] @ fast < pos.mean(0) @ fast).mean() > 0.8


def test_prior_is_near_the_true_share():
    r = np.random.default_rng(5)
    for share in (0.2, 0.5, 0.8):
        n = 4000
        good = int(n * share)
        pos = r.normal(1.5, 1, (n, 3))
        unl = np.concatenate([r.normal(1.5, 1, (good, 3)), r.normal(-1.5, 1, (n - good, 3))])
        r.shuffle(unl)
        assert abs(quality_classifier.class_prior(pos, unl) - share) < 0.08
