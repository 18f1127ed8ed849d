"""Operators 11 to 13 against brute force: resampling, fill-in-the-middle, line deduplication."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestar.llm import fim, lines, resampling

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def odd_texts(seed=3, n=150):
    r = random.Random(seed)
    out = [None, "", " ", "\n", "\n\n \n", "a", " a ", "É é x y", "a<P>b", "x <S> y", "<M>", "one two\x0bthree\x0c\r\n four", "<", "<P", "P>", "AÀa àA", "w " * 40_000, "l\n" * 20_000, "\U0001f600 b" * 50]
    for _ in range(n):
        out.append("".join(r.choice(["the", "Of", "é", "zwölf", "7", "x-y", "<", ">", "S"]) + r.choice([" ", " ", "\n", "\t", "  ", ""]) for _ in range(r.randrange(90))))
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(9)
    found = list(enumerate(odd_texts()))
    found += [(1000 + i, found[20 + i % 5][1]) for i in range(80)]  # copies
    found += [(3, found[3][1]), (40, found[40][1]), (40, "another text of the same id " * 6), (None, "no id " * 20), (None, None), (None, "no id " * 20), (-1, "no id " * 20)]
    r.shuffle(found)
    return found


def frame(spark, rows):
    """With columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, 1, "x", 2.0, b"y") for i, t in rows], "doc_id long, text string, key int, N string, weight double, hi binary").repartition(5)


# fill in the middle


def cut_slowly(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h4 % 100 < 80 else "psm"
    return len(units), form, len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}" if form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}"


def test_fim_matches_a_list_of_units(spark, rows):
    got = Counter((x.doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, x.output, x.back) for x in fim.transform(frame(spark, rows)).withColumn("back", fim.restored()).collect())
    assert got == Counter((i, *cut_slowly(i, t), t or "") for i, t in rows)
    assert {x[2] for x in got} == {"plain", "psm", "spm"}


def test_fim_digests_and_empty_table(spark, rows):
    got = fim.digests(fim.transform(frame(spark, rows)))
    assert {(x.doc_id, x.output_sha256, x.restored_sha256) for x in got.collect()} == {(i, sha(cut_slowly(i, t)[4]), sha(t or "")) for i, t in rows}
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert fim.transform(frame(spark, rows).where("false")).count() == 0


def test_fim_rates_and_markers(spark, rows):
    every = fim.transform(frame(spark, rows), rate=100, spm=0, markers=("[p]", "[s]", "[m]"))
    assert {x.form for x in every.where("n > 0").collect()} == {"psm"}
    assert all((t or "") == b for t, b in every.select("output", fim.restored(markers=("[p]", "[s]", "[m]")).alias("b")).where("output not like '[p]%'").collect())


def test_fim_holds_no_units():
    """Half a million units: the matcher's peak is far below that of a list of them."""
    text = "word " * 500_000
    tracemalloc.start()
    n = fim.count_units(text)
    a, b = fim.unit_ends(text, 100_000, 400_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 500_001 and (a, b) == (5 * 100_000 - 1, 5 * 400_000 - 1) and peak < 100_000
    assert fim.unit_ends("", 0, 0) == (0, 0) and fim.unit_ends("a b", 0, 2) == (0, 3) and fim.unit_ends("a b", 1, 1) == (1, 1)


# importance resampling


def resample_slowly(rows, bench, buckets=10_000, percent=25, least=20):
    def features(t):
        w = WORD.findall((t or "").translate(UPPER))
        return len(w), [zlib.crc32(f.encode()) % buckets for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    each = [(i, *features(t)) for i, t in rows]
    s, t = Counter(f for _, _, x in each for f in x), Counter(f for b in bench for f in features(b)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    out = []
    for i, n, x in each:
        gain = [math.floor(1000 * math.log((t[f] + 1) * (big_s + buckets) / ((s[f] + 1) * (big_t + buckets)))) for f in x]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is not None, x[0] or 0, x[3], x[2]))
    drawn = {id(x): k + 1 for k, x in enumerate(fit[: percent * len(fit) // 100])}
    return Counter((*x, drawn.get(id(x))) for x in out)


def test_resampling_matches_brute_force(spark, rows):
    bench = ["The of zwölf seven", None, "", "the Of é 7 " * 9, "the Of é 7 " * 9]
    got = resampling.resample(frame(spark, rows), spark.createDataFrame(list(enumerate(bench)), "item_id long, text string"))
    assert Counter(tuple(x) for x in got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()) == resample_slowly(rows, bench)


def test_resampling_hot_copies_ties_and_repeats(spark):
    """A third of all rows share a text, ids repeat, so scores tie."""
    hot = "the same words over and over again " * 4
    rows = [(i, hot) for i in range(400)] + [(i % 50, f"text number {i % 30} of some words " * 4) for i in range(800)]
    got = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, "some words")], "item_id long, text string"))
    got = Counter(tuple(x) for x in got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect())
    assert got == resample_slowly(rows, ["some words"])
    assert sorted(x[5] for x in got.elements() if x[5]) == list(range(1, 301))


def test_resampling_empty_tables(spark, rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(frame(spark, rows).where("false"), none).count() == 0
    got = resampling.resample(frame(spark, rows), none).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
    assert Counter(tuple(x) for x in got) == resample_slowly(rows, [])


def test_resampling_features():
    words = resampling.words_of("A bé 7-x".encode())
    assert words == [b"a", "bé".encode(), b"7", b"x"]
    assert list(resampling.features_of(words, 1000)) == [zlib.crc32(x) % 1000 for x in [*words, *(a + b" " + b for a, b in zip(words, words[1:]))]]
    assert len(resampling.features_of([], 10)) == 0 and len(resampling.features_of([b"a"], 10)) == 1


# line deduplication


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)


def drop_slowly(rows, least, min_chars=1):
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if len(k) >= min_chars)
    out = []
    for i, t in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if len(key(x)) < min_chars or seen[key(x)] < least]
        out.append((i, len(every), len(every) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.fixture(scope="module")
def lined():
    r = random.Random(4)
    common = ["Read more", "  read MORE\t", "ÉTÉ", "été", "© 2020 All rights reserved", "", " ", "\x0bx\r"]
    rows = [(i, "\n".join(r.choice(common) if r.random() < 0.3 else f"line {r.randrange(60)} {r.choice('aB')}" for _ in range(r.randrange(12)))) for i in range(160)]
    rows += [(200 + i, "hot\nHOT \nbody") for i in range(90)] + [(None, None), (None, "Read more"), (5, "Read more\nRead more"), (7, ""), (8, "\n\n"), (9, "l\n" * 30_000)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("least", [1, 2, 10, 1000])
def test_lines_match_brute_force(spark, lined, least):
    got = lines.drop(frame(spark, lined), least=least)
    assert Counter(map(tuple, got.collect())) == drop_slowly(lined, least)


@pytest.mark.parametrize("parts,fanout", [(1, 3), (7, 2), (11, 3)])
def test_batches_find_the_same_lines(spark, lined, parts, fanout):
    batches = [frame(spark, lined[i::parts]) for i in range(parts)]
    got = lines.drop(frame(spark, lined), batches, least=10, fanout=fanout)
    assert Counter(map(tuple, got.collect())) == drop_slowly(lined, 10)
    got = lines.drop(frame(spark, lined), batches, least=6, min_chars=5, fanout=fanout)
    assert Counter(map(tuple, got.collect())) == drop_slowly(lined, 6, 5)


def test_runs_are_levelled_sorted_and_settled(spark, lined):
    runs = lines.Runs(spark, least=10, fanout=2)
    seen, open_rows = [], 0
    for i in range(7):
        batch = lines.document_keys(frame(spark, lined[i::7])).cache()
        settled = {(x.hi, x.lo) for run in runs.tables() for x in run.where("n >= 10").collect()}
        fresh = runs.unsettled(batch)
        assert {(x.hi, x.lo) for x in fresh.collect()} == {(x.hi, x.lo) for x in batch.collect()} - settled
        open_rows += len(settled)
        runs.add(batch)
        seen.append([len(level) for level in runs.levels])
    # two runs of a level become one of the next, as a binary counter
    assert seen == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1], [0, 1, 1], [1, 1, 1]] and open_rows
    run = spark.table(runs.levels[2][0][0])
    path = run.inputFiles()
    assert all(list(p) == sorted(p) for p in ([(x.hi, x.lo) for x in spark.read.parquet(f).collect()] for f in path))
    plan = run.join(runs.tables()[0], ["hi", "lo"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan  # a run meets a run where it lies
    true = Counter(k for _, t in lined for k in {key(x) for x in (t or '').split('\n')} - {''})
    assert sum(min(n, 10) for n in true.values()) == sum(min(x.n, 10) for x in runs.totals().collect()) and runs.totals().count() == len(true)
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lodestar_run_")]


def test_lines_of_earlier_batches_are_left_out(spark):
    """least=1: what comes through is new."""
    runs = lines.Runs(spark, least=1)
    one, two = (lines.document_keys(spark.createDataFrame([(t,)], "text string")) for t in ("a\nb", "b\nc\nC"))
    runs.add(one)
    assert [(x.hi, x.lo) for x in runs.unsettled(two).collect()] == [(x.hi, x.lo) for x in lines.document_keys(spark.createDataFrame([("c",)], "text string")).collect()]
    runs.close()


def test_cleaned_keeps_columns_and_empty_table(spark, lined):
    docs = frame(spark, lined).withColumn("kept", F.lit(1))
    got = lines.cleaned(docs, least=10)
    assert got.columns == docs.columns and got.schema.simpleString() == docs.schema.simpleString()
    slow = Counter()
    for (i, _, _, t), n in drop_slowly(lined, 10).items():
        slow[i, t] += n
    assert Counter((x.doc_id, x.text) for x in got.collect()) == slow
    assert lines.drop(docs.where("false")).count() == 0


def test_files_are_dealt_to_batches(spark, lined, tmp_path):
    path = str(tmp_path / "docs.parquet")
    frame(spark, lined).write.parquet(path)
    docs = spark.read.parquet(path)
    parts = lines.by_files(docs, 2)
    assert len(parts) == 2 and sum(p.count() for p in parts) == len(lined)
    assert sorted(f for p in parts for f in p.inputFiles()) == sorted(docs.inputFiles())
