import zlib

import numpy as np
import pytest

from lodestar.llm import packing, token_counts, tokens

SCHEMA = "doc_id long, text string"
TEXTS = ["", None, "a", "hello world", "word " * 900, "é ñ ß €\n\n" * 300, "<|endoftext|> in a text", "x" * 5000, " " * 3000, "hello world", "\x00\t "]


@pytest.fixture(scope="module")
def exact():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_paths()[0])


def test_ids_are_the_tokenizers(exact):
    paths = tokens.default_paths()
    for t in TEXTS:
        assert tokens.encode(t or "", *paths).tolist() == exact.encode(t or "", add_special_tokens=False).ids
    assert 50256 in tokens.encode(TEXTS[6], *paths)
    assert 50256 not in tokens.encode(TEXTS[6], *paths, special=False)


def test_pieces_round_trip(spark, exact):
    df = spark.createDataFrame(list(enumerate(TEXTS)), SCHEMA)
    got = packing.pack(df, 64, 1, with_ids=True).collect()
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    for d, t in enumerate(TEXTS):
        mine = sorted((r for r in got if r.doc_id == d), key=lambda r: r.start)
        ids = [i for r in mine for i in r.ids]
        assert ids == exact.encode(t or "", add_special_tokens=False).ids + [1]
        assert all(r.length & (r.length - 1) == 0 and r.length <= 64 and r.offset == 0 and r.doc_tokens == len(ids) for r in mine)
        assert [r.start for r in mine] == np.cumsum([0] + [r.length for r in mine])[:-1].tolist()
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in mine)
    by = sorted(got, key=lambda r: r.sequence_id)
    assert [r.length for r in by] == sorted(r.length for r in by)  # buckets one after the other


def test_lengths():
    for n in range(1, 700):
        x = packing.binary_lengths(n, 128)
        assert sum(x) == n and all(v & (v - 1) == 0 and v <= 128 for v in x) and x == sorted(x, reverse=True)
        assert len(set(v for v in x if v < 128)) == len([v for v in x if v < 128])


def test_empty_and_clashing_names(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "a b", "x", 3)], "doc_id long, text string, start string, bucket int")
    assert packing.pack(df).count() == 2


def test_token_counts(spark, exact):
    df = spark.createDataFrame([(None if i == 3 else i, t) for i, t in enumerate(TEXTS)], SCHEMA).repartition(3)
    for slab in (7, 64, 1 << 16):
        got = token_counts.document_counts(df, slab=slab).collect()
        exact.encode_special_tokens = True
        want = sorted(len(exact.encode(t or "", add_special_tokens=False).ids) for t in TEXTS)
        exact.encode_special_tokens = False
        assert sorted(r.n_tokens for r in got) == want
        by_doc = {r.doc_id: r.n_tokens for r in got}
        assert by_doc[2] == 1 and by_doc[0] == 0 and None in by_doc


def test_separators_and_open_tail(spark):
    stream = [5, 9, 9, 1, 2, 3, 9, 4, 4]
    slabs = [(0, i, np.array(stream[i * 4 : i * 4 + 4], "<u2").tobytes()) for i in range(3)]
    got = token_counts.count_tokens(spark.createDataFrame(slabs, "file int, slab long, ids binary"), end_id=9, slab=4)
    assert sorted(tuple(r) for r in got.select("ordinal", "start", "n_tokens", "closed").collect()) == [(0, 0, 1, True), (1, 2, 0, True), (2, 3, 3, True), (3, 7, 2, False)]
