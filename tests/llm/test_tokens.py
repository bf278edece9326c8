"""Cached encoding, packing, and the token store: exact against the library and plain versions."""

import random
import zlib

import numpy as np
import pytest

from corpuswright.llm import packing, token_store
from corpuswright.llm.store import new_dir, qualified
from corpuswright.llm.tokens import Encoder, default_path

ODD = ["", None, "It's I'LL DON'T 'St o'clock", "İstanbul ﬁ ÀÉ́ ǅ", "a\x1cb\x85c\xa0d", "<|endoftext|> x", "日本語 text", "ªº²³¼ ſ's ȺȾ", "x" * 3000, "1234 56.78 --- !!!", "ẞtraße ΑΣ Σ", "ŉ ǰ", "“quoted” — dash…"]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(default_path())


def ids(encoder, text):
    return encoder.library.encode(text, add_special_tokens=False).ids if text else []


def test_encoder_equals_library(encoder):
    assert encoder.known
    r = random.Random(1)
    points = [*range(32, 127), *range(0xA1, 0x300), *[0x27] * 30, *[0x20] * 100]
    for t in ODD + ["".join(chr(r.choice(points)) for _ in range(200)) for _ in range(200)]:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == ids(encoder, t), t


def test_best_fit_is_the_tightest():
    r = random.Random(2)
    for _ in range(100):
        lengths = sorted((r.randint(1, 50) for _ in range(r.randint(0, 90))), reverse=True)
        where, offset, count = packing.best_fit_decreasing(lengths, 50)
        room = []
        for n, s, o in zip(lengths, where, offset, strict=True):
            fits = [x for x in room if x >= n]
            if fits:
                assert room[s] == min(fits) and o == 50 - room[s]
                room[s] -= n
            else:
                assert s == len(room) and o == 0
                room.append(50 - n)
        assert len(room) == count


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    return [(i, t, "x") for i, t in enumerate(ODD)] + [(100 + i, "word and other " * r.randint(1, 1500), "y") for i in range(40)] + [(100, "a second text", "z"), (None, "no key", "z"), (7, ODD[7], "x")]


def test_packing(spark, encoder, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, offset string")
    from corpuswright.llm.store import written

    got = packing.pack(written(packing.cut(df), "pieces")[0]).collect()
    wanted = []
    for i, t, _ in rows:
        own = [*ids(encoder, t), 0]
        for n in range(0, len(own), 2048):
            part = own[n : n + 2048]
            wanted.append((i, n // 2048, n, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(wanted, key=str)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert len(sequences) == packing.best_fit_decreasing(sorted((w[3] for w in wanted), reverse=True), 2048)[2]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 500, 3000])
def test_index_is_perfect_and_minimal(n):
    keys = np.unique(np.random.default_rng(n).integers(-(2**62), 2**62, n))
    seeds, slots = token_store.build_index(keys)
    assert sorted(slots) == list(range(len(keys)))
    if n:
        assert (token_store.find_slots(keys, seeds, len(keys)) == slots).all()
        index = token_store.Index(token_store.index_bytes(keys, np.arange(len(keys) + 1) * 3, 2))
        assert (index.find(keys) >= 0).all()
        assert (index.find(keys + 2**62 + 1) < 0).mean() > 0.99


def test_store_round_trip(spark, encoder, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, h string")
    folder = qualified(spark, new_dir(spark, "test"))
    shards = token_store.write(df, folder)
    got = token_store.read(df.select("doc_id"), shards, folder, with_ids=True).collect()
    assert len(got) == len(rows)
    wanted = sorted((i is not None, i or 0, [*ids(encoder, t), 2]) for i, t, _ in rows)
    mine = sorted(got, key=lambda r: r.start)
    at = 0
    for r in mine:
        own = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == at and r.n_tokens == len(own) and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        at += len(own)
    assert sorted((r.doc_id is not None, r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == wanted
    assert [r.doc_id for r in mine] == sorted((r.doc_id for r in got), key=lambda x: (x is not None, x or 0))
    foreign = spark.createDataFrame([(10**12,)], "doc_id long")
    assert token_store.read(foreign, shards, folder).count() == 0


def test_empty_tables(spark):
    from corpuswright.llm.store import written

    df = spark.createDataFrame([], "doc_id long, text string")
    folder = qualified(spark, new_dir(spark, "test"))
    assert token_store.read(df.select("doc_id"), token_store.write(df, folder), folder).count() == 0
    assert packing.pack(written(packing.cut(df), "pieces")[0]).count() == 0
