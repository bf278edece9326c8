"""Suffix sorting and removal of repeated strings against brute force."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest

from corpuswright.llm import substrings as s


@pytest.mark.parametrize("seed", range(40))
def test_suffixes_in_order(seed):
    r = random.Random(seed)
    t = bytes(r.choice(b"abc" if seed % 2 else b"ab") for _ in range(r.randint(0, 80)))
    a = np.frombuffer(t, np.uint8)
    order = s.two_stage(a)
    assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
    lcp = [len(os.path.commonprefix([t[i:], t[j:]])) for i, j in zip(order[:-1], order[1:], strict=True)]
    assert s.common_prefixes(a, order, 7).tolist() == [0] * bool(t) + [min(7, x) for x in lcp]
    keep = np.array([r.random() < 0.4 for _ in t], bool)
    if t:
        some = s.two_stage(a, keep, 100)
        assert some[keep[some]].tolist() == sorted(np.flatnonzero(keep).tolist(), key=lambda i: t[i:])


def brute(texts, match):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + match] for b in data for i in range(len(b) - match + 1))
    out = []
    for b in data:
        covered = bytearray(len(b))
        for i in range(len(b) - match + 1):
            if seen[b[i : i + match]] > 1:
                covered[i : i + match] = b"\1" * match
        kept = bytes(x for x, y in zip(b, covered, strict=True) if not y)
        out.append((len(b), sum(covered), sum(1 for i in range(len(b)) if covered[i] and (i == 0 or not covered[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(9)
    word = lambda: "".join(r.choice("etaoinshr") for _ in range(r.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    common = text(90)
    out = [None, "", "short", "é" * 600, "ab" * 900, "x" * 400, "x" * 399]
    out += [text(40) + common + text(30) for _ in range(12)]
    whole = text(150)
    out += [whole, whole, whole[:500] + "!" + whole[500:], text(200), common[:399], common[:400], whole + whole]
    return list(enumerate(out))


@pytest.mark.parametrize(("match", "contexts"), [(400, 2048), (400, 2), (400, 1), (128, 3), (65, 1)])
def test_removed_equals_brute_force(spark, rows, monkeypatch, match, contexts):
    monkeypatch.setattr(s, "CONTEXTS", contexts)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, name int")
    out = s.removed(df, match=match).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out}
    assert got == dict(zip([i for i, _ in rows], brute([t for _, t in rows], match), strict=True))
    texts = dict(rows)
    for r in out:
        data, done, kept = (texts[r.doc_id] or "").encode(), 0, ""
        for a, z in [*zip(r["from"], r["to"], strict=True), (len(data), len(data))]:
            kept += data[done:a].decode("utf-8", "ignore")
            done = z
        assert r.text == kept


def test_hot_anchor(spark, monkeypatch):
    """One passage in many texts, some of them cut near either end: far more contexts than are sorted together."""
    monkeypatch.setattr(s, "CONTEXTS", 8)
    monkeypatch.setattr(s, "HELD", 50)
    r = random.Random(4)
    noise = lambda n: "".join(r.choice("etaoinshr dlu") for _ in range(n))
    passage = noise(900)
    texts = [noise(r.randint(0, 300)) + passage[r.choice([0, 0, 3, 200]) : r.choice([900, 900, 899, 650])] + noise(r.randint(0, 300)) for _ in range(150)]
    texts += texts[:30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in s.removed(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 400)


def test_repeated_rows_and_ids(spark):
    t = "".join(random.Random(3).choice("abcdefgh ") for _ in range(700))
    df = spark.createDataFrame([(1, t), (1, t), (1, "other " * 100), (None, t[:450])], "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed) for r in s.removed(df).collect())
    assert got == [(450, 450), (600, 600), (700, 700), (700, 700)]


def test_text_keeps_whole_characters(spark):
    shared = "".join(random.Random(5).choice("éàüßø") for _ in range(300))
    df = spark.createDataFrame([(1, "ä" + shared + "ö", "k"), (2, "ë" + shared + "ï", "k"), (3, "clean", None), (4, None, None)], "doc_id long, text string, at string")
    got = {r.doc_id: r.text for r in s.without_repeats(df).collect()}
    assert got[1] == "äö" and got[2] == "ëï" and got[3] == "clean" and got[4] is None
    assert s.without_repeats(df.limit(0)).count() == 0


def test_planted_passages_and_clean_texts(spark):
    """Passages of 51 to 90 words in two texts each: those of 400 bytes go whole, shorter ones stay, as the contract has it; clean texts are left alone. n_bytes is the input's length in all cases."""
    r = random.Random(21)
    text = lambda n: " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 10))) for _ in range(n))
    rows, planted = [], []
    for i in range(40):
        passage = text(51 + i)
        planted.append(passage)
        for _ in range(2):
            rows.append((len(rows), f"{text(60)}\n{passage}\n{text(60)}"))
    clean = [(len(rows) + i, text(150)) for i in range(40)]
    got = {x.doc_id: x for x in s.removed(spark.createDataFrame(rows + clean, "doc_id long, text string")).collect()}
    long = [len(p) >= 400 for p in planted]
    assert 5 < sum(long) < 40
    for i, t in rows:
        p = planted[i // 2]
        assert (p in got[i].text) is (not long[i // 2])
        assert got[i].n_removed >= len(p) if long[i // 2] else got[i].n_removed == 0
        assert got[i].n_bytes == len(t)
    for i, t in clean:
        assert (got[i].n_removed, got[i].n_spans, got[i].text) == (0, 0, t)
        assert got[i].kept_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_query_returns_the_contract(spark, rows, tmp_path):
    """The query itself: the contract's columns in their order, at 400 bytes, then the kept text."""
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = s.op3_query(spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string"), ("text", "string")]
    got = {r.doc_id: tuple(r)[1:5] for r in out.collect()}
    assert [got[i] for i, _ in rows] == brute([t for _, t in rows], 400)
