"""Near-duplicate classes against brute force over weighted Jaccard similarity."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from corpuswright.llm import neardup as n


def brute(texts, threshold=0.8):
    """Classes by all pairs, from words, shingles, document frequencies and weights of its own."""
    words = [re.findall(r"[^\W_]+", (t or "").lower()) for t in texts]
    counts = [Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter() for w in words]
    df = Counter(s for c in counts for s in c)
    sets = [{s: k * math.log(1 + len(texts) / df[s]) for s, k in c.items()} for c in counts]
    root = list(range(len(texts)))

    def top(x):
        return x if root[x] == x else top(root[x])

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            common = sum(min(v, b[k]) for k, v in a.items() if k in b)
            same = words[i] == words[j] if words[i] or words[j] else (texts[i] or "") == (texts[j] or "")
            if same or common and common >= threshold * (sum(a.values()) + sum(b.values()) - common) - 1e-9:
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return [top(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    text = lambda k: [f"w{r.randint(0, 5000)}" for _ in range(k)]
    out = [None, "", "!!!", "??", "one two", "One  two!", "one two three"]
    for size in (60, 300, 2000):
        base = text(size)
        for edits in (0, 0, 1, 2, size // 60, size // 20, size // 5):
            copy = list(base)
            for _ in range(edits):
                copy[r.randrange(size)] = "edited"
            out.append(" ".join(copy))
    out += [" ".join(text(100)) for _ in range(20)]
    return list(enumerate(out))


@pytest.mark.parametrize("chunk", [256, 3])
def test_classes_equal_brute_force(spark, rows, monkeypatch, chunk):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string")
    monkeypatch.setattr(n, "CHUNK_ROWS", chunk)
    got = {r.doc_id: r.class_id for r in n.classes(df).collect()}
    assert [got[i] for i, _ in rows] == brute([t for _, t in rows])


def test_weighted_samples_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(1)
    a = np.sort(rng.choice(1 << 40, 400, replace=False)).astype(np.uint64)
    w1, w2 = rng.gamma(2, 1, 400), rng.gamma(2, 1, 400)
    lnw = np.log(np.concatenate([w1, w2])).astype(np.float32)
    s = n.samples(np.repeat([0, 1], 400), np.concatenate([a, a]), lnw, 2, 3000)
    alike = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
    assert abs((s[0] == s[1]).mean() - alike) < 0.04


def test_keep_first(spark):
    df = spark.createDataFrame([(3, "a b c d e f g", "x"), (2, "A b c d e f g!", "y"), (2, "A b c d e f g!", "y"), (9, "other words stand here now", "z"), (None, None, None), (None, "a null key", "n"), (9, "the same key again", "k")], "doc_id long, text string, class_id string")
    assert sorted(r.class_id or "" for r in n.keep_first(df).collect()) == ["", "k", "n", "y", "z"]
    assert n.classes(df.limit(0)).count() == 0


def test_nodes_of_one_key_meet_across_chunks(spark, monkeypatch):
    """Copies of copies: neighbours in a chain are alike, but few are like the node that leads a key's chunks."""
    r = random.Random(11)
    out = []
    for _ in range(3):
        words = [f"w{r.randint(0, 5000)}" for _ in range(120)]
        for step in range(14):
            words[8 * step] = f"edit{r.randint(0, 10**6)}"
            out.append(" ".join(words))
    rows = list(enumerate(out))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = brute(out)
    for chunk in (2, 3, 5):
        monkeypatch.setattr(n, "CHUNK_ROWS", chunk)
        got = {x.doc_id: x.class_id for x in n.classes(df).collect()}
        assert [got[i] for i, _ in rows] == wanted


def test_every_shingle_has_its_document_frequency(spark, monkeypatch):
    """A passage in 4 of 1,004 documents weighs less than text found once, though it is in fewer than 1 % of them."""
    r = random.Random(4)
    text = lambda k: " ".join(f"w{r.randint(0, 10**6)}" for _ in range(k))
    passage = text(104)
    rows = [(i, text(12)) for i in range(1000)] + [(1000 + i, passage + " " + text(11)) for i in range(4)] + [(1000, None), (2000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for name, size in (("ASKING", 5000), ("COUNTING", 9000), ("ASKED", 50)):
        monkeypatch.setattr(n, name, size)
    sig, total = n.signatures(df, "doc_id", "text")
    assert total == len(rows)
    texts = [t for _, t in rows]
    doc, sh, count, w, h = n.counted_shingles(texts)
    values, at, seen = np.unique(sh, return_inverse=True, return_counts=True)
    names = n.nodes(texts, w, h)
    wanted = {names[i]: seen[at[doc == i]].tolist() for i in range(len(texts))}
    assert {bytes(x.node): np.frombuffer(x.df, "<u4").tolist() for x in sig.collect()} == wanted
    # Equal weights make these 0.82 alike, true ones 0.78.
    got = {x.doc_id: x.class_id for x in n.classes(df.where("text is not null and doc_id >= 0")).collect()}
    assert all(got[i] == i for i in range(1004))


def test_pairs_in_one_hot_key(spark, monkeypatch):
    """Pairs that are alike among nodes that all share a long passage: none is lost, though the key takes many chunks."""
    monkeypatch.setattr(n, "CHUNK_ROWS", 32)
    r = random.Random(6)
    text = lambda k: [f"w{r.randint(0, 10**6)}" for _ in range(k)]
    passage, rows = text(600), []
    for i in range(128):
        own = passage + text(260)
        other = own[:-30] + text(30)
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(other))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in n.classes(df).collect()}
    assert [got[i] for i, _ in rows] == brute([t for _, t in rows])
    assert all(got[2 * i + 1] == 2 * i for i in range(128))


def test_very_long_and_repeated_rows(spark):
    r = random.Random(1)
    long = " ".join(f"w{r.randint(0, 10**5)}" for _ in range(120_000))
    df = spark.createDataFrame([(1, long, "x"), (1, long, "y"), (2, long + " tail of it", None), (3, long[: len(long) // 2], None), (None, "n", "z")], "doc_id long, text string, label string")
    assert sorted(map(tuple, n.classes(df).collect()), key=str) == [(1, 1, 3), (1, 1, 3), (2, 1, 3), (3, 3, 1), (None, None, 1)]


def test_copies_count_once(spark, monkeypatch):
    """Near copies in a large group of exact copies: the copies don't make the shared words weigh less than the edits."""
    r = random.Random(8)
    text = lambda k: [f"w{r.randint(0, 10**6)}" for _ in range(k)]
    base = text(120)
    near = []
    for i in range(2):
        words = list(base)
        words[40 + 40 * i] = "edit"
        words[60 + 30 * i] = "other"
        near.append(" ".join(words))
    different = [" ".join(base), *near, *(" ".join(text(12)) for _ in range(200))]
    rows = list(enumerate([*different, *[different[0]] * 300]))
    monkeypatch.setattr(n, "ASKING", 20_000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x.doc_id: x.class_id for x in n.classes(df).collect()}
    assert [got[i] for i, _ in rows[: len(different)]] == brute(different)
    assert got[1] == got[2] == 0 and all(got[i] == 0 for i in range(len(different), len(rows)))


def test_texts_are_dealt_once_for_all_meetings(spark, monkeypatch, tmp_path):
    """Keys that take several chunks, and rows that share a doc_id: the whole table is read once to compare, both rounds take the members' texts from there."""
    r = random.Random(12)
    out = []
    for _ in range(3):
        words = [f"w{r.randint(0, 5000)}" for _ in range(120)]
        for step in range(14):
            words[8 * step] = f"edit{r.randint(0, 10**6)}"
            out.append(" ".join(words))
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(out)), "doc_id long, text string").write.parquet(path)
    read, written = [], n.written

    def seen(df, name, *a, **b):
        read.append((name, any("documents.parquet" in f for f in df.inputFiles())))
        return written(df, name, *a, **b)

    monkeypatch.setattr(n, "CHUNK_ROWS", 3)
    monkeypatch.setattr(n, "written", seen)
    got = {x.doc_id: x.class_id for x in n.classes(spark.read.parquet(path)).collect()}
    assert [got[i] for i in range(len(out))] == brute(out)
    names = [name for name, _ in read]
    assert names.count("links") == 2  # keys in several chunks met again
    assert sum(whole for _, whole in read[names.index("members") :]) == 1
    # Of rows that share a doc_id, each node has its own text.
    ids, of = [7 if i < 28 else i for i in range(len(out))], brute(out)
    same = spark.createDataFrame(list(zip(ids, out, strict=True)), "doc_id long, text string")
    assert sorted(x.class_id for x in n.classes(same).collect()) == sorted(min(i for i, d in zip(ids, of, strict=True) if d == c) for c in of)
