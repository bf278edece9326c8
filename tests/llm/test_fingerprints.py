"""Winnowing against a plain version of it."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpuswright.llm import fingerprints as fp


UNSPACED = "\u0e00-\u0e7f\u3040-\u30ff\u4e00-\u9fff"


def words(t):
    out = re.findall(rf"[{UNSPACED}]|[^\W_{UNSPACED}]+", (t or "").lower())
    return out or ([t] if t else [])


def plain(hashes, k, window):
    """(hash, position) chosen by the textbook: each window's least hash, the rightmost of equals."""
    if not hashes:
        return []
    grams = []
    if len(hashes) < k:
        total = 0
        for h in hashes:
            total = (total * fp.BASE + h) % fp.PRIME
        grams = [total]
    else:
        total = 0
        for i, h in enumerate(hashes):  # rolling: in with the new word, out with the old
            total = (total * fp.BASE + h - (hashes[i - k] * pow(fp.BASE, k, fp.PRIME) if i >= k else 0)) % fp.PRIME
            if i >= k - 1:
                grams.append(total)
    chosen = []
    for i in range(max(1, len(grams) - window + 1)):
        part = list(enumerate(grams[i : i + window], i))
        at, h = min(part, key=lambda x: (x[1], -x[0]))
        if (h, at) not in chosen:
            chosen.append((h, at))
    return chosen


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    out = [None, "", "a", "!!!", "a b c", "a b c d e", "same same same same same same same same same", "Äpfel ß  x\ty\nz q w e r t", "日本語の文はspaces無しで書く text 中文也是这样写的", "ไทย กขคงจฉ abc"]
    return out + [" ".join(r.choice("alpha beta gamma delta".split()) for _ in range(r.randint(1, 60))) for _ in range(40)]


def test_equals_textbook(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    word_hash = lambda ws: [r.h for r in spark.createDataFrame([(i, w) for i, w in enumerate(ws)], "i int, w string").select("i", F.pmod(F.xxhash64("w"), F.lit(fp.WORD_RANGE)).alias("h")).orderBy("i").collect()] if ws else []
    got = {r.id: r for r in fp.winnow(df, "text", "fp").select("id", fp.hashes(F.col("fp")).alias("h"), F.col("fp")).collect()}
    for i, t in enumerate(texts):
        chosen = [(v >> 32, (1 << 32) - 1 - (v & 0xFFFFFFFF)) for v in got[i].fp]
        assert chosen == plain(word_hash(words(t)), fp.K, fp.WINDOW), t


def test_match_guarantee(spark):
    r = random.Random(1)
    shared = " ".join(f"w{r.random()}" for _ in range(fp.K + fp.WINDOW - 1)).replace(".", "")
    df = spark.createDataFrame([(f"x y z {shared} q", f"{shared} other end")], "a string, b string")
    d = fp.winnow(fp.winnow(df, "a", "fa"), "b", "fb")
    assert d.select(F.size(F.array_intersect(fp.hashes(F.col("fa")), fp.hashes(F.col("fb"))))).first()[0] >= 1


def test_char_unit(spark):
    d = fp.winnow(spark.createDataFrame([("日本語日本語日本語日本語",)], "a string"), "a", "f", unit="char")
    assert d.select(F.size("f")).first()[0] >= 1


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_next_by_descending_key(spark, buckets):
    rows = [(5, "e"), (3, "c"), (9, None), (None, "n"), (3, "b"), (1, ""), (None, "m"), (7, "g")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, __x string")
    got = fp.with_next(df, "doc_id", "text", lambda d, lead: d.withColumn("after", lead("text")), buckets).select("doc_id", "text", "after").collect()
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), x[1] is not None, x[1]))
    wanted = [(a, t, order[(i + 1) % len(order)][1]) for i, (a, t) in enumerate(order)]
    assert sorted(map(tuple, got), key=str) == sorted(wanted, key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert fp.with_next(df, "doc_id", "text", lambda d, lead: d.withColumn("after", lead("text"))).count() == 0


def plain_fingerprint(spark, texts):
    """text: its chosen (hash, position) pairs, by the textbook version over the engine's word residues."""
    vocabulary = sorted({w for t in texts for w in words(t)})
    residue = {r.w: r.h for r in spark.createDataFrame([(w,) for w in vocabulary], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(fp.WORD_RANGE)).alias("h")).collect()}
    return {t: plain([residue[w] for w in words(t)], fp.K, fp.WINDOW) for t in set(texts)}


def test_query_equals_plain_version(spark, sf):
    got = {r.doc_id: r for r in fp.op1_query(spark, sf).collect()}
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), reverse=True)
    assert set(got) == {i for i, _ in docs}
    edits = []
    for n, (_, t) in enumerate(docs):
        other, half = docs[(n + 1) % len(docs)][1], len(t) // 2
        edits.append(t[: len(t) - half] + other[:half])
    # Java's and Python's classes of letters differ in marks: compare texts where both find the same words.
    prints = plain_fingerprint(spark, [t for _, t in docs] + edits)
    likeness = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    own = lambda t: {h for h, _ in prints[t]}
    for n, (i, t) in enumerate(docs):
        r, e, other = got[i], edits[n], docs[(n + 1) % len(docs)][1]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        for s, x in ((r.fingerprint, t), (r.edited_fingerprint, e)):
            assert s == " ".join(str((h << 32) + (1 << 32) - 1 - at) for h, at in prints[x]), i
        assert abs(r.near_edited - likeness(own(t), own(e))) < 1e-12 and abs(r.near_next - likeness(own(t), own(other))) < 1e-12


def test_small_edits_stay_near_without_spaces(spark):
    r = random.Random(5)
    t = "".join(chr(r.randint(0x4E00, 0x4FFF)) for _ in range(300))
    d = fp.winnow(fp.winnow(spark.createDataFrame([(t, t[:150] + "字" + t[151:])], "a string, b string"), "a", "fa"), "b", "fb")
    assert d.select(fp.likeness(fp.hashes(F.col("fa")), fp.hashes(F.col("fb")))).first()[0] > 0.9


def test_many_buckets_are_one_literal(spark):
    df = spark.createDataFrame([(i, "x") for i in range(3000)], "doc_id long, text string")
    d = fp.with_next(df, "doc_id", "text", lambda d, lead: d.withColumn("after", lead("doc_id")), 2000)
    assert all(r.after == (r.doc_id - 1) % 3000 for r in d.collect())
    assert str(d._jdf.queryExecution().analyzed().toString()).count("lit") < 500


def test_very_long_repeated_and_clashing(spark):
    rows = [(1, "word other " * 60_000, "a"), (1, "word other " * 60_000, "b"), (2, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp_b string")
    got = fp.with_next(fp.winnow(df, "text", "f"), "doc_id", "text", lambda d, lead: d.withColumn("after", lead("doc_id"))).collect()
    assert sorted(r.after for r in got) == [1, 1, 2] and len({str(r.f) for r in got if r.doc_id == 1}) == 1 and sorted(r.fp_b or "" for r in got) == ["", "a", "b"]
