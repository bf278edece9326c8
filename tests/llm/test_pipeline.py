"""The pipeline's stages on planted rows."""

import random
import re
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from corpuswright.llm.store import written


def test_stages(spark, sf, tmp_path):
    r = random.Random(8)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    schema = docs.schema
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    base = [x for x in docs.where("lang = 'en'").orderBy("doc_id").collect() if 200 < len(x.text.split()) < 400]
    words = " ".join(base[0].text.split())
    passage = " ".join(f"passage{r.randint(0, 99)}" for _ in range(60))
    planted = [
        (90001, words, "en", "p", len(words)),
        (90002, words.replace(" of ", " Of, ", 1), "en", "p", 0),
        (90003, "\n".join(["the and that with this from are was"] * 3) + "\n" + bench, "en", "p", 0),
        (90004, "the that and " + passage + " which are was for the", "en", "p", 0),
        (90005, "and this with " + passage + " from that for are", "en", "p", 0),
        (90006, "12345 !!! 678", None, "p", 0),
        (90007, None, None, None, None),
    ]
    df = docs.unionByName(spark.createDataFrame(planted, schema))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        df, _ = written(stage(spark, df, sf), name)
        kept[name] = {x.doc_id for x in df.collect()}
        if name != "best_fit_packing":
            assert df.columns == docs.columns
        if name == "suffix_dedup":
            texts = {x.doc_id: x for x in df.collect()}
            assert passage not in texts[90004].text and passage not in texts[90005].text
            assert all(x.n_chars == len(x.text) for x in texts.values())
    assert {90006, 90007}.isdisjoint(kept["language_id"]) and 90001 in kept["language_id"]
    assert {90001, 90002}.isdisjoint(kept["minhash_neardup"])
    assert 90003 not in kept["decontamination"]
    assert kept["best_fit_packing"] == kept["decontamination"]


def plain_passages(texts, match):
    """Texts less the characters that lie wholly in a string of match bytes that starts twice; None: nothing is left of it."""
    data = [t.encode() for t in texts]
    seen = Counter(b[i : i + match] for b in data for i in range(len(b) - match + 1))
    out = []
    for b, t in zip(data, texts, strict=True):
        covered = bytearray(len(b))
        for i in range(len(b) - match + 1):
            if seen[b[i : i + match]] > 1:
                covered[i : i + match] = b"\1" * match
        kept, at = "", 0
        for c in t:
            n = len(c.encode())
            kept += "" if all(covered[at : at + n]) else c
            at += n
        out.append(kept if kept or not t else None)
    return out


def plain_items(text, items):
    def grams(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    own = grams(text)
    return any(g and len(g & own) >= 0.8 * len(g) for g in map(grams, items))


def test_stages_equal_plain_versions(spark, sf):
    from corpuswright.llm import langid
    from test_neardup import brute

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted(map(tuple, df.collect()))
    text_at, id_at, n_at = columns.index("text"), columns.index("doc_id"), columns.index("n_chars")

    spoken, _ = written(stages["language_id"](spark, docs, sf), "t")
    found, score = langid._documents(langid.fit(docs), [r.text for r in docs.orderBy("doc_id").collect()])
    wanted = {r.doc_id: lang for r, lang, s in zip(docs.orderBy("doc_id").collect(), found, score, strict=True) if lang != "und" and s >= 0.5}
    assert {r.doc_id: r.lang for r in spoken.collect()} == wanted

    unique, _ = written(stages["minhash_neardup"](spark, spoken, sf), "t")
    before = rows(spoken)
    classes = brute([r[text_at] for r in before])
    first = {}
    for i, c in enumerate(classes):
        first[c] = min(first.get(c, before[i][id_at]), before[i][id_at])
    assert {r[id_at] for r in rows(unique)} == set(first.values())

    cut, _ = written(stages["suffix_dedup"](spark, unique, sf), "t")
    before = rows(unique)
    wanted = {r[id_at]: t for r, t in zip(before, plain_passages([r[text_at] for r in before], corpus_pipeline.PASSAGE), strict=True) if t is not None}
    assert {r[id_at]: r[text_at] for r in rows(cut)} == wanted and all(r[n_at] == len(r[text_at]) for r in rows(cut))

    clean, _ = written(stages["decontamination"](spark, cut, sf), "t")
    assert rows(clean) == [r for r in rows(cut) if not plain_items(r[text_at], items)]

    packed = stages["best_fit_packing"](spark, clean, sf).collect()
    by_sequence = {}
    for p in packed:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in by_sequence.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048
    starts = {}
    for p in sorted(packed, key=lambda p: (p.doc_id, p.piece)):
        assert p.start == starts.get(p.doc_id, 0)
        starts[p.doc_id] = p.start + p.length
    assert set(starts) == {r[id_at] for r in rows(clean)}


def test_odd_tables(spark, sf):
    """Nothing, repeated rows, null keys and further columns of clashing names, in every stage."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = "the and that with from this are was " * 9
    r = random.Random(3)
    rows = [(1, text, "en", "s", len(text), "a"), (1, text, "en", "s", len(text), "a"), (None, "this and that are from the " + " ".join(f"w{r.randint(0, 99)}" for _ in range(20)), None, None, None, None), (None, None, None, None, None, "n"), (3, "", "en", "s", 0, "e")]
    odd = spark.createDataFrame(rows, docs.selectExpr("doc_id", "text", "lang", "source", "n_chars", "cast(null as string) as at").schema)
    model_docs = docs.withColumn("at", F.lit(None).cast("string")).select(odd.columns)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
        for extra in ("at", "id", "node", "__x"):
            df = (model_docs.unionByName(odd) if name == "language_id" else odd).withColumnRenamed("at", extra)
            out, _ = written(stage(spark, df, sf), "t")
            if name != "best_fit_packing":
                assert out.columns == df.columns
            n = out.count()
            if name in ("decontamination",):
                assert n == len(rows)
            elif name == "suffix_dedup":
                assert n == 3, "the repeated row repeats itself and goes"
            elif name == "minhash_neardup":
                assert n == 3, "one of the repeated rows, the null key, one of the empty texts"
            elif name == "best_fit_packing":
                assert n == len(rows) and out.agg(F.sum("length")).first()[0] > len(rows)
