"""Language identification: held-out accuracy, exact marginals, code-switched text, odd rows."""

import dataclasses
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuswright.llm import langid
from corpuswright.llm.words import Words


@pytest.fixture(scope="module")
def model(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    return langid.fit(docs, where=~langid.held_out(), sample=60)


@pytest.mark.parametrize("block", [64, 2, 1])
def test_marginals_equal_enumeration(monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK", block)
    rng = np.random.default_rng(2)
    e, trans, start = rng.normal(size=(5, 3)).astype(np.float32), rng.normal(size=(3, 3)).astype(np.float32), rng.normal(size=3).astype(np.float32)
    p, pairs = langid.forward_backward(e, np.array([0, 3]), np.array([3, 2]), trans, start, pairs=True)
    wanted, counts = np.zeros((5, 3)), np.zeros((3, 3))
    for first, n in ((0, 3), (3, 2)):
        weights = {}
        for y in itertools.product(range(3), repeat=n):
            s = start[y[0]] + sum(e[first + i, y[i]] for i in range(n)) + sum(trans[y[i - 1], y[i]] for i in range(1, n))
            weights[y] = np.exp(s)
        z = sum(weights.values())
        for y, v in weights.items():
            for i in range(n):
                wanted[first + i, y[i]] += v / z
            for i in range(1, n):
                counts[y[i - 1], y[i]] += v / z
    assert np.allclose(p, wanted, atol=1e-5) and np.allclose(pairs, counts, atol=1e-5)


def plain_buckets(word):
    """Of a word: its n-grams of 1 to 3 that end at each letter, and its prefixes and suffixes of 1 to 3, as buckets."""
    with np.errstate(over="ignore"):
        r = [langid._char_hash()[ord(c)] for c in word]

        def gram(end, n):
            total = r[end]
            for back, factor in ((1, 3), (2, 7)):
                total = total + r[end - back] * np.uint64(factor) if n > back else total
            return langid.mix(np.array([total])) if n > 1 else np.array([total])

        grams = [[int(langid._bucket(gram(i, n), n)[0]) for n in (1, 2, 3) if i + 1 >= n] for i in range(len(word))]
        affixes = [int(langid._bucket(gram(n - 1, n), 10 + n)[0]) for n in (1, 2, 3) if len(word) >= n]
        affixes += [int(langid._bucket(gram(len(word) - 1, n), 20 + n)[0]) for n in (1, 2, 3) if len(word) >= n]
    return grams, affixes


def plain_emission(m, word):
    grams, affixes = plain_buckets(word)
    h = Words([word], letters_only=True).hashes()[0]
    at = np.flatnonzero(m.lexicon == h)
    e = sum((m.weights[g].astype(float) for part in grams for g in part), np.zeros(len(m.langs))) / len(word)
    e += sum((m.weights[a].astype(float) for a in affixes), np.zeros(len(m.langs)))
    return e + m.lexicon_weights[m.lexicon_lang[at[0]] if len(at) else len(m.langs)]


def plain_marginals(m, words):
    """Forward-backward word by word, in logarithms, over the whole text."""
    e = [plain_emission(m, w) for w in words]
    logsum = lambda x: np.log(np.exp(x - x.max(0)).sum(0)) + x.max(0)
    alpha, beta = [m.start.astype(float) + e[0]], [np.zeros(len(m.langs))]
    for x in e[1:]:
        alpha.append(logsum(alpha[-1][:, None] + m.transitions) + x)
    for x in e[:0:-1]:
        beta.append(logsum((m.transitions + (x + beta[-1])[None, :]).T))
    total = [a + b for a, b in zip(alpha, beta[::-1], strict=True)]
    return np.array([np.exp(t - logsum(t)) for t in total]), logsum(alpha[-1])


def test_document_scores_equal_plain_version(spark, sf, model):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy(F.length("text").desc()).limit(40).collect() if r.text]
    texts = [*texts[:3], *texts[20:30], "a b " * 200, "Ünïcode wörds, l'été; 12 x9y"]
    found, score = langid._documents(model, texts)
    for t, lang, got in zip(texts, found, score, strict=True):
        p, _ = plain_marginals(model, re.findall(r"[^\W\d_]+", t.lower()))
        assert lang == model.langs[p.sum(0).argmax()] and abs(p.mean(0).max() - got) < 1e-3


def test_gradient_equals_differences(model):
    texts = ["the and house nicht über", "der die und with from this", "la le les une maison"]
    w = Words(texts, letters_only=True)
    at, affix = langid.features(w)
    lex = langid.lexicon_of(w.hashes(), model.lexicon, model.lexicon_lang, len(model.langs))
    gold = np.arange(len(w.doc)) % len(model.langs)
    batch = [np.flatnonzero(w.doc == i) for i in range(3)]
    words = [texts[i].split() for i in range(3)]

    def likelihood(m):
        total = 0.0
        for own, b in zip(words, batch, strict=True):
            y = gold[b]
            s = m.start[y[0]] + sum(plain_emission(m, x)[k] for x, k in zip(own, y, strict=True)) + sum(m.transitions[a, z] for a, z in zip(y[:-1], y[1:], strict=True))
            total += s - plain_marginals(m, own)[1]
        return total / 3

    parts = langid.gradient(model, w, at, affix, lex, gold, batch)
    rng = np.random.default_rng(0)
    for name, g in zip(("weights", "lexicon_weights", "transitions", "start"), parts, strict=True):
        some = np.argwhere(np.abs(g) > 1e-3)
        for i in map(tuple, some[rng.permutation(len(some))[:4]]):
            both = []
            for step in (0.01, -0.01):
                x = getattr(model, name).astype(np.float64)
                x[i] += step
                both.append(likelihood(dataclasses.replace(model, **{name: x})))
            assert abs((both[0] - both[1]) / 0.02 - g[i]) < 2e-3, name


def test_long_texts_are_one_chain():
    """A word's label hangs on all words before it, however far."""
    e = np.zeros((200, 3), np.float32)
    e[0, 1] = 9
    p, _ = langid.forward_backward(e, np.array([0]), np.array([200]), np.eye(3, dtype=np.float32) * 9, np.zeros(3, np.float32))
    assert p[-1].argmax() == 1 and p[-1, 1] > 0.9 and p[-1, 1] < p[64, 1] < p[1, 1]


def test_empty_table_and_clashing_columns(spark, model):
    df = spark.createDataFrame([(1, "the and with from this", "xx", "k", 2.0), (1, "the and with from this", None, "l", None), (2, None, "en", None, 1.0)], "doc_id long, text string, lang string, lang_pred string, __text double")
    assert sorted((r.lang, r.lang_pred) for r in langid.keep_known(df, model).collect()) == [("en", "k"), ("en", "l")]
    assert langid.predict(df.limit(0), model).count() == 0 and langid.keep_known(df.limit(0), model).count() == 0 and langid.fit(df.limit(0)) is None


def test_held_out_accuracy(spark, sf, model):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet").where(langid.held_out() & F.col("lang").isNotNull())
    rows = langid.predict(docs, model, keep=("doc_id", "lang")).collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.97


def test_code_switching(spark, model):
    docs = spark.createDataFrame([(1, "the and that with from this are was " * 3 + "nicht und der die eine schung keit über " * 3)], "doc_id long, text string")
    rows = sorted(langid.spans(docs, model).collect(), key=lambda r: r["from"])
    assert {"en", "de"} <= {r.lang for r in rows} and sum(r.n_words for r in rows) == 48 and rows[0].lang == "en" and rows[-1].lang == "de"


def test_odd_rows(spark, model):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 !?", None), (4, "the and " * 30_000, "x"), (4, "the and " * 30_000, "x"), (None, "the", "x")], "doc_id long, text string, score string")
    got = langid.predict(docs, model).collect()
    assert [(r.lang_pred, r.score) for r in got if r.doc_id in (1, 2, 3)] == [("und", 0.0)] * 3
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 4}) == 1 and len(got) == 6


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert langid.fit(docs) is None
    assert langid.predict(docs, None).first().lang_pred == "und"
    assert langid.keep_known(docs, None).count() == 0
