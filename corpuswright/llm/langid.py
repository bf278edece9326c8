"""Language identification by a linear-chain conditional random field over words.

Each word (a run of letters, lower-cased) has features: its character n-grams
of 1 to 3, its prefixes and suffixes of 1 to 3, and the languages whose lexicon
it stands in.  Weights of features and of transitions between neighbouring
labels are learned together by gradient descent on the conditional likelihood;
forward-backward gives every word's label probabilities, so text that switches
between languages is labelled word by word.  A document's language is the label
with the largest sum of its words' probabilities, its score that sum's share.

A chain is a whole text, whatever its length.  It is worked off in blocks of
``BLOCK`` words side by side: each block's product of transitions and emissions
carries the probabilities over its borders, forward and backward, so that the
blocks change the order of the sums and not their values.  Only training takes a
bounded sample: about ``SAMPLE`` documents of each language, ``WINDOWS`` runs of
``RUN`` words from each, chosen by hash; half the chains are joined from two
languages, so that transitions are learned from switches too.

Defined results: null text, text without a letter, or a corpus without labelled
text (an empty table, too) gives ``und`` with score 0; ties go to the first
language in sorted order; equal texts get equal results, repeated rows each
theirs; very long texts are labelled whole, with memory in proportion; extra
columns are ignored (``keep_known`` keeps them), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswright.llm.store import lean
from corpuswright.llm.words import Words, _char_hash, mix, pieces

RUN = 64
BLOCK = 64
SAMPLE = 300
WINDOWS = 4
BUCKETS = 1 << 14
EPOCHS = 4
SEED = 11
UNKNOWN = "und"


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # feature bucket x label
    lexicon: np.ndarray  # sorted word hashes
    lexicon_lang: np.ndarray
    lexicon_weights: np.ndarray  # lexicon's language (the last: none) x label
    transitions: np.ndarray
    start: np.ndarray


def features(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets: one row of three for each code point (n-grams of 1 to 3 that end there), with 0 for none; one row of six for each word (affixes)."""
    r = _char_hash()[w.points]
    inside = np.arange(len(r)) - np.repeat(w.starts, w.lengths)
    back1 = np.concatenate([[np.uint64(0)], r[:-1]]) if len(r) else r
    back2 = np.concatenate([[np.uint64(0)], back1[:-1]]) if len(r) else r
    grams = [r, mix(r + back1 * np.uint64(3)), mix(r + back1 * np.uint64(3) + back2 * np.uint64(7))]
    at = np.stack([_bucket(g, 1 + n) for n, g in enumerate(grams)], 1)
    for n in (1, 2):
        at[inside < n, n] = 0
    last = w.starts + w.lengths - 1
    affix = np.zeros((len(w.starts), 6), np.int64)
    for n in range(3):
        long = w.lengths > n
        affix[:, n] = np.where(long, _bucket(grams[n][np.minimum(w.starts + n, len(r) - 1)], 11 + n), 0)
        suffix = grams[n][last]
        affix[:, 3 + n] = np.where(long, _bucket(suffix, 21 + n), 0)
    return at, affix


def _bucket(h: np.ndarray, tag: int) -> np.ndarray:
    """1 to BUCKETS - 1; 0 stands for no feature and keeps weight 0."""
    return ((mix(h + np.uint64(tag * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(16)) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1


def lexicon_of(h: np.ndarray, lexicon: np.ndarray, langs: np.ndarray, none: int) -> np.ndarray:
    if not len(lexicon):
        return np.full(len(h), none, np.int64)
    at = np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)
    return np.where(lexicon[at] == h, langs[at], none)


def emissions(m: Model, w: Words) -> np.ndarray:
    at, affix = features(w)
    own = m.weights[at[:, 0]] + m.weights[at[:, 1]] + m.weights[at[:, 2]]
    out = np.add.reduceat(own, w.starts, axis=0) / w.lengths[:, None].astype(np.float32)
    for n in range(6):
        out += m.weights[affix[:, n]]
    return out + m.lexicon_weights[lexicon_of(w.hashes(), m.lexicon, m.lexicon_lang, len(m.langs))]


def blocks(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of words) of every block of the texts that begin at first, and the number of blocks of each text."""
    per = -(-size // BLOCK)
    k = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    return np.repeat(first, per) + k * BLOCK, np.minimum(BLOCK, np.repeat(size, per) - k * BLOCK), per


def _normal(x: np.ndarray) -> np.ndarray:
    return x / x.sum(tuple(range(1, x.ndim)), keepdims=True)


def _borders(psi: np.ndarray, first: np.ndarray, size: np.ndarray, per: np.ndarray, t_exp: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What enters each block from the words before it (before its first word's own factor) and from those behind it, at its last word."""
    k = len(start)
    head = np.cumsum(per) - per  # each text's first block
    enter, leave = np.ones((len(first), k)), np.ones((len(first), k))
    enter[head] = np.exp(start)
    if not len(per) or per.max() == 1:
        return enter, leave
    through = psi[first][:, :, None] * np.eye(k)
    some = np.repeat(per > 1, per)
    for t in range(1, BLOCK):
        live = np.flatnonzero(some & (size > t))
        through[live] = _normal((through[live] @ t_exp) * psi[first[live] + t][:, None, :])
    for j in range(1, int(per.max())):
        at = head[per > j] + j
        enter[at] = _normal(np.einsum("ni,nij->nj", enter[at - 1], through[at - 1]) @ t_exp)
    for j in range(int(per.max()) - 1, 0, -1):
        at = head[per > j] + j
        leave[at - 1] = _normal(np.einsum("nij,nj->ni", through[at], leave[at]) @ t_exp.T)
    return enter, leave


def forward_backward(e: np.ndarray, first: np.ndarray, size: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Each word's label probabilities, for texts of size words from first on (one word at least); with pairs, also the expected count of each transition."""
    n, k = e.shape
    t_exp = np.exp(trans).astype(np.float32)
    psi = np.exp(e - e.max(1, keepdims=True)).astype(np.float32)
    begin, length, per = blocks(first, size)
    enter, leave = (x.astype(np.float32) for x in _borders(psi, begin, length, per, t_exp, start))
    order = np.argsort(-length, kind="stable")
    begin, length, enter, leave = begin[order], length[order], enter[order], leave[order]
    longest = int(length.max())
    live = np.searchsorted(-length, -np.arange(longest), side="left")  # blocks with more than t words
    alpha, beta = np.empty((n, k), np.float32), np.empty((n, k), np.float32)
    now = _normal(psi[begin] * enter)
    alpha[begin] = now
    for t in range(1, longest):
        at = begin[: live[t]] + t
        now = _normal((now[: live[t]] @ t_exp) * psi[at])
        alpha[at] = now
    beta[begin + length - 1] = leave
    for t in range(longest - 1, 0, -1):
        at = begin[: live[t]] + t
        beta[at - 1] = _normal((psi[at] * beta[at]) @ t_exp.T)
    expected = None
    if pairs:
        inner = np.ones(n, np.bool_)
        inner[first] = False
        at = np.flatnonzero(inner)
        expected = _normal(alpha[at - 1][:, :, None] * t_exp[None] * (psi[at] * beta[at])[:, None, :]).sum(0, dtype=np.float64)
    return _normal(alpha * beta), expected


def spans_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, number of words) of the texts that have words."""
    some = counts > 0
    return (np.cumsum(counts) - counts)[some], counts[some]


def gradient(m: Model, w: Words, at: np.ndarray, affix: np.ndarray, lex: np.ndarray, gold: np.ndarray, batch: list[np.ndarray]) -> list[np.ndarray]:
    """Of the mean log-likelihood of the labels gold over the chains of batch (lists of words), by weights, lexicon weights, transitions and start."""
    idx = np.concatenate(batch)
    size = np.array([len(x) for x in batch])
    begin = np.cumsum(size) - size
    y = gold[idx]
    lens = w.lengths[idx]
    chars = np.repeat(w.starts[idx] - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())
    word = np.repeat(np.arange(len(idx)), lens)
    scale = (1 / lens).astype(np.float32)[word][:, None]
    e = np.zeros((len(idx), len(m.langs)), np.float32)
    np.add.at(e, word, (m.weights[at[chars, 0]] + m.weights[at[chars, 1]] + m.weights[at[chars, 2]]) * scale)
    for n in range(6):
        e += m.weights[affix[idx, n]]
    e += m.lexicon_weights[lex[idx]]
    p, expected = forward_backward(e, begin, size, m.transitions, m.start, pairs=True)
    d = -p
    d[np.arange(len(idx)), y] += 1
    g_w, g_l, g_t, g_s = (np.zeros_like(x) for x in (m.weights, m.lexicon_weights, m.transitions, m.start))
    spread = d[word] * scale
    for n in range(3):
        np.add.at(g_w, at[chars, n], spread)
    for n in range(6):
        np.add.at(g_w, affix[idx, n], d)
    np.add.at(g_l, lex[idx], d)
    inner = np.ones(len(idx), np.bool_)
    inner[begin] = False
    np.add.at(g_t, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
    g_t -= expected
    g_s += d[begin].sum(0)
    g_w[0] = 0
    return [g / len(batch) for g in (g_w, g_l, g_t, g_s)]


def train(windows: list[tuple[str, str]]) -> Model | None:
    """windows: (language, text), each a chain; so is each two of them joined."""
    windows = sorted(windows)
    langs = sorted({x for x, _ in windows})
    w = Words([t for _, t in windows], letters_only=True)
    counts = w.counts()
    if not langs or not counts.sum():
        return None
    k, rng = len(langs), np.random.default_rng(SEED)
    label = np.searchsorted(langs, [x for x, _ in windows])
    h, gold = w.hashes(), label[w.doc]
    uniq, of = np.unique(h, return_inverse=True)
    seen = np.zeros((len(uniq), k))
    np.add.at(seen, (of, gold), 1)
    kept = (seen.max(1) >= 3) & (seen.max(1) >= 0.9 * seen.sum(1))
    m = Model(langs, np.zeros((BUCKETS, k), np.float32), uniq[kept], seen[kept].argmax(1), np.zeros((k + 1, k), np.float32), np.zeros((k, k), np.float32), np.zeros(k, np.float32))
    at, affix = features(w)
    lex = lexicon_of(h, m.lexicon, m.lexicon_lang, k)
    first = np.cumsum(counts) - counts
    # Chains: whole windows, and as many joined from the first half of one and the second half of another.
    whole = [np.arange(first[i], first[i] + counts[i]) for i in range(len(counts)) if counts[i]]
    other = [whole[i] for i in rng.permutation(len(whole))]
    joined = [np.concatenate([a[: rng.integers(1, len(a) + 1)], b[rng.integers(0, len(b)) :]])[:RUN] for a, b in zip(whole, other, strict=True)]
    sequences = whole + joined
    squares = [np.full(x.shape, 1e-3, np.float32) for x in (m.weights, m.lexicon_weights, m.transitions, m.start)]
    for _ in range(EPOCHS):
        order = rng.permutation(len(sequences))
        for i in range(0, len(order), 64):
            parts = gradient(m, w, at, affix, lex, gold, [sequences[j] for j in order[i : i + 64]])
            for x, g, s in zip((m.weights, m.lexicon_weights, m.transitions, m.start), parts, squares, strict=True):
                g = g - 1e-5 * x
                s += g * g
                x += 0.3 * g / np.sqrt(s)
    return m


def fit(docs: DataFrame, text: str = "text", label: str = "lang", where: Column | None = None, key: str = "doc_id", sample: int = SAMPLE) -> Model | None:
    """Learn from about ``sample`` rows of each label that satisfy ``where`` (fitting only is bounded so; prediction reads whole texts); rows are chosen by a hash of key."""
    rows = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull() & (where if where is not None else F.lit(True)))
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not counts:
        return None
    share = F.create_map(*(F.lit(x) for kv in counts.items() for x in (kv[0], sample / kv[1])))
    chance = F.pmod(F.xxhash64(F.col(key), F.lit(SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = rows.where(chance < share[F.col(label)]).select(label, F.col(key).alias("k"), F.split(text, r"\s+").alias("w"))
    run = lambda i: F.array_join(F.slice("w", (F.pmod(F.xxhash64("k", i), F.greatest(F.size("w") - RUN, F.lit(1))) + 1).cast("int"), RUN), " ")
    runs = chosen.select(label, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(WINDOWS)), run))).alias("t"))
    return train([(r[0], r[1]) for r in runs.limit(3 * sample * WINDOWS * len(counts)).collect()])


def _documents(m: Model | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    found, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if m is None:
        return found, score
    w = Words(texts, letters_only=True)
    counts = w.counts()
    if not counts.sum():
        return found, score
    p, _ = forward_backward(emissions(m, w), *spans_of(counts), m.transitions, m.start)
    sums = np.stack([np.bincount(w.doc, weights=p[:, j], minlength=len(texts)) for j in range(len(m.langs))], 1)
    best = sums.argmax(1)
    for i in np.flatnonzero(counts).tolist():
        found[i] = m.langs[best[i]]
        score[i] = min(1.0, sums[i, best[i]] / counts[i])
    return found, score


def predict(docs: DataFrame, m: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns, lang_pred and score of every row."""
    src = docs.select(*keep, F.col(text).alias("__text"))
    schema = src.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, texts in pieces(b, "__text"):
                found, score = _documents(m, texts)
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in keep), pa.array(found, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    return src.mapInArrow(lean(run), schema)


def keep_known(docs: DataFrame, m: Model | None, text: str = "text", lang: str = "lang", least: float = 0.5) -> DataFrame:
    """The documents, with all their columns, whose language is found with a score of ``least`` or more; lang becomes what was found."""
    at = docs.columns.index(lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, texts in pieces(b, text):
                found, score = _documents(m, texts)
                columns = [pa.array(found, pa.string()) if n == at else c.slice(i, j - i) for n, c in enumerate(b.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=b.schema.names).filter(pa.array([x != UNKNOWN and y >= least for x, y in zip(found, score, strict=True)]))

    return docs.mapInArrow(lean(run), docs.schema)


def spans(docs: DataFrame, m: Model | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Of every document the runs of words with one most probable label: key, from, to (code points of its words' first and last starts), n_words, lang."""
    src = docs.select(F.col(key), F.col(text).alias("__text"))
    schema = src.select(key, F.lit(0).cast("long").alias("from"), F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n_words"), F.lit("").alias("lang")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, texts in pieces(b, "__text"):
                w = Words(texts, letters_only=True)
                if m is None or not len(w.doc):
                    continue
                p, _ = forward_backward(emissions(m, w), *spans_of(w.counts()), m.transitions, m.start)
                best, at = p.argmax(1), w.at - np.concatenate([[0], w.ends[:-1] + 1])[w.doc]
                new = np.ones(len(best), np.bool_)
                new[1:] = (np.diff(best) != 0) | (np.diff(w.doc) != 0)
                s = np.flatnonzero(new)
                e = np.append(s[1:], len(best)) - 1
                yield pa.RecordBatch.from_arrays([b.column(key).slice(i, j - i).take(pa.array(w.doc[s])), pa.array(at[s]), pa.array(at[e]), pa.array(e - s + 1), pa.array([m.langs[x] for x in best[s]], pa.string())], names=[key, "from", "to", "n_words", "lang"])

    return src.mapInArrow(lean(run), schema)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op2_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    m = fit(docs, where=F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    return predict(docs, m).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
