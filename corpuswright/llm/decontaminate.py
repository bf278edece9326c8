"""Benchmark decontamination: short test items inside long documents.

Items and documents are sets of five-word shingles.  Items are split by size
into classes whose largest size is at most ``RATIO`` times the smallest; for a
class with largest size u a document is read as overlapping windows of 3 u / 2
shingles, a new one every u / 2, so an item that a document holds lies within
one window of its own size.  Windows and items have MinHash signatures of
``HASHES`` values, and a window is a candidate for every item of the class with
which it agrees on any value.  With four fifths of an item's shingles in it a
window's Jaccard similarity is 0.38 at least, so it agrees nowhere with a
probability under 1e-6.  Candidates are verified by exact containment: the share
of the item's shingles that the whole document has.

A window without any item's shingle can't agree, and a document with fewer of
them than four fifths of a class's smallest item holds none of that class; a bit
table of all items' shingles leaves both out.  Items go to the tasks in blocks of bounded
size, one scan of the documents for each block.

Defined results: null texts and texts without words hold and match nothing;
fewer than five words make one shingle of all; repeated rows are judged one by
one; keys may have any type and be null; where both keys have one name, the
item's is ``item_`` and that name; ties don't arise (every pair is returned);
very long texts are read whole; ``keep_clean`` keeps extra columns, whatever their
names; an empty table has no rows, and no items leave all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpuswright.llm.store import lean
from corpuswright.llm.words import Words, mix, pieces, shingles

SHINGLE = 5
THRESHOLD = 0.8
RATIO = 1.25
HASHES = 32
#: Code points of items, at most, that go to the tasks together.
BLOCK = 8 << 20
_SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _signature(sh: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Minima of each hash over the parts of sh that start at first: parts x HASHES."""
    if len(sh) <= 1 << 14:
        return np.minimum.reduceat(mix(sh[None, :] ^ _SEEDS[:, None]), first, axis=1).T
    return np.stack([np.minimum.reduceat(mix(sh ^ s), first) for s in _SEEDS], 1)


class Items:
    """A block of items, ready to be searched."""

    def __init__(self, texts: list[str | None], bits: int = 22):
        w = Words(texts)
        sh, of = shingles(w.hashes(), w.doc, len(texts), SHINGLE)
        order = np.lexsort((sh, of))
        sh, of = sh[order], of[order]
        new = np.ones(len(sh), np.bool_)
        new[1:] = (sh[1:] != sh[:-1]) | (of[1:] != of[:-1])
        self.sh, of = sh[new], of[new]
        self.size = np.bincount(of, minlength=len(texts))
        self.first = np.cumsum(self.size) - self.size
        while len(self.sh) << 4 > 1 << bits and bits < 30:
            bits += 1
        self.shift = np.uint64(64 - bits)
        self.known = np.zeros(1 << bits, np.bool_)
        self.known[(self.sh >> self.shift).astype(np.int64)] = True
        self.classes: list[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]] = []
        some = np.flatnonzero(self.size)
        by_size = some[np.argsort(self.size[some], kind="stable")]
        while len(by_size):
            n = int(np.searchsorted(self.size[by_size], RATIO * self.size[by_size[0]], side="right"))
            own, by_size = by_size[:n], by_size[n:]
            parts = [self.sh[self.first[i] : self.first[i] + self.size[i]] for i in own]
            sig = _signature(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]))
            tables = []
            for k in range(HASHES):
                o = np.argsort(sig[:, k], kind="stable")
                tables.append((sig[o, k], own[o]))
            self.classes.append((int(self.size[own].min()), int(self.size[own].max()), tables))

    def candidates(self, sh: np.ndarray, threshold: float) -> np.ndarray:
        """Items with which some window of a document's shingles agrees."""
        found = [np.zeros(0, np.int64)]
        hit = np.flatnonzero(self.known[(sh >> self.shift).astype(np.int64)])
        if not len(hit):
            return found[0]
        for smallest, largest, tables in self.classes:
            if len(hit) < threshold * smallest - 1e-9:
                break
            step = max(1, -(-largest // 2))
            block_of_hit = np.unique(hit // step)
            n_blocks = -(-len(sh) // step)
            # Blocks of windows with a hit: two before and two after each.
            near = np.unique((block_of_hit[:, None] + np.arange(-2, 3)).ravel())
            near = near[(near >= 0) & (near < n_blocks)]
            take = (near[:, None] * step + np.arange(step)).ravel()
            inside = take < len(sh)
            sizes = inside.reshape(len(near), step).sum(1)
            sig = np.full((n_blocks + 2, HASHES), np.uint64(0xFFFFFFFFFFFFFFFF))
            sig[near] = _signature(sh[take[inside]], np.cumsum(sizes) - sizes)
            windows = np.unique((block_of_hit[:, None] - np.arange(3)).ravel())
            windows = windows[windows >= 0]
            own = np.minimum(np.minimum(sig[windows], sig[windows + 1]), sig[windows + 2])
            for k, (values, items) in enumerate(tables):
                lo, hi = np.searchsorted(values, own[:, k], side="left"), np.searchsorted(values, own[:, k], side="right")
                for a, z in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                    found.append(items[a:z])
        return np.unique(np.concatenate(found))

    def search(self, texts: list[str | None], threshold: float) -> list[tuple[int, int, int, int]]:
        """(text, item, the item's shingles, those of them in the text) of every pair over the threshold."""
        w = Words(texts)
        sh, doc = shingles(w.hashes(), w.doc, len(texts), SHINGLE)
        hit = self.known[(sh >> self.shift).astype(np.int64)]
        ends = np.searchsorted(doc, np.arange(len(texts) + 1))
        out = []
        for d in np.unique(doc[hit]).tolist():
            own = sh[ends[d] : ends[d + 1]]
            distinct = np.unique(own)
            for i in self.candidates(own, threshold).tolist():
                item = self.sh[self.first[i] : self.first[i] + self.size[i]]
                at = np.minimum(np.searchsorted(distinct, item), len(distinct) - 1)
                common = int((distinct[at] == item).sum())
                if common >= threshold * len(item) - 1e-9:
                    out.append((d, i, len(item), common))
        return out


def blocks(benchmark: DataFrame, item_key: str, item_text: str) -> Iterator[tuple[list, list[str | None]]]:
    """(keys, texts) of the items, in blocks of bounded size; the driver holds one at a time."""
    keys, texts, size = [], [], 0
    for r in benchmark.select(item_key, item_text).orderBy(item_key, item_text).toLocalIterator():
        keys.append(r[0])
        texts.append(r[1])
        size += len(r[1] or "")
        if size >= BLOCK:
            yield keys, texts
            keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, item key, n_item (its shingles), n_common, containment of every pair of a document and an item that it holds."""
    src = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    item = f"item_{item_key}" if item_key == key else item_key
    kinds = [docs.schema[key].dataType, benchmark.schema[item_key].dataType, T.LongType(), T.LongType(), T.DoubleType()]
    schema = T.StructType([T.StructField(name, kind) for name, kind in zip((key, item, "n_item", "n_common", "containment"), kinds, strict=True)])
    item_type = to_arrow_schema(T.StructType([schema[1]])).field(0).type
    out = None
    for keys, texts in blocks(benchmark, item_key, item_text):

        def run(batches: Iterator[pa.RecordBatch], keys=keys, texts=texts) -> Iterator[pa.RecordBatch]:
            items = None
            for b in batches:
                items = items or Items(texts)
                for i, _, own in pieces(b, "__text"):
                    found = items.search(own, threshold)
                    columns = [b.column("__key").take(pa.array([i + f[0] for f in found], pa.int64())), pa.array([keys[f[1]] for f in found], item_type)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.int64()), pa.array([f[3] / f[2] for f in found], pa.float64())], names=schema.names)

        part = src.mapInArrow(lean(run), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that hold no item."""
    for _, texts in blocks(benchmark, item_key, item_text):

        def run(batches: Iterator[pa.RecordBatch], texts=texts) -> Iterator[pa.RecordBatch]:
            items = None
            for b in batches:
                items = items or Items(texts)
                clean = np.ones(b.num_rows, np.bool_)
                for i, _, own in pieces(b, text):
                    clean[[i + f[0] for f in items.search(own, threshold)]] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs


def op5_query(spark, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS r, item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT r, doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM d),
bs AS (SELECT DISTINCT r, item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM b),
n AS (SELECT r, count(*) AS n_item FROM bs GROUP BY r)
SELECT ds.doc_id, bs.item_id, n.n_item, count(*) AS n_common, count(*) / n.n_item AS containment
FROM ds JOIN bs USING (s) JOIN n ON n.r = bs.r
GROUP BY ds.r, ds.doc_id, bs.r, bs.item_id, n.n_item HAVING count(*) >= 0.8 * n.n_item
"""
