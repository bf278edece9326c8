"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A document's shingles are its runs of five words, weighted by their count times
ln(1 + N / df), N and df counted over all different texts: copies of a text
count once, or the words of a large group of copies would weigh so little
against an edit's that its near copies are lost.  df is counted in tables:
blocks of documents ask for their distinct shingles, cut by ranges of the hash;
each range is counted whole and its counts go back to the blocks that asked.

Texts with the same words make one node, so copies cost nothing further.  Of
each node ``BANDS * ROWS`` consistent weighted samples are drawn; a pair with
weighted Jaccard similarity J agrees on some band with probability
1 - (1 - J ** ROWS) ** BANDS, 0.99996 at 0.8.  Nodes that share a band's key
meet in chunks of bounded size, each with the key's most connected node, and
those not yet linked in the chunk are compared by exact weighted Jaccard
similarity; links of at least ``THRESHOLD`` join classes.  Where a key took
several chunks, its nodes that are not in one class yet then meet two parts at a
time, so that every pair that shares a key is compared or is in one class.
Pairs whose total weights rule the similarity out don't meet.  Whole classes
come from iterated minimum labels, all in tables.

Defined results: null text is empty text; texts without words are equal if
their characters are; texts of fewer than five words have one shingle; rows
that share a doc_id are told apart by their words, repeated rows are in one
class; a class is named by its least key, null keys last; very long texts are
read whole, with memory in proportion; extra columns are ignored (``keep_first``
keeps them), whatever their names; an empty table has no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuswright.llm.store import drop, free_shuffles, lean, written
from corpuswright.llm.words import PIECE, Words, mix, pieces, shingles

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 10, 2
#: Bytes of text of a block of documents that asks for document frequencies, and of a range of shingles that is counted whole.
ASKING, COUNTING = 4 << 20, 16 << 20
#: Shingles in a row of questions or answers.
ASKED = 4096
#: Rows and bytes of text of a chunk in which candidates are compared.
CHUNK_ROWS, CHUNK_BYTES = 256, 4 << 20
#: Bytes of text of a task, if that makes more tasks than the session's shuffles have.
TASK = 5 << 19
#: Of the tables written between.
CODEC = "zstd"
SHINGLE_BITS = 44
_LOW = np.uint64((1 << SHINGLE_BITS) - 1)


def counted_shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words, np.ndarray]:
    """(text, shingle, count) of the distinct shingles of each text, and the words with their hashes."""
    w = Words(texts)
    h = w.hashes()
    sh, doc = shingles(h, w.doc, len(texts), SHINGLE)
    packed = np.sort((doc.astype(np.uint64) << np.uint64(SHINGLE_BITS)) | (sh >> np.uint64(64 - SHINGLE_BITS)))
    new = np.ones(len(packed), np.bool_)
    new[1:] = packed[1:] != packed[:-1]
    at = np.flatnonzero(new)
    uniq = packed[at]
    return (uniq >> np.uint64(SHINGLE_BITS)).astype(np.int64), uniq & _LOW, np.diff(np.append(at, len(packed))), w, h


def _md5(text: str | None) -> bytes:
    return hashlib.md5((text or "").encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


def nodes(texts: list[str | None], w: Words, h: np.ndarray) -> list[bytes]:
    """16 bytes for each text that tell its word sequence; of a text without words, its characters."""
    counts = w.counts()
    first = np.cumsum(counts) - counts
    place = (np.arange(len(h)) - first[w.doc]).astype(np.uint64)
    out = np.zeros((len(texts), 2), np.uint64)
    some = np.flatnonzero(counts)
    for j, seed in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
        if len(some):
            total = np.add.reduceat(mix(h + (place + np.uint64(1)) * np.uint64(seed)), first[some])
            out[some, j] = mix(total + counts[some].astype(np.uint64))
    raw = out.astype("<u8").tobytes()
    return [raw[16 * i : 16 * i + 16] if counts[i] else _md5(texts[i]) for i in range(len(texts))]


def weights(count: np.ndarray, df: np.ndarray, n: int) -> np.ndarray:
    """ln of count times idf; df of n different texts hold the shingle."""
    return np.log(count).astype(np.float32) + np.log(np.log1p(n / df)).astype(np.float32)


def _planes(x: np.ndarray, width: int) -> bytes:
    """The lowest bytes of all numbers, then the next: bytes that are alike stand together and compress."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


def _groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, Iterator[dict]]]:
    """(value, rows) of the runs of one value in sorted batches."""
    return groupby((row for b in batches for row in b.to_pylist()), key=itemgetter(by))


def _asked(blocked: DataFrame, parts: int) -> DataFrame:
    """(block, part, nth, sh, n): the distinct shingles of each block, ascending, in rows of one part each (as differences), and how many of its texts hold them.

    blocked: block, text, and in rows that come first raw and copies: so many of
    the block's texts with that MD5 stand for copies that another row counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _groups(batches, "block"):
            copies: dict[bytes, int] = {}

            def all_texts() -> Iterator[str | None]:
                for r in rows:  # noqa: B023
                    if r["copies"] is None:
                        yield r["text"]
                    else:
                        copies[r["raw"]] = r["copies"]  # noqa: B023

            found, counts = [], []
            for texts in _texts(all_texts()):
                doc, sh, *_ = counted_shingles(texts)
                first = np.ones(len(texts), np.int64)
                for i, text in enumerate(texts if copies else ()):
                    raw = b"" if text is None else _md5(text)
                    if copies.get(raw, 0):
                        copies[raw] -= 1
                        first[i] = 0
                found.append(sh)
                counts.append(first[doc])
            every = np.concatenate([np.zeros(0, np.uint64), *found])
            order = np.argsort(every, kind="stable")
            held, first = every[order], np.concatenate([np.zeros(0, np.int64), *counts])[order]
            at = np.flatnonzero(np.append(True, held[1:] != held[:-1])) if len(held) else np.zeros(0, np.int64)
            sh, df = held[at], np.add.reduceat(first, at) if len(at) else first
            part = ((sh * np.uint64(parts)) >> np.uint64(SHINGLE_BITS)).astype(np.int64)
            ends = np.append(np.flatnonzero(np.diff(part)) + 1, len(sh))
            cuts = [(x, min(x + ASKED, int(e))) for a, e in zip(np.append(0, ends[:-1]), ends, strict=True) for x in range(int(a), int(e), ASKED)]
            for i in range(0, len(cuts), 100):
                some = cuts[i : i + 100]
                yield pa.RecordBatch.from_pydict({"block": pa.array([block] * len(some), pa.int32()), "part": pa.array([part[x] for x, _ in some], pa.int64()), "nth": pa.array(range(i, i + len(some)), pa.int64()), "sh": [_planes(np.diff(sh[x:y], prepend=np.uint64(0)), 6) for x, y in some], "n": [_planes(df[x:y], 4) for x, y in some]})

    return blocked.mapInArrow(lean(run), "block int, part long, nth long, sh binary, n binary")


def _answers(asked: DataFrame) -> DataFrame:
    """(block, nth, df): the document frequencies of the shingles of every row of questions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "part"):
            to, found, seen = [], [], []
            for r in rows:
                to.append((r["block"], r["nth"]))
                found.append(np.cumsum(_from_planes(r["sh"], 6), dtype=np.uint64))
                seen.append(_from_planes(r["n"], 4))
            asked_for = np.concatenate(found)
            values = _distinct(asked_for)
            at = np.searchsorted(values, asked_for)
            total = np.bincount(at, np.concatenate(seen), len(values)).astype("<u4")
            ends = np.cumsum([len(x) for x in found])
            for i in range(0, len(to), 100):
                some = range(i, min(i + 100, len(to)))
                yield pa.RecordBatch.from_pydict({"block": pa.array([to[k][0] for k in some], pa.int32()), "nth": pa.array([to[k][1] for k in some], pa.int64()), "df": [_planes(total[at[ends[k] - len(found[k]) : ends[k]]], 4) for k in some]})

    return asked.mapInArrow(lean(run), "block int, nth long, df binary")


def _texts(rows: Iterator[str | None]) -> Iterator[list[str | None]]:
    """The texts in runs of about PIECE characters."""
    held, size = [], 0
    for text in rows:
        if held and size + len(text or "") > PIECE:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text or "")
    if held:
        yield held


@cache
def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of 2**16 draws each: r and ln c, with r and c Gamma(2, 1), and beta, uniform."""
    u = (np.arange(1 << 16) + 0.5) / (1 << 16)
    rng = np.random.default_rng(5)
    r = -np.log(rng.permutation(u)) - np.log(rng.permutation(u))
    c = -np.log(rng.permutation(u)) - np.log(rng.permutation(u))
    return r.astype(np.float32), np.log(c).astype(np.float32), rng.permutation(u).astype(np.float32)


def samples(doc: np.ndarray, sh: np.ndarray, lnw: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """n_docs x k consistent weighted samples (32-bit, of shingle and quantised weight); 0 for a text without shingles."""
    out = np.zeros((n_docs, k), np.uint64)
    if not len(sh):
        return out
    r_table, c_table, b_table = _draws()
    some, first = np.unique(doc, return_index=True)
    for j in range(k):
        h = mix(sh + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        draw = h.view(np.uint16).reshape(-1, 4)  # four numbers of 16 bits
        r, beta = r_table[draw[:, 0]], b_table[draw[:, 1]]
        t = np.floor(lnw / r + beta)
        lna = c_table[draw[:, 2]] - r * (t - beta + np.float32(1))
        bits = lna.view(np.int32)
        rising = (bits ^ ((bits >> 31) & 0x7FFFFFFF)).view(np.uint32) ^ np.uint32(1 << 31)
        who = ((h + t.astype(np.int64).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)
        out[some, j] = np.minimum.reduceat((rising.astype(np.uint64) << np.uint64(32)) | who, first) & np.uint64(0xFFFFFFFF)
    return out


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, each value once; a plain sort is faster here than np.unique."""
    x = np.sort(x)
    new = np.ones(len(x), np.bool_)
    new[1:] = x[1:] != x[:-1]
    return x[new]


def _tasks(spark: SparkSession, size: int) -> int:
    """Tasks for so many bytes of text; a task costs about 0.2 s, however little it has to do."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + size // TASK)


def signatures(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """A written table of key, node, MD5 of the text, n_bytes, total weight, df of the shingles (32 bits each, ascending by shingle) and the bands' keys of every row (no keys for a text without words); the number of different texts."""
    spark = docs.sparkSession
    src = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    size = src.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    tasks = _tasks(spark, size)
    blocked = src.withColumn("block", F.pmod(F.xxhash64("key", "text"), F.lit(1 + size // ASKING)).cast("int"))
    # Where copies lie: slim rows of a text's MD5 and block; the copies in its least block but one, and in all others, don't count.
    raw = F.coalesce(F.unhex(F.md5(F.encode("text", "UTF-8"))), F.lit(b""))
    lies, lies_path = written(blocked.groupBy(raw.alias("raw"), "block").agg(F.count(F.lit(1)).alias("rows")), "lies", codec=CODEC)
    least = lies.groupBy("raw").agg(F.min("block").alias("least"), F.sum("rows").alias("of"))
    n = least.count()
    copies = lies.join(least.where("of > 1").select("raw", "least"), "raw").select("block", F.lit(None).cast("string").alias("text"), "raw", (F.col("rows") - (F.col("block") == F.col("least")).cast("long")).alias("copies")).where("copies > 0")
    asking = blocked.select("block", "text", F.lit(None).cast("binary").alias("raw"), F.lit(None).cast("long").alias("copies")).unionByName(copies)
    asking = asking.repartition(tasks, "block").sortWithinPartitions("block", F.col("copies").desc_nulls_last())
    asked, asked_path = written(_asked(asking, 1 + size // COUNTING), "asked", codec=CODEC)
    drop(spark, lies_path)
    del asking, copies, least, lies
    free_shuffles(spark)
    answers, answers_path = written(_answers(asked.repartition(tasks, "part").sortWithinPartitions("part")), "answers", codec=CODEC)
    drop(spark, asked_path)
    del asked
    free_shuffles(spark)
    none = {"nth": "long", "df": "binary"}
    rows = blocked.select("block", "key", "text", *(F.lit(None).cast(t).alias(c) for c, t in none.items()))
    rows = answers.select("block", F.lit(None).cast(src.schema["key"].dataType).alias("key"), F.lit(None).cast("string").alias("text"), "nth", "df").unionByName(rows)
    rows = rows.repartition(tasks, "block").sortWithinPartitions("block", F.col("nth").asc_nulls_last())
    schema = src.select("key", F.lit(b"").alias("node"), F.lit(b"").alias("raw"), F.lit(0).cast("long").alias("n_bytes"), F.lit(0.0).alias("total"), F.lit(b"").alias("df"), F.array(F.lit(0).cast("long")).alias("bands")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for b in batches:
                kind = b.schema.field("key").type
                yield b

        for _, group in _groups(typed(), "block"):
            known, keys, held = [], [], []
            for r in group:
                if r["nth"] is not None:
                    known.append(_from_planes(r["df"], 4).astype("<u4"))
                else:
                    keys.append(r["key"])
                    held.append(r["text"])
            # A block is small (ASKING, or one long text): its shingles are found once and kept.
            counted = []
            for texts in _texts(iter(held)):
                doc, sh, count, w, h = counted_shingles(texts)
                counted.append((texts, doc.astype(np.int32), sh, count.astype(np.int32), nodes(texts, w, h), w.counts() > 0))
                del w, h  # the words are the larger part
            values = _distinct(np.concatenate([c[2] for c in counted]))
            frequency = np.concatenate([np.zeros(0, "<u4"), *known])
            assert len(frequency) == len(values)
            i = 0
            for texts, doc, sh, count, names, some in counted:
                df = frequency[np.searchsorted(values, sh)]
                lnw = weights(count, df, n)
                s = samples(doc, sh, lnw, len(texts), BANDS * ROWS)
                total = np.bincount(doc, np.exp(lnw.astype(np.float64)), len(texts))
                ends = np.searchsorted(doc, np.arange(len(texts) + 1))
                bands = np.zeros((len(texts), BANDS), np.uint64)
                for r in range(ROWS):
                    bands = mix(bands + s[:, r::ROWS] + np.uint64(r + 1))
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32), pa.array(bands[some].ravel().view(np.int64)))
                dfs = [df[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + len(texts)], kind), pa.array(names, pa.binary()), pa.array([_md5(t) for t in texts], pa.binary()), pa.array([len(t or "") for t in texts], pa.int64()), pa.array(total, pa.float64()), pa.array(dfs, pa.binary()), lists], names=["key", "node", "raw", "n_bytes", "total", "df", "bands"])
                i += len(texts)

    sig, _ = written(rows.mapInArrow(lean(run), schema), "signatures", codec=CODEC)
    drop(spark, answers_path)
    del rows, answers
    free_shuffles(spark)
    return sig.withColumnRenamed("key", key) if key != "key" else sig, n


def _parts(n: Column, size: Column, share: int = 1) -> Column:
    """Chunks for so many rows and bytes; share: by how many parts a chunk is filled."""
    return F.greatest(F.ceil(n * share / CHUNK_ROWS), F.ceil(size * share / CHUNK_BYTES)).cast("int")


def _members(rows: DataFrame) -> DataFrame:
    """The nodes of every key that two nodes share.  rows: node, n_bytes, total, bands of every node with words."""
    at = rows.select("node", "n_bytes", "total", F.posexplode("bands").alias("band", "bkey"))
    buckets = at.groupBy("band", "bkey").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("bytes"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who")).where("n > 1")
    # Bands in which the very same nodes meet need one meeting.
    buckets = buckets.groupBy("n", "bytes", "who").agg(F.min(F.struct("band", "bkey")).alias("b"), F.count(F.lit(1)).alias("times")).select("b.band", "b.bkey", "n", "times", _parts(F.col("n"), F.col("bytes")).alias("chunks"))
    return at.join(buckets, ["band", "bkey"])


def _chunks(members: DataFrame) -> DataFrame:
    """(chunk, node, n_bytes, leads, side, label, band): which nodes meet where at first."""
    weight = members.groupBy("node").agg(F.sum(F.col("n") * F.col("times")).alias("weight"))
    members = members.join(weight, "node")
    leaders = members.groupBy("band", "bkey").agg(F.max(F.struct("weight", "node", "n_bytes")).alias("lead"), F.first("chunks").alias("chunks")).select("band", "bkey", F.col("lead.node").alias("lead"), F.col("lead.n_bytes").alias("lead_bytes"), "chunks")
    spread = leaders.select("band", "bkey", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("part"), F.col("lead").alias("node"), F.col("lead_bytes").alias("n_bytes"), F.lit(True).alias("leads"))
    rest = members.join(leaders.select("band", "bkey", "lead"), ["band", "bkey"]).where("node <> lead")
    rest = rest.select("band", "bkey", F.pmod(F.xxhash64("node", "band"), F.col("chunks")).cast("int").alias("part"), "node", "n_bytes", F.lit(False).alias("leads"))
    return spread.unionByName(rest).select(F.xxhash64("band", "bkey", "part").alias("chunk"), "node", "n_bytes", "leads", F.lit(0).alias("side"), F.col("node").alias("label"), F.lit(0).alias("band"))


def _rest(members: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """(chunk, node, n_bytes, leads, side, label, band): where nodes of a key in several chunks meet that are not in one class yet.

    A key's nodes are dealt by total weight, in steps that similar nodes differ
    in by one at most, and by class; a class that fills several parts has them
    to itself.  Two parts meet in a chunk, or one alone; parts of the same class don't.
    """
    step = 1.001 * max(-math.log(threshold), 1e-6)
    key, cell = ["band", "bkey"], ["band", "bkey", "size", "label"]
    m = members.join(labels, "node", "left").select(*key, "node", "n_bytes", F.coalesce("label", "node").alias("label"), F.floor(F.log("total") / step).alias("size"))
    m = m.join(m.groupBy(*key).agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select(*key), key)
    cells = m.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("bytes")).withColumn("own", _parts(F.col("n"), F.col("bytes"), 2))
    shared = cells.where("own = 1").groupBy(*key, "size").agg(_parts(F.sum("n"), F.sum("bytes"), 2).alias("shared"))
    cells = cells.join(shared, [*key, "size"], "left").select(*cell, "own", "shared")
    alone = F.col("own") > 1
    m = m.join(cells, cell).withColumn("class", F.when(alone, F.col("label")).otherwise(F.lit(b""))).withColumn("part", F.when(alone, F.pmod(F.xxhash64("node"), "own")).otherwise(F.pmod(F.xxhash64("label"), "shared")))
    m = m.withColumn("place", F.xxhash64(*key, "size", "class", "part"))
    parts = m.select(*key, "size", "class", "place").distinct()
    other = parts.select(*key, F.col("size").alias("near"), F.col("class").alias("other_class"), F.col("place").alias("other"))
    pairs = parts.withColumn("near", F.explode(F.array("size", F.col("size") + 1))).join(other, [*key, "near"])
    pairs = pairs.where("(near > size or place <= other) and (class = X'' or class <> other_class)").select("place", "other", F.xxhash64("place", "other").alias("chunk"))
    sides = pairs.select("chunk", "place", F.lit(0).alias("side")).unionByName(pairs.where("place <> other").select("chunk", F.col("other").alias("place"), F.lit(1).alias("side")))
    return m.join(sides, "place").select("chunk", "node", "n_bytes", F.lit(False).alias("leads"), "side", "label", "band")


def _linked(texts: list[str], at: list[tuple], n: int, threshold: float) -> list[tuple[bytes, bytes]]:
    """Links that join the texts of a chunk; the first text leads.  at: node, side, label, band, bands' keys and df of each; n: all documents.

    Each pair not joined already is compared, but pairs of one class, those that
    share an earlier band's key and, if there are two sides, those of one side.
    """
    doc, sh, count, *_ = counted_shingles(texts)
    own, sides, labels, bands, keys, dfs = zip(*at, strict=True)
    weight = np.exp(weights(count, np.frombuffer(b"".join(dfs), "<u4"), n).astype(np.float64))
    ends = np.searchsorted(doc, np.arange(len(texts) + 1))
    vectors = [(sh[a:b], weight[a:b], weight[a:b].sum()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    totals = np.array([v[2] for v in vectors])
    sides, keys = np.array(sides), np.array(keys, np.int64)[:, : bands[0]]
    first: dict[bytes, int] = {}
    root = [first.setdefault(x, i) for i, x in enumerate(labels)]
    two = sides.min() != sides.max()

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for i in range(len(texts)):
        a, wa, sa = vectors[i]
        rest = totals[i + 1 :]
        wanted = np.minimum(sa, rest) >= threshold * np.maximum(sa, rest) - 1e-9
        if two:
            wanted &= sides[i + 1 :] != sides[i]
        wanted &= ~(keys[i + 1 :] == keys[i]).any(axis=1)
        for j in (np.flatnonzero(wanted) + i + 1).tolist():
            if top(i) == top(j):
                continue
            b, wb, sb = vectors[j]
            at_b = np.minimum(np.searchsorted(b, a), len(b) - 1)
            both = b[at_b] == a
            common = np.minimum(wa[both], wb[at_b[both]]).sum()
            if common >= threshold * (sa + sb - common) - 1e-9:
                root[top(j)] = top(i)
                links.append((own[i], own[j]))
    return links


def _candidates(docs: DataFrame, sig: DataFrame, members: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    """A written table of node, bands, df and text of the members, and its folder: the whole table's texts are dealt once, however often nodes meet."""
    spread = sig.groupBy("node").agg(F.min(F.struct(F.col(key).alias("id"), "raw")).alias("row"), F.first("bands").alias("bands"), F.first("df").alias("df"))
    wanted = spread.join(members.select("node").distinct(), "node").select("row.*", "node", "bands", "df").withColumnsRenamed({"id": "__id", "raw": "__raw"})
    raw = F.unhex(F.md5(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")))
    rows = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("text"), raw.alias("__md5"))
    rows = rows.join(wanted, F.col("__key").eqNullSafe(F.col("__id")) & (F.col("__md5") == F.col("__raw"))).select("node", "bands", "df", "text")
    out = written(rows, "candidates", codec=CODEC)
    free_shuffles(docs.sparkSession)
    return out


def _compared(texts: DataFrame, chunks: DataFrame, n: int, threshold: float) -> DataFrame:
    """The links (a, b) found in chunks, in a written table.  texts: of _candidates."""
    spark = texts.sparkSession
    met, met_path = written(chunks, "met", codec=CODEC)
    at = met.groupBy("node").agg(F.collect_list(F.struct("chunk", "leads", "side", "label", "band")).alias("at"))
    rows = texts.join(at, "node").select("node", "bands", "df", "text", F.explode("at").alias("at")).select("at.*", "bands", "df", "node", "text")
    tasks = _tasks(spark, met.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0])
    rows = rows.repartition(tasks, "chunk").sortWithinPartitions("chunk", F.desc("leads"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[str, tuple]] = {}
        now = None

        def close() -> pa.RecordBatch:
            found = _linked([t for t, _ in held.values()], [x for _, x in held.values()], n, threshold)
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], names=["a", "b"])

        for batch in batches:
            for chunk, node, text, *at in zip(*(batch.column(c).to_pylist() for c in ("chunk", "node", "text", "side", "label", "band", "bands", "df")), strict=True):
                if chunk != now:
                    if len(held) > 1:
                        yield close()
                    held, now = {}, chunk
                held.setdefault(node, (text, (node, *at)))
        if len(held) > 1:
            yield close()

    found, _ = written(rows.mapInArrow(lean(run), "a binary, b binary").distinct(), "links")
    drop(spark, met_path)
    del rows, met, at
    free_shuffles(spark)
    return found


def links(docs: DataFrame, sig: DataFrame, key: str, text: str, n: int, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of nodes (a, b) that join all nodes with verified similarity; within a chunk, a spanning set of them."""
    unique = sig.where(F.size("bands") > 0).groupBy("node").agg(F.max("n_bytes").alias("n_bytes"), F.max("total").alias("total"), F.first("bands").alias("bands"))
    members, path = written(_members(unique), "members", codec=CODEC)
    texts, texts_path = _candidates(docs, sig, members, key, text)
    found = _compared(texts, _chunks(members), n, threshold)
    split = members.where("chunks > 1")
    if split.limit(1).count():
        labels = components(found, docs.sparkSession)
        found = found.unionByName(_compared(texts, _rest(split, labels, threshold), n, threshold))
    drop(docs.sparkSession, path)
    drop(docs.sparkSession, texts_path)
    return found


def components(edges: DataFrame, spark: SparkSession) -> DataFrame:
    """node, label (the least node of its component) of every node with a link: minimum labels and pointer jumping, each round a written table."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    labels, path = written(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")), "labels")
    while True:
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["u"]).select("node", F.least("label", "near").alias("label"), F.col("label").alias("before"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        step = step.join(far, "label", "left").select("node", F.least("label", F.coalesce("beyond", "label")).alias("label"), "before")
        new, new_path = written(step, "labels")
        moved = new.where("label <> before").limit(1).count()
        drop(spark, path)
        labels, path = new.select("node", "label"), new_path
        if not moved:
            return labels


def _labelled(docs: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """key, raw (the text's MD5) and label (its class) of every row."""
    sig, n = signatures(docs, key, text)
    found = components(links(docs, sig, key, text, n, threshold), docs.sparkSession)
    return sig.select("node", key, "raw").join(found, "node", "left").select(F.coalesce("label", "node").alias("label"), key, "raw")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, class_id (the least key of its class), class_size of every row."""
    of = _labelled(docs, key, text, threshold)
    # Written, so that the join has a shuffle on both sides and a class that outgrows a task can be split over several.
    least, _ = written(of.groupBy("label").agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("class_size")), "classes")
    return of.join(least, "label").select(key, "class_id", "class_size")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class: the one with the least key (null keys last), then the least MD5."""
    of = _labelled(docs, key, text, threshold)
    first = of.groupBy("label").agg(F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "raw")).alias("f")).select(F.col("f.key").alias("__kept"), F.col("f.raw").alias("__raw"))
    raw = F.unhex(F.md5(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")))
    kept = docs.join(first, F.col(key).eqNullSafe(F.col("__kept")) & (raw == F.col("__raw")))
    # Only rows that repeat key and text are left to choose from.
    at = Window.partitionBy("__kept", "__raw").orderBy(F.lit(0))
    return kept.withColumn("__nth", F.row_number().over(at)).where("__nth = 1").select(*docs.columns)


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
