"""Packing of documents into sequences of bounded length, best fit decreasing.

Documents longer than a sequence are cut into pieces of its length; only the
last piece may be shorter.  Pieces are dealt by hash to shards of about
``SHARD`` pieces; each shard packs its own, longest first, into the open
sequence with the least room that suffices.  A segment tree over the remaining
capacities, with the number of open sequences of each, finds it in logarithmic
time.  Only (key, piece, length) is shuffled, never ids.  A shard leaves at most
its last sequences part empty, so the sum of unused places is a small share of
the shard whatever the number of shards.

Defined results: null text is empty text, of its end id alone; equal lengths
are packed in order of key and piece; rows that share a key are numbered by
their text's ids; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuswright.llm.store import lean, written
from corpuswright.llm.tokens import default_path, encoder, forget
from corpuswright.llm.words import pieces as text_pieces

LENGTH = 2048
END = 0
SHARD = 1 << 17


class Capacities:
    """Segment tree over room 0 to size: how many open sequences have it."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        at = self.leaves + room
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, sequence) of the tightest open sequence with room for ``least``, taken out; None if there is none."""
        count, at = self.count, self.leaves + least
        if not count[at]:
            # Up to the first right sibling that holds something, then down its left edge.
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.leaves
        while at:
            count[at] -= 1
            at >>= 1
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: list[int], size: int) -> tuple[list[int], list[int], int]:
    """(sequence, offset) of each length, given in decreasing order, and the number of sequences."""
    tree, sequences = Capacities(size), 0
    where, offset = [0] * len(lengths), [0] * len(lengths)
    for i, n in enumerate(lengths):
        found = tree.take(n)
        if found is None:
            room, s = size, sequences
            sequences += 1
        else:
            room, s = found
        where[i], offset[i] = s, size - room
        if room > n:
            tree.add(room - n, s)
    return where, offset, sequences


def cut(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, end: int = END, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32 (and ids, on wish) of every piece."""
    path = path or default_path()
    src = docs.select(F.col(key), F.col(text).alias("__text"))
    schema = src.select(key, *(F.lit(0).cast("long").alias(c) for c in ("piece", "start", "length", "ids_crc32")), F.lit(b"").alias("ids")).schema
    if not with_ids:
        schema = type(schema)(schema.fields[:-1])
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            for i, _, texts in text_pieces(b, "__text"):
                at, start, size, crc, ids = [], [], [], [], []
                for n, t in enumerate(texts):
                    data = e.encode(t) + last
                    for s in range(0, len(data), 4 * length):
                        part = data[s : s + 4 * length]
                        at.append(i + n)
                        start.append(s // 4)
                        size.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(part)
                columns = [b.column(key).take(pa.array(at, pa.int64())), pa.array([s // length for s in start], pa.int64()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, names=schema.names)
        forget(path)

    return src.mapInArrow(lean(run), schema)


def pack(pieces: DataFrame, key: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """The pieces' rows with sequence_id and offset.  pieces: key, piece, length and others, from a stored table."""
    n = pieces.count()
    shards = max(1, -(-n // SHARD))
    spread = pieces.withColumn("__shard", F.pmod(F.xxhash64(key, "piece"), F.lit(shards)))
    ordered = spread.repartition(shards, "__shard").sortWithinPartitions("__shard", F.desc("length"), *(c for c in pieces.columns if c != "length"))
    schema = pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            shard = table.column("__shard")[0].as_py()
            table = table.drop_columns(["__shard"])
            where, offset, _ = best_fit_decreasing(table.column("length").to_pylist(), length)
            ids = np.array(where, np.int64) * shards + shard
            yield from table.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset, pa.int64())).to_batches()

        # A task may have several shards; one at a time is held.
        for b in batches:
            shard = b.column("__shard").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                if held and z > a and held[-1].column("__shard")[0].as_py() != shard[a]:
                    yield from packed()
                    held = []
                if z > a:
                    held.append(b.slice(a, z - a))
        if held:
            yield from packed()

    return ordered.mapInArrow(lean(run), schema)


def op4_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(written(cut(docs), "pieces")[0])
