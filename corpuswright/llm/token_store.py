"""Token ids in binary shards, with a minimal perfect hash index for keyed access.

Documents are range-partitioned by key; each partition is a shard of two files:

``ids-N.bin``   the raw ids of its documents end to end, little-endian, 16 bits
                each if the vocabulary allows it, else 32;
``ids-N.mph``   a header of eight unsigned 64-bit numbers (magic, bytes an id,
                keys, rows, buckets and three zeros), then the bucket seeds
                (int32), the keys' fingerprints (uint32), first rows (uint32)
                and row counts (uint32) by slot, and the rows' starts (uint64,
                one more than rows).

A key's hash gives its bucket, the bucket's seed its slot (hash and displace;
a bucket of one key names its slot directly), and the slot its rows: constant
time, no stored keys.  The fingerprint tells foreign keys, wrong once in 2**32.

Defined results: null text is empty text, of its end id alone; documents with
equal keys follow each other in the order of their texts' hashes and texts and
are found together; a null key is the least (it stands for -2**63); extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswright.llm.store import file_system, lean, new_dir, qualified, replace_file, written
from corpuswright.llm.tokens import default_path, encoder, forget
from corpuswright.llm.words import mix

END = 2
MAGIC = 0x31585048
NULL_KEY = -(1 << 63)
PER_BUCKET = 4


# ---- minimal perfect hashing ----------------------------------------------


def _slots(h: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    return (mix(h + seeds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seeds by bucket, slot by key) of different int64 keys: slots are 0 to len(keys) - 1, each once."""
    n = len(keys)
    buckets = max(1, -(-n // PER_BUCKET))
    seeds, slot = np.zeros(buckets, np.int32), np.zeros(n, np.int64)
    h = mix(keys.astype(np.int64).view(np.uint64))
    of = (h % np.uint64(buckets)).astype(np.int64)
    size = np.bincount(of, minlength=buckets)
    order = np.lexsort((of, -size[of]))  # the largest buckets first, each together
    taken = np.zeros(n, np.bool_)
    for many in range(int(size.max(initial=0)), 1, -1):
        left, seed = order[size[of[order]] == many], 0
        while len(left) > 64 * many and seed < 64:
            # One seed for all buckets of this size: those whose slots are free, and not asked for by an earlier one, have found theirs.
            at = _slots(h[left], np.full(1, seed), n)
            first = np.zeros(len(left), np.bool_)
            first[np.unique(at, return_index=True)[1]] = True
            good = (first & ~taken[at]).reshape(-1, many).all(1)
            if good.any():
                done = np.repeat(good, many)
                seeds[of[left[done]]] = seed
                slot[left[done]] = at[done]
                taken[at[done]] = True
                left = left[~done]
            seed += 1
        for own in left.reshape(-1, many):
            tries, good = np.arange(64), np.zeros(1, np.bool_)
            while not good.any():
                # Many seeds for one bucket.
                at = _slots(h[own][None, :], tries[:, None], n)
                good = ~taken[at].any(1) & (np.diff(np.sort(at, 1), axis=1) > 0).all(1)
                k = int(good.argmax())
                if not good[k]:
                    tries = np.arange(tries[-1] + 1, tries[-1] + 1025)
            seeds[of[own[0]]], slot[own] = tries[k], at[k]
            taken[at[k]] = True
    single = np.flatnonzero(size == 1)
    free = np.flatnonzero(~taken)[: len(single)]
    seeds[single] = -free - 1
    lone = np.flatnonzero(size[of] == 1)
    slot[lone[np.argsort(of[lone])]] = free
    return seeds, slot


def find_slots(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    h = mix(keys.astype(np.int64).view(np.uint64))
    s = seeds[(h % np.uint64(len(seeds))).astype(np.int64)].astype(np.int64)
    return np.where(s < 0, -s - 1, _slots(h, np.maximum(s, 0), n))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(np.uint64) ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


class Index:
    """A shard's index file."""

    def __init__(self, data: bytes):
        head = np.frombuffer(data, "<u8", 8)
        if int(head[0]) != MAGIC:
            raise ValueError("not an index file")
        self.width, self.keys, self.rows, buckets = (int(x) for x in head[1:5])
        at, parts = 64, []
        for kind, n in (("<i4", buckets), ("<u4", self.keys), ("<u4", self.keys), ("<u4", self.keys), ("<u8", self.rows + 1)):
            parts.append(np.frombuffer(data, kind, n, at))
            at += parts[-1].nbytes
        self.seeds, self.prints, self.first, self.count, self.starts = parts

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for one that isn't there."""
        if not self.keys:
            return np.full(len(keys), -1)
        slot = find_slots(keys, self.seeds, self.keys)
        return np.where(self.prints[slot] == fingerprints(keys), slot, -1)


def index_bytes(keys: np.ndarray, starts: np.ndarray, width: int) -> bytes:
    """keys: of each row, equal ones together; starts: the rows' first ids and the end."""
    new = np.ones(len(keys), np.bool_)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    uniq, count = keys[at], np.diff(np.append(at, len(keys)))
    seeds, slot = build_index(uniq)
    prints, first, many = np.zeros(len(uniq), "<u4"), np.zeros(len(uniq), "<u4"), np.zeros(len(uniq), "<u4")
    prints[slot], first[slot], many[slot] = fingerprints(uniq), at, count
    head = np.zeros(8, "<u8")
    head[:5] = MAGIC, width, len(uniq), len(keys), len(seeds)
    return b"".join(x.tobytes() for x in (head, seeds.astype("<i4"), prints, first, many, starts.astype("<u8")))


# ---- writing and reading --------------------------------------------------


def write(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", path: str | None = None, end: int = END) -> DataFrame:
    """Write the shards; a stored table of them: shard, n_docs, n_tokens, first_key, last_key."""
    path = path or default_path()
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ranged = src.repartitionByRange(n, "key", "h").sortWithinPartitions("key", "h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        narrow = max(e.size, end + 1) <= 1 << 16
        last = np.array([end], "<u4").tobytes()
        shard = TaskContext.get().partitionId()
        keys, sizes = [], []

        def ids(out) -> None:
            for b in batches:
                keys.append(b.column("key").to_numpy())
                for t in b.column("text"):
                    data = e.encode(t.as_py()) + last
                    sizes.append(len(data) // 4)
                    out.write(np.frombuffer(data, "<u4").astype("<u2").tobytes() if narrow else data)

        replace_file(f"{folder}/ids-{shard}.bin", ids)
        forget(path)
        if not sizes:
            return
        own = np.concatenate(keys)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        replace_file(f"{folder}/ids-{shard}.mph", lambda out: out.write(index_bytes(own, starts, 2 if narrow else 4)))
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (shard, len(own), int(starts[-1]), int(own[0]), int(own[-1]))], names=["shard", "n_docs", "n_tokens", "first_key", "last_key"])

    return written(ranged.mapInArrow(lean(run), "shard long, n_docs long, n_tokens long, first_key long, last_key long"), "shards")[0]


def read(keys: DataFrame, shards: DataFrame, folder: str, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """key, start (ids of all documents before it), n_tokens, ids_crc32 (and ids) of every document with one of the keys, from the files.

    The shards' ranges and sums (five numbers a shard) go to every task; each reads the indexes of the shards that its keys fall in.
    """
    spark = keys.sparkSession
    table = sorted(tuple(r) for r in shards.select("first_key", "last_key", "shard", "n_tokens").collect())
    order = np.array([r[2] for r in table], np.int64)
    by_shard = np.argsort(order)
    base = np.zeros(len(table), np.int64)
    sums = np.array([table[i][3] for i in by_shard], np.int64)
    base[by_shard] = np.cumsum(sums) - sums if len(table) else 0
    # Shards in the order of their numbers are in the order of keys.
    firsts = np.array([table[i][0] for i in by_shard], np.int64)
    lasts = np.array([table[i][1] for i in by_shard], np.int64)
    names, bases = order[by_shard], base[by_shard]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = keys.select(F.col(key)).distinct().repartitionByRange(n, key).sortWithinPartitions(key)
    schema = src.select(key, *(F.lit(0).cast("long").alias(c) for c in ("start", "n_tokens", "ids_crc32")), *([F.lit(b"").alias("ids")] if with_ids else [])).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[int, tuple[Index, object]] = {}

        def shard(i: int):
            if i not in opened:
                opened.clear()
                system, at = file_system(f"{folder}/ids-{names[i]}.mph")
                with system.open_input_stream(at) as f:
                    index = Index(f.read())
                opened[i] = index, system.open_input_file(at.removesuffix("mph") + "bin")
            return opened[i]

        for b in batches:
            k = np.array([NULL_KEY if x is None else x for x in b.column(key).to_pylist()], np.int64)
            lo, hi = np.searchsorted(lasts, k, side="left"), np.searchsorted(firsts, k, side="right")
            rows = []
            for i in range(int(lo.min(initial=0)), int(hi.max(initial=0))):
                inside = np.flatnonzero((lo <= i) & (i < hi))
                if not len(inside):
                    continue
                index, data = shard(i)
                for at, slot in zip(inside.tolist(), index.find(k[inside]).tolist(), strict=True):
                    if slot < 0:
                        continue
                    first = int(index.first[slot])
                    for row in range(first, first + int(index.count[slot])):
                        a, z = int(index.starts[row]), int(index.starts[row + 1])
                        raw = data.read_at((z - a) * index.width, a * index.width)
                        ids = np.frombuffer(raw, f"<u{index.width}").astype("<u4").tobytes()
                        rows.append((at, int(bases[i]) + a, z - a, zlib.crc32(ids), ids))
            columns = [b.column(key).take(pa.array([r[0] for r in rows], pa.int64())), *(pa.array([r[j] for r in rows], pa.int64()) for j in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array([r[4] for r in rows], pa.binary())] * with_ids, names=schema.names)

    return src.mapInArrow(lean(run), schema)


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = qualified(spark, new_dir(spark, "token-store"))
    shards = write(docs.select("doc_id", "text"), folder)
    return read(docs.select("doc_id"), shards, folder)
