"""State of a packing run that may stop at any moment: small JSON files, partial buffers, records from the shards on disk.

JSON files are written under another name and moved.  A stream's packing goes on
from its state: the next shard's number, how far the documents are consumed, and
the tokens that fill no shard yet, in a partial buffer whose name the state holds.
Shards that a broken run wrote beyond its state are written again under the same
names, so runs that were broken off give the same shards as one whole run.

Defined results: a missing or damaged state begins anew; a final call drops the
tokens that fill no block and the buffer; no documents change nothing.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswright.operators.packing import shard_width
from corpuswright.operators.prefix import prefix_sum
from corpuswright.sources.shards import write_parts


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def write_bytes(spark: SparkSession, path: str, body: bytes) -> None:
    """The whole file or nothing."""
    fs, where = _fs(spark, path)
    fs.mkdirs(where.getParent())
    part = _fs(spark, f"{path}.{uuid.uuid4().hex}")[1]
    out = fs.create(part, True)
    out.write(bytearray(body))
    out.close()
    if fs.exists(where):
        fs.delete(where, False)
    fs.rename(part, where)


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    write_bytes(spark, path, (json.dumps(value, sort_keys=True) + "\n").encode())


def read_json(spark: SparkSession, path: str) -> dict | None:
    """The object in a file; None if it is missing or damaged."""
    fs, where = _fs(spark, path)
    if not fs.exists(where):
        return None
    rows = spark.read.text(path, wholetext=True).collect()
    try:
        value = json.loads(rows[0][0]) if rows else None
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def append_ledger(rows: DataFrame, folder: str, checked_at: str) -> None:
    """Append what was read to the ledger, one JSON row a file. rows: dataset_id, revision, path, sha256, size, security_status, av_status; config, local_sha256, local_bytes where known."""
    known = lambda c, kind: F.col(c).cast(kind) if c in rows.columns else F.lit(None).cast(kind)
    out = rows.select(
        "dataset_id", known("config", "string").alias("config"), "revision", "path", F.col("sha256").alias("upstream_hash"), "size", "security_status", "av_status", F.lit(checked_at).alias("timestamp_checked"), known("local_sha256", "string").alias("local_sha256"), known("local_bytes", "long").alias("local_bytes"),
    )
    out.write.mode("append").option("ignoreNullFields", False).json(folder)


def shard_records(spark: SparkSession, folder: str) -> DataFrame:
    """The sidecars' rows under a folder, which outlive a lost state; damaged ones are left out."""
    schema = "file string, n_tokens long, sha256 string, dtype string, endian string, domain string, split string, creation_order long, n_documents long"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).option("pathGlobFilter", "shard-*.bin.json").json(folder).where("file is not null")


def write_partial(spark: SparkSession, folder: str, name: str, data: bytes, n_documents: int) -> None:
    """A buffer and its sidecar; no tokens remove both."""
    if not data:
        drop_partial(spark, folder, name)
        return
    write_bytes(spark, f"{folder}/{name}.partial.bin", data)
    write_json(spark, f"{folder}/{name}.partial.bin.json", {"n_tokens": len(data) // 2, "sha256": hashlib.sha256(data).hexdigest(), "partial": True, "n_documents": n_documents, "creation_order": -1})


def read_partial(spark: SparkSession, folder: str, name: str) -> tuple[bytes, int]:
    """The tokens and documents of a buffer; none if it is missing."""
    path = f"{folder}/{name}.partial.bin"
    fs, where = _fs(spark, path)
    if not fs.exists(where):
        return b"", 0
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    return data, int((read_json(spark, f"{path}.json") or {}).get("n_documents", 0))


def drop_partial(spark: SparkSession, folder: str, name: str) -> None:
    for end in ("bin", "bin.json"):
        fs, where = _fs(spark, f"{folder}/{name}.partial.{end}")
        fs.delete(where, False)


def pack_on(spark: SparkSession, docs: DataFrame, folder: str, domain: str, split: str, shard_tokens: int, length: int, final: bool = False) -> dict:
    """Pack the documents of a stream that its state has not consumed; returns the new state.

    docs: seq, data (tokens with the end token). While the tokens at hand reach
    shard_tokens, whole blocks of them make a shard; a final call makes one of what is left.
    """
    width, block = shard_width(shard_tokens, length), length + 1
    state_path = f"{folder}/state/{domain}.{split}.json"
    state = read_json(spark, state_path) or {"next_shard": 0, "consumed": None, "partial": None, "n_documents": 0, "status": "in_progress"}
    if state["status"] == "complete":
        return state
    carry = read_partial(spark, f"{folder}/state", state["partial"])[0] if state["partial"] else b""
    new = docs if state["consumed"] is None else docs.where(F.col("seq") > state["consumed"])
    had = new.agg(F.count(F.lit(1)), F.max("seq"), F.coalesce(F.sum(F.expr("octet_length(data) div 2")), F.lit(0))).first()
    total = len(carry) // 2 + had[2]
    full = 0 if total < shard_tokens else (total - shard_tokens) // width + 1
    ends = [width * (i + 1) for i in range(full)]
    if final and (total - width * full) // block:
        ends.append(width * full + (total - width * full) // block * block)
    used = ends[-1] if ends else 0
    rows = prefix_sum(new.select(F.lit(0).alias("one"), "seq", "data", F.expr("octet_length(data) div 2").alias("n")), ["one"], "seq", "n", "offset").withColumn("offset", F.col("offset") + len(carry) // 2)
    ahead = spark.createDataFrame([(0, None, bytearray(carry), len(carry) // 2, 0)], rows.select("one", "seq", "data", "n", "offset").schema)
    rows = ahead.unionByName(rows.select("one", "seq", "data", "n", "offset")).where("n > 0")

    def cut(low, high):
        a, z = F.greatest(F.col("offset"), low), F.least(F.col("offset") + F.col("n"), high)
        return a.alias("place"), F.substring("data", (2 * (a - F.col("offset")) + 1).cast("int"), (2 * (z - a)).cast("int")).alias("data"), F.when(F.col("seq").isNotNull() & (z == F.col("offset") + F.col("n")), 1).otherwise(0).alias("docs")

    first = state["next_shard"]
    if ends:
        last = F.least(F.col("offset") + F.col("n"), F.lit(used)) - 1
        parts = rows.where(F.col("offset") < used).withColumn("nth", F.explode(F.sequence(F.floor(F.col("offset") / width), F.floor(last / width))))
        place, data, done = cut(F.col("nth") * width, F.least((F.col("nth") + 1) * width, F.lit(used)))
        parts = parts.select(F.lit(domain).alias("domain"), F.lit(split).alias("split"), (F.col("nth") + first).alias("nth"), place, data, done)
        written = write_parts(parts, folder).agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
        if written != used:
            raise RuntimeError(f"{domain} {split}: {written} of {used} tokens written")
    rest, waiting = b"", 0
    if not final:
        # Less than one shard's tokens.
        place, data, done = cut(F.lit(used), F.lit(total))
        tail = rows.where(F.col("offset") + F.col("n") > used).select(place, data, done).collect()
        rest = b"".join(bytes(r.data) for r in sorted(tail, key=lambda r: r.place))
        waiting = sum(r.docs for r in tail)
    old, name = state["partial"], f"{domain}.{split}.{first + len(ends)}.{uuid.uuid4().hex[:8]}" if rest else None
    if name:
        write_partial(spark, f"{folder}/state", name, rest, waiting)
    state = {"next_shard": first + len(ends), "consumed": had[1] if had[0] else state["consumed"], "partial": name, "n_documents": state["n_documents"] + had[0], "status": "complete" if final else "in_progress"}
    write_json(spark, state_path, state)
    if old:
        drop_partial(spark, f"{folder}/state", old)
    return state
