"""Is a packed corpus fit to train on: ordered checks, each a row; the first that fails names the reason.

Files, records and streams are checked in tables; only the report, a few rows for
each domain, reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswright.operators import streams
from corpuswright.operators.filters import DENIED_MARKERS
from corpuswright.sources.tables import written

#: A denied shard's name, tokens of a shard whose ids are looked at, formats of shards.
DENIED_NAME, SAMPLED, FORMATS = "000_00041", 8192, ("packed-v1",)
TEXT_FILES = "*.{json,jsonl,txt,yaml,yml}"


def denied_files(spark: SparkSession, folder: str) -> DataFrame:
    """path of files whose name or, if they are text, any line holds a denied marker."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path").where(F.contains("path", F.lit(DENIED_NAME)))
    hit = F.lit(False)
    for m in (*DENIED_MARKERS, f"{DENIED_NAME}.parquet"):
        hit |= F.contains("value", F.lit(m))
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", TEXT_FILES).text(folder).select("value", F.col("_metadata.file_path").alias("path"))
    return names.unionByName(lines.where(hit).select("path")).distinct()


def named(spark: SparkSession, patterns: list[str]) -> list[str]:
    """Files that match, in order; empty ones too, which Spark's readers leave out."""
    found = []
    for x in patterns:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x)
        found += [str(f.getPath()) for f in where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []]
    return sorted(found)


def checked_shards(spark: SparkSession, folder: str, records: DataFrame, vocabulary: int) -> DataFrame:
    """domain, split, file, problem of every record (null: none), the first that holds. records: domain, split, file, n_tokens, sha256, partial, format."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.bin").load(folder).select("path", "length", "content")
    part = lambda i: F.element_at(F.split("path", "/"), i)
    files = files.select(part(-2).alias("domain"), part(-3).alias("split"), part(-1).alias("file"), "length", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content = b.column("content").to_pylist()
            most = [int(np.frombuffer(x[: min(2 * SAMPLED, len(x) // 2 * 2)], "<u2").max(initial=0)) for x in content]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("domain", "split", "file", "length")), pa.array([hashlib.sha256(x).hexdigest() for x in content], pa.string()), pa.array(most, pa.int32())], names=["domain", "split", "file", "length", "found", "most"])

    found = files.mapInArrow(run, "domain string, split string, file string, length long, found string, most int")
    sides = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.bin.json").load(folder)
    sides = sides.select(part(-2).alias("domain"), part(-3).alias("split"), F.regexp_replace(part(-1), "[.]json$", "").alias("file"), F.lit(True).alias("has_side"))
    key = ["domain", "split", "file"]
    d = records.join(found, key, "left").join(sides, key, "left")
    n = F.coalesce("n_tokens", F.lit(0))
    problem = (
        F.when(F.col("length").isNull(), "missing")
        .when(n <= 0, "no tokens")
        .when(F.col("length") != 2 * n, "size")
        .when(F.coalesce("partial", F.lit(False)) | F.col("file").endswith(".partial.bin"), "partial")
        .when((F.coalesce("sha256", F.lit("")) != "") & (F.col("sha256") != F.col("found")), "hash")
        .when(F.col("has_side").isNull(), "no sidecar")
        .when(F.col("most") >= vocabulary, "id beyond the vocabulary")
        .when(F.col("format").isNotNull() & ~F.col("format").isin(*FORMATS), "format")
    )
    return d.select(*key, problem.alias("problem"))


def tokenizer_problem(spark: SparkSession, path: str, expected_sha: str | None, vocabulary: int) -> str | None:
    """What is wrong with a tokenizer file: missing, another digest, another vocabulary size."""
    import json

    rows = spark.read.format("binaryFile").option("pathGlobFilter", path.rsplit("/", 1)[-1]).load(path.rsplit("/", 1)[0]).select("content").take(1)
    if not rows:
        return "missing"
    raw = bytes(rows[0][0])
    if expected_sha and hashlib.sha256(raw).hexdigest() != expected_sha:
        return "hash"
    known = json.loads(raw)
    ids = [*known.get("model", {}).get("vocab", {}).values(), *(t["id"] for t in known.get("added_tokens", []))]
    return None if len(set(ids)) == vocabulary else "vocabulary"


def report(spark: SparkSession, folder: str, records: DataFrame, stats: DataFrame, quotas: DataFrame, canaries: DataFrame, tokenizer: str | None, vocabulary: int, least_train: float = 0.999, least_val: float = 0.99) -> DataFrame:
    """ord, domain, gate, ok, detail of every check, in order.

    records: see checked_shards. stats: domain, status, tokens_train, tokens_val,
    docs_inspected, docs_duplicate. quotas: domain, train_quota, val_quota.
    canaries: verdict of every entry of the deny list. tokenizer: its problem.
    """
    whole = lambda n, gate, ok, detail: spark.range(1).select(F.lit(n).cast("long").alias("ord"), F.lit(None).cast("string").alias("domain"), F.lit(gate).alias("gate"), F.lit(bool(ok)).alias("ok"), F.lit(detail).cast("string").alias("detail"))
    denied = denied_files(spark, folder).agg(F.min("path")).first()[0]
    under, left = (next(iter(named(spark, [f"{folder}/{x}" for x in where])), None) for where in (("{train,val}/*.partial.bin", "{train,val}/*/*.partial.bin"), ("state/*.partial.bin",)))
    n, passed = canaries.agg(F.count(F.lit(1)), F.count_if(~F.col("verdict").eqNullSafe(F.lit("denied")))).first()
    rows = [whole(1, "no_denied_marker", denied is None, denied), whole(2, "deny_list_active", n > 0 and passed == 0, None if n else "empty"), whole(3, "no_partial_shards", under is None, under), whole(4, "no_partial_buffers", left is None, left), whole(5, "tokenizer", tokenizer is None, tokenizer)]

    shard_rows = streams.shards(spark, folder)
    docs = written(streams.documents(shard_rows).drop("data"), "documents")
    audited = streams.audit(docs, shard_rows)
    of = lambda split, column, alias: F.max(F.when(F.col("split") == split, F.col(column))).alias(alias)
    repeats = audited.groupBy("domain").agg(of("train", "first_collision", "again_train"), of("val", "first_collision", "again_val"))
    leaked = streams.leaks(docs).groupBy("domain").agg(F.count(F.lit(1)).alias("leaks"))
    shards = checked_shards(spark, folder, records, vocabulary)
    bad = shards.groupBy("domain").agg(F.min(F.when(F.col("problem").isNotNull(), F.concat_ws(" ", "split", "file", "problem"))).alias("bad"), F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "val").alias("n_val"))
    files = shard_rows.groupBy("domain").agg(F.count_if(F.col("split") == "train").alias("f_train"), F.count_if(F.col("split") == "val").alias("f_val"))
    d = quotas.join(stats, "domain", "left")
    for other in (repeats, leaked, bad, files):
        d = d.join(other, "domain", "left")
    # A row a domain, read twice below: streams and shards are read and hashed once.
    d = written(d, "gates")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))

    def gate(name: str, ok: Column, detail: Column) -> Column:
        return F.struct(F.lit(name).alias("gate"), F.coalesce(ok, F.lit(False)).alias("ok"), F.when(~F.coalesce(ok, F.lit(False)), detail.cast("string")).alias("detail"))

    gates = F.array(
        gate("complete", F.col("status") == "complete", F.col("status")),
        gate("train_quota", zero("tokens_train") >= F.floor(F.col("train_quota") * least_train), zero("tokens_train")),
        gate("val_quota", zero("tokens_val") >= F.floor(F.col("val_quota") * least_val), zero("tokens_val")),
        gate("has_shards", (zero("n_train") > 0) & (zero("n_val") > 0), F.lit("none")),
        gate("shard_count", (zero("n_train") == zero("f_train")) & (zero("n_val") == zero("f_val")), F.concat_ws(" ", "n_train", "f_train", "n_val", "f_val")),
        gate("shards", F.col("bad").isNull(), F.col("bad")),
        gate("unique_train", F.col("again_train").isNull(), F.col("again_train")),
        gate("unique_val", F.col("again_val").isNull(), F.col("again_val")),
        gate("no_leak", zero("leaks") == 0, zero("leaks")),
    )
    by_domain = d.select("domain", F.posexplode(gates).alias("k", "g")).select(F.col("domain").alias("of"), "k", "g.*")
    order = quotas.groupBy().agg(F.array_sort(F.collect_list("domain")).alias("all"))  # a handful of domains
    by_domain = by_domain.join(F.broadcast(order), F.lit(True)).select((F.array_position("all", F.col("of")) * 100 + F.col("k")).alias("ord"), F.col("of").alias("domain"), "gate", "ok", "detail")
    total = d.agg(F.sum(zero("tokens_train")).alias("t"), F.sum("train_quota").alias("q"))
    total = total.select(F.lit(1 << 40).cast("long").alias("ord"), F.lit(None).cast("string").alias("domain"), F.lit("train_total").alias("gate"), (F.col("t") >= F.floor(F.col("q") * least_train)).alias("ok"), F.when(F.col("t") < F.floor(F.col("q") * least_train), F.col("t").cast("string")).alias("detail"))
    out = rows[0]
    for r in (*rows[1:], by_domain, total):
        out = out.unionByName(r)
    return written(out, "report")


def require(report_: DataFrame) -> None:
    """ValueError that names the first check that fails, if any does."""
    first = report_.where("not ok").orderBy("ord").select("domain", "gate", "detail").take(1)
    if first:
        raise ValueError(" ".join(x for x in (first[0].domain, first[0].gate, first[0].detail) if x))
