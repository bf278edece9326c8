"""WARC archives: writing, normalising monolithic gzip files, keyed reading.

``write`` makes archives of response and revisit records, each file one gzip
stream from end to end, as some crawlers leave them.  ``normalise`` inflates
such a file once, in bounded memory, rewrites every record as a gzip member of
its own and writes a sidecar index, one line a record: offset and length of the
member, record type, record id.  ``read`` seeks to each member by the index.

Records with equal payloads of ``REVISIT_BYTES`` or more have one response, that
with the least key; the others are revisits that carry its id, the payload's
digest and its length, but no payload.

Defined results: null html is the empty payload; a null key is greater than any
other and written as ``null``; of rows with equal keys and payloads one
is the response; records of one file come in the order of keys; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswright.llm.store import file_system, free_shuffles, lean, new_dir, qualified, replace_file, written

REVISIT_BYTES = 100
LEVEL = 6
CHUNK = 1 << 20
NULL_KEY = (1 << 63) - 1
URN = "urn:corpuswright:page:"
DATE = "2024-01-01T00:00:00Z"


def record(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC/1.1 record whose block is an HTTP response; a revisit's has no body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = "null" if key is None else str(key)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{URN}{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{URN}{'null' if refers_to is None else refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def inflated(stream) -> Iterator[bytes]:
    """The content of a gzip file of any number of members, piece by piece."""
    z = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            out = z.decompress(data, CHUNK)
            if out:
                yield out
            if z.eof:
                data, z = z.unused_data, zlib.decompressobj(31)
            else:
                data = z.unconsumed_tail
    tail = z.flush()
    if tail:
        yield tail


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) one after another; memory holds one record and one piece."""
    buffer = bytearray()
    need, headers = None, {}
    for piece in pieces:
        buffer += piece
        while True:
            if need is None:
                end = buffer.find(b"\r\n\r\n")
                if end < 0:
                    break
                headers = parse_head(bytes(buffer[:end]))
                need = end + 4 + int(headers["content-length"]) + 4
            if len(buffer) < need:
                break
            yield headers, bytes(buffer[:need])
            del buffer[:need]
            need = None
    if buffer:
        raise ValueError("the archive ends inside a record")


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the archives; a stored table of their numbers and record counts."""
    data = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    # A null key is the greatest.
    k = F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY))
    slim = pages.select(k.alias("k2"), F.sha2(data, 256).alias("digest2"), F.octet_length(data).alias("n")).where(F.col("n") >= REVISIT_BYTES)
    shared = slim.groupBy("digest2").agg(F.min("k2").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").select("digest2", "first")
    # Written, so that the join has a shuffle on both sides and a payload that outgrows a task can be split over several.
    shared, _ = written(shared, "shared")
    of = slim.join(shared, "digest2").select("k2", "digest2", "first").distinct()
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pages.select(k.alias("k"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"), F.sha2(data, 256).alias("digest")).repartition(n, "k", "digest")
    # Rows with equal keys and payloads stand together in one task, so that the first of them can be told.
    rows = rows.join(of, (F.col("k") == F.col("k2")) & (F.col("digest") == F.col("digest2")), "left").select("k", "url", "html", "digest", "first").sortWithinPartitions("k", "digest", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, count = TaskContext.get().partitionId(), 0

        def archive(out) -> None:
            nonlocal count
            z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            before = None
            for b in batches:
                for k, u, h, digest, first in zip(*(b.column(c).to_pylist() for c in ("k", "url", "html", "digest", "first")), strict=True):
                    revisit = first is not None and (k != first or before == (k, digest))
                    before = (k, digest)
                    k, first = (None if x == NULL_KEY else x for x in (k, first))
                    out.write(z.compress(record(k, u, h.encode("utf-8", "surrogatepass"), digest, first if revisit else None, revisit)))
                    count += 1
            out.write(z.flush())

        replace_file(f"{folder}/crawl-{shard}.warc.gz", archive)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([count], pa.int64())], names=["archive", "records"])

    return written(rows.mapInArrow(lean(run), "archive long, records long"), "archives")[0]


def normalise(archives: DataFrame, folder: str, keep_monolithic: bool = True) -> DataFrame:
    """Rewrite ``crawl-N.warc.gz`` as ``pages-N.warc.gz``, a member a record, with ``pages-N.idx``; a stored table of numbers and counts. Without keep_monolithic an old file goes once its new ones are in place."""
    spark = archives.sparkSession
    free_shuffles(spark)  # of the pages, which write() dealt out
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, expected in zip(b.column("archive").to_pylist(), b.column("records").to_pylist(), strict=True):
                index: list[str] = []
                system, old = file_system(f"{folder}/crawl-{shard}.warc.gz")
                if system.get_file_info(old).type.name == "NotFound":
                    # Rewritten by an attempt whose answer was lost.
                    with system.open_input_stream(old.replace("crawl-", "pages-").removesuffix("warc.gz") + "idx") as f:
                        found = f.read().count(b"\n")
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([found], pa.int64())], names=["archive", "records"])
                    continue

                def members(out, shard=shard, index=index) -> None:
                    system, path = file_system(f"{folder}/crawl-{shard}.warc.gz")
                    at = 0
                    with system.open_input_stream(path, compression=None) as f:
                        for head, whole in records(inflated(f)):
                            z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                            member = z.compress(whole) + z.flush()
                            out.write(member)
                            index.append(f"{at} {len(member)} {head['warc-type']} {head['warc-record-id']}\n")
                            at += len(member)

                replace_file(f"{folder}/pages-{shard}.warc.gz", members)
                if len(index) != expected:
                    raise ValueError(f"archive {shard}: {len(index)} records, {expected} written")
                replace_file(f"{folder}/pages-{shard}.idx", lambda out, index=index: out.write("".join(index).encode()))
                if not keep_monolithic:
                    system.delete_file(old)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([len(index)], pa.int64())], names=["archive", "records"])

    return written(archives.repartition(n, "archive").mapInArrow(lean(run), "archive long, records long"), "normalised")[0]


_ROW = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(archives: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """A row of every record, by the index: page_id, payload_bytes, payload_digest, record_type, refers_to (url and payload on wish)."""
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = lambda urn: None if urn.endswith(":null>") else int(urn.removeprefix(f"<{URN}").rstrip(">"))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["url", "payload"] * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in b.column("archive").to_pylist():
                system, path = file_system(f"{folder}/pages-{shard}.idx")
                with system.open_input_stream(path) as f:
                    lines = f.read().decode().splitlines()
                rows: list[tuple] = []
                with system.open_input_file(path.removesuffix("idx") + "warc.gz") as f:
                    for line in lines:
                        at, size, _, _ = line.split(" ", 3)
                        whole = zlib.decompress(f.read_at(int(size), int(at)), 31)
                        end = whole.index(b"\r\n\r\n")
                        head = parse_head(whole[:end])
                        block = whole[end + 4 : end + 4 + int(head["content-length"])]
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        digest, size = head["warc-payload-digest"].removeprefix("sha256:"), int(head["x-payload-length"])
                        revisit = head["warc-type"] == "revisit"
                        if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"archive {shard}: a payload differs from its digest")
                        rows.append((number(head["warc-record-id"]), size, digest, head["warc-type"], number(head["warc-refers-to"]) if revisit else None, head["warc-target-uri"], payload))
                        if len(rows) >= 500:
                            yield batch(rows)
                            rows = []
                yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names=names)

    return archives.repartition(n, "archive").mapInArrow(lean(run), _ROW + ", url string, payload binary" * with_payload)


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = qualified(spark, new_dir(spark, "warc"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return read(normalise(write(pages, folder), folder, keep_monolithic=False), folder)
