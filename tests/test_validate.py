"""The ordered checks of a packed corpus, isolated encoding, listing guards."""

import hashlib
import json
import shutil
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuswright.operators import admission, filters, isolated, validate
from corpuswright.plans import catalogue
from corpuswright.sources import listing, scans, state

END = 2


def put(folder, split, domain, ids, **other):
    where = folder / split / domain
    where.mkdir(parents=True, exist_ok=True)
    raw = np.array(ids, "<u2").tobytes()
    nth = len(list(where.glob("shard-*.bin")))
    (where / f"shard-{nth:05d}.bin").write_bytes(raw)
    row = {"file": f"shard-{nth:05d}.bin", "n_tokens": len(ids), "sha256": hashlib.sha256(raw).hexdigest(), "domain": domain, "split": split, "creation_order": nth} | other
    (where / f"shard-{nth:05d}.bin.json").write_text(json.dumps(row))


def document(seed, n=40):
    return [3 + (seed * 37 + i * i) % 190 for i in range(n)] + [END]


@pytest.fixture
def corpus(tmp_path):
    for k, domain in enumerate(("a", "b")):
        put(tmp_path, "train", domain, document(10 * k + 1) + document(10 * k + 2)[:20])
        put(tmp_path, "train", domain, document(10 * k + 2)[20:] + document(10 * k + 3) + document(90, 5) + document(90, 5))
        put(tmp_path, "val", domain, document(10 * k + 4))
    (tmp_path / "notes.txt").write_text("all is well\n")
    return tmp_path


def failing(spark, folder, quotas=(100, 40), status="complete", canaries=True, tokenizer=None, change=None):
    records = state.shard_records(spark, f"file://{folder}").withColumn("partial", F.lit(False)).withColumn("format", F.lit("packed-v1"))
    of = lambda k: F.coalesce(F.sum(F.when(F.col("split") == k, F.col("n_tokens"))), F.lit(0)).alias(f"tokens_{k}")
    stats = records.groupBy("domain").agg(of("train"), of("val")).withColumn("status", F.when(F.col("domain") == "b", status).otherwise("complete"))
    wanted = spark.createDataFrame([(d, *quotas) for d in ("a", "b")], "domain string, train_quota long, val_quota long")
    deny = spark.createDataFrame(catalogue.DENY if canaries else [], catalogue.DENY_SCHEMA)
    judged = admission.canaries(deny, spark.createDataFrame(catalogue.LOCK, catalogue.LOCK_SCHEMA))
    report = validate.report(spark, f"file://{folder}", change(records) if change else records, stats, wanted, judged, tokenizer, 200)
    rows = report.orderBy("ord").collect()
    assert len(rows) == 6 + 2 * 9 and len({r.ord for r in rows}) == len(rows)
    bad = [(r.domain, r.gate) for r in rows if not r.ok]
    if bad:
        with pytest.raises(ValueError, match=bad[0][1]):
            validate.require(report)
    else:
        validate.require(report)
    return bad


def test_a_good_corpus_passes(spark, corpus):
    assert failing(spark, corpus) == []  # short repeats are no failure


def test_whole_corpus_checks(spark, corpus):
    (corpus / "state").mkdir()
    (corpus / "state" / "a.partial.bin").write_bytes(b"\1\2")
    assert failing(spark, corpus, canaries=False, tokenizer="hash") == [(None, "deny_list_active"), (None, "no_partial_buffers"), (None, "tokenizer")]
    shutil.rmtree(corpus / "state")
    (corpus / "notes.txt").write_text("first\nread data/CC-MAIN-2024-38/000_00041.parquet here\n")
    (corpus / "train" / "a" / "x.partial.bin").write_bytes(b"")
    assert failing(spark, corpus)[:2] == [(None, "no_denied_marker"), (None, "no_partial_shards")]


def test_domain_checks(spark, corpus):
    assert failing(spark, corpus, quotas=(150, 60), status="in_progress") == [("a", "train_quota"), ("a", "val_quota"), ("b", "complete"), ("b", "train_quota"), ("b", "val_quota"), (None, "train_total")]
    put(corpus, "train", "b", document(4))
    put(corpus, "train", "a", document(1) + document(4, 45)[:-1] + [END])
    assert failing(spark, corpus) == [("a", "unique_train")]
    put(corpus, "val", "b", document(11))
    assert failing(spark, corpus) == [("a", "unique_train"), ("b", "no_leak")]


@pytest.mark.parametrize(
    ("problem", "change"),
    [
        ("missing", lambda f, r: r.withColumn("file", F.when((F.col("domain") == "a") & (F.col("split") == "val"), "gone.bin").otherwise(F.col("file")))),
        ("no tokens", lambda f, r: r.withColumn("n_tokens", F.when(F.col("split") == "val", 0).otherwise(F.col("n_tokens")))),
        ("size", lambda f, r: r.withColumn("n_tokens", F.col("n_tokens") + 1)),
        ("partial", lambda f, r: r.withColumn("partial", F.lit(True))),
        ("hash", lambda f, r: r.withColumn("sha256", F.lit("ab"))),
        ("format", lambda f, r: r.withColumn("format", F.lit("other"))),
    ],
)
def test_records(spark, corpus, problem, change):
    records = state.shard_records(spark, f"file://{corpus}").withColumn("partial", F.lit(False)).withColumn("format", F.lit(None).cast("string"))
    got = [r.problem for r in validate.checked_shards(spark, f"file://{corpus}", change(corpus, records), 200).collect()]
    assert problem in got and set(got) <= {problem, None}
    assert ("a", "shards") in failing(spark, corpus, change=lambda r: change(corpus, r))


def test_sidecars_and_ids(spark, corpus):
    records = state.shard_records(spark, f"file://{corpus}").withColumn("partial", F.lit(False)).withColumn("format", F.lit(None).cast("string"))
    rows = spark.createDataFrame(records.collect(), records.schema)
    (corpus / "train" / "a" / "shard-00000.bin.json").unlink()
    problems = lambda n: sorted(r.problem or "" for r in validate.checked_shards(spark, f"file://{corpus}", rows, n).collect())
    assert problems(200) == [""] * 5 + ["no sidecar"] and problems(150).count("id beyond the vocabulary") >= 3
    put(corpus, "train", "c", [5] * validate.SAMPLED + [199])
    late = state.shard_records(spark, f"file://{corpus}").where("domain = 'c'").withColumn("partial", F.lit(False)).withColumn("format", F.lit(None).cast("string"))
    assert [r.problem for r in validate.checked_shards(spark, f"file://{corpus}", late, 100).collect()] == [None], "only the first ids are looked at"


def test_tokenizer(spark, tmp_path):
    body = json.dumps({"model": {"vocab": {"a": 0, "b": 1}}, "added_tokens": [{"id": 2, "content": "</s>"}]}).encode()
    (tmp_path / "tokenizer.json").write_bytes(body)
    check = lambda sha, n, name="tokenizer.json": validate.tokenizer_problem(spark, f"file://{tmp_path}/{name}", sha, n)
    assert check(None, 3) is None and check(hashlib.sha256(body).hexdigest(), 3) is None and check("ab", 3) == "hash" and check(None, 4) == "vocabulary" and check(None, 3, "none.json") == "missing"


WORKER = """
import os, struct, sys, time
while len(head := sys.stdin.buffer.read(4)) == 4:
    text = sys.stdin.buffer.read(struct.unpack("<I", head)[0]).decode()
    if text == "crash":
        os.abort()
    if text == "hang":
        time.sleep(60)
    ids = [70000] if text == "large" else [len(w) for w in text.split()]
    sys.stdout.buffer.write(struct.pack("<I", 4 * len(ids)) + struct.pack(f"<{len(ids)}I", *ids))
    sys.stdout.buffer.flush()
"""


def test_a_crash_costs_one_text(tmp_path):
    e = isolated.Encoder([sys.executable, "-c", WORKER], timeout=1.5)
    assert [e.encode(x) for x in ("a bc", "crash", "def", "hang", "", "large", "é" * 3, "x " * 200_000)] == [[1, 2], None, [3], None, [], None, [3], [1] * 200_000]
    assert e.restarts == 2
    e.close()
    assert isolated.Encoder(["/bin/false"]).encode("a") is None


def test_isolated_ids_equal_the_library(spark, sf):
    import public_tokenizers

    from corpuswright.operators import tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(40).unionByName(spark.createDataFrame([(-1, None), (-2, "  ")], "doc_id long, text string"))
    both = [{r.doc_id: r.ids for r in f(df, path).collect()} for f in (isolated.encode, tokens.encode)]
    assert both[0] == both[1] and both[0][-1] == both[0][-2] == []


def test_listing(spark, tmp_path):
    with pytest.raises(ValueError, match="may not be listed"):
        listing.check_prefix(spark, "HuggingFaceFW/fineweb-edu", "data/CC-MAIN-2020")
    with pytest.raises(ValueError, match="may not be listed"):
        listing.check_prefix(spark, " ", "")
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name in ("a.parquet", "deep/b.parquet", "c.txt"):
        (tmp_path / "in" / name).write_bytes(b"xyz")
    files = listing.folder_files(spark, f"file://{tmp_path}/in", "own/data")
    assert sorted((r.path, r.size) for r in listing.listed(files, "own/data", "").collect()) == [("a.parquet", 3), ("deep/b.parquet", 3)]
    empty, full = spark.range(0), spark.range(2)
    assert listing.first_with_rows([empty, full, spark.range(5)]).count() == 2 and listing.first_with_rows([empty, empty]).count() == 0
    rows = spark.createDataFrame([(3, 0, "k", "s2ag", "t"), (3, 1, None, "s2orc", " "), (3, 2, None, None, "u")], "shard int, row_index long, id string, source string, text string")
    assert sorted(r.native_id for r in listing.paper_rows(rows, [3, 12]).collect()) == ["k", "row:3:2"]


def test_counters_conserve_documents(spark, sf):
    d = catalogue.QUERIES["row_filters_counters"](spark, sf).collect()
    assert d and all(r.inspected == r.accepted_train + r.accepted_val + r.duplicate + r.skipped + r.unencodable for r in d)
    rows = spark.createDataFrame([("a", i, i % 3 == 0, i % 5 == 0, i % 2 == 0) for i in range(90)], "g string, n long, dup boolean, bad boolean, val boolean")
    ok = ~F.col("dup") & ~F.col("bad") & (F.col("n") < 60)
    r = filters.counters(rows, "g", ok, F.col("val"), F.col("dup"), F.col("bad"), F.col("n")).first()
    assert r.inspected == 90 == r.accepted_train + r.accepted_val + r.duplicate + r.skipped + r.unencodable and r.duplicate == 30 and r.unencodable == 12 and r.skipped == 16


def test_full_dump_paths(spark):
    rows = [("HuggingFaceFW/FineWeb-Edu", "data\\CC-MAIN-1/x", True), ("huggingfacefw/fineweb-edu", "data/CC-MAIN-2", True), ("x/fineweb-edu-y", "data/cc-main", False), ("other", "data/CC-MAIN-2", False), (None, "data/CC-MAIN", False), ("fineweb-edu", None, False)]
    df = spark.createDataFrame(rows, "d string, p string, wanted boolean")
    assert df.where(~filters.is_full_dump_path(F.col("d"), F.col("p")).eqNullSafe(F.col("wanted"))).count() == 0


def test_long_lines_and_skips(spark, tmp_path, monkeypatch):
    import gzip

    monkeypatch.setattr(scans, "LONGEST_LINE", 200)
    lines = [json.dumps({"text": f"t{i}" if i % 4 else "x" * 300}) for i in range(12)] + ["{broken", ""]
    (tmp_path / "a.json.gz").write_bytes(gzip.compress("\n".join(lines).encode()))
    (tmp_path / "b.json").write_text("\n".join(lines))
    packed = scans.text_table(spark, f"file://{tmp_path}/a.json.gz", "general", "d")
    assert sorted(r.text for r in packed.collect()) == sorted(f"t{i}" for i in range(12) if i % 4)
    plain = scans.text_table(spark, f"file://{tmp_path}/b.json", "general", "d")
    assert plain.count() == 12
    rest = scans.union_all([plain, packed], skip=5)
    assert rest.where("source_ord = 0").count() == 7 and rest.where("source_ord = 1").count() == 9
    assert scans.union_all([plain, packed], skip=50).where("source_ord = 0").count() == 0
