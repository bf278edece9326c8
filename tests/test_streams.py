"""Packed streams over several shards, against sequential versions on lists of tokens."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuswright.operators import streams
from corpuswright.sources import shards, state

END, LENGTH = 2, 15


def plain_documents(parts):
    """(shard it ends in, digest, n) of documents over all shards, the tokens left open, and the shards that were given some."""
    out, carry, stitched = [], [], 0
    for k, ids in enumerate(parts):
        stitched += bool(carry)
        data, start = carry + ids, 0
        for i, x in enumerate(data):
            if x == END:
                if i > start:
                    span = np.array(data[start:i], "<u2").tobytes()
                    out.append((k, hashlib.sha256(span).hexdigest(), i - start))
                start = i + 1
        carry = data[start:]
    return out, carry, stitched


def plain_audit(parts):
    docs, carry, stitched = plain_documents(parts)
    seen, n, short, first = {}, 0, 0, None
    for k, d, size in docs:
        if d in seen:
            n += 1
            if min(size, seen[d]) >= streams.SUBSTANTIAL:
                first = k if first is None else first
            else:
                short += 1
        seen.setdefault(d, size)
    return {"n_shards": len(parts), "n_docs": len(docs), "n_unique": len(seen), "n_collisions": n, "n_short_collisions": short, "n_stitched_shards": stitched, "n_unclosed_tokens": len(carry), "first_collision": first}


def plain_pack(docs, rest, shard_tokens):
    """Shards of documents appended one by one, as a buffer fills."""
    block, out, buffer = LENGTH + 1, [], []
    for ids in [*docs, rest]:
        buffer = buffer + list(ids)
        while len(buffer) >= shard_tokens:
            n = shard_tokens // block * block
            out.append(buffer[:n])
            buffer = buffer[n:]
    n = len(buffer) // block * block
    return out + [buffer[:n]] * (n > 0)


def plain_repair(parts, drop, shard_tokens):
    docs, rest, seen = [], [], set()
    carry = []
    for ids in parts:
        data, start = carry + ids, 0
        for i, x in enumerate(data):
            if x == END:
                d = hashlib.sha256(np.array(data[start:i], "<u2").tobytes()).hexdigest()
                if i > start and d not in seen and d not in drop:
                    seen.add(d)
                    docs.append(data[start : i + 1])
                start = i + 1
        carry = data[start:]
    return plain_pack(docs, carry, shard_tokens)


def put(folder, streams_):
    for (split, domain), parts in streams_.items():
        (folder / split / domain).mkdir(parents=True)
        for k, ids in enumerate(parts):
            (folder / split / domain / f"shard-{k:05d}.bin").write_bytes(np.array(ids, "<u2").tobytes())


def get(folder):
    out = {}
    for f in sorted(folder.glob("*/*/shard-*.bin")):
        out.setdefault((f.parts[-3], f.parts[-2]), []).append(np.frombuffer(f.read_bytes(), "<u2").tolist())
    return out


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    r = random.Random(5)
    base = [[r.randint(3, 900) for _ in range(r.choice([1, 5, 31, 32, 40, 200]))] for _ in range(30)]

    def stream(n, size):
        ids = []
        for _ in range(n):
            ids += r.choice(base) + [END] * r.choice([1, 1, 1, 2])
        ids += base[0][:3] if r.random() < 0.7 else []
        cuts = [i for i in range(0, len(ids), size)]
        return [ids[i : i + size] for i in cuts]

    made = {("train", "a"): stream(60, 160), ("val", "a"): stream(9, 96), ("train", "b"): stream(40, 64), ("val", "b"): [[5] * 64, [6] * 64, [7] * 10 + [END] + [8] * 53], ("train", "c"): [[9] * 16, [9] * 16], ("val", "c"): [[11, END] * 40]}
    folder = tmp_path_factory.mktemp("packed")
    put(folder, made)
    (folder / "train" / "a" / "x.partial.bin").write_bytes(b"\1\2")
    return folder, made


def test_documents_and_audit(spark, corpus):
    folder, made = corpus
    rows = streams.shards(spark, f"file://{folder}")
    docs = streams.documents(rows)
    got = {}
    for x in docs.where("closed").orderBy("shard", "at").collect():
        got.setdefault((x.split, x.domain), []).append((x.shard, x.digest, x.n_tokens))
    for k, parts in made.items():
        assert got.get(k, []) == plain_documents(parts)[0], k
    for x in streams.audit(docs.drop("data"), rows).collect():
        assert {c: x[c] for c in x.asDict() if c not in ("domain", "split")} == plain_audit(made[x.split, x.domain]), (x.split, x.domain)
    leaked = {(x.domain, x.digest): x.substantial for x in streams.leaks(docs).collect()}
    wanted = {}
    for domain in "abc":
        a, b = ({d: n for _, d, n in reversed(plain_documents(made[s, domain])[0])} for s in ("train", "val"))
        wanted |= {(domain, d): min(a[d], b[d]) >= streams.SUBSTANTIAL for d in a if d in b}
    assert leaked == wanted and wanted


def test_repair(spark, corpus, tmp_path):
    folder, made = corpus
    report = {(x.split, x.domain): x for x in streams.repair(spark, f"file://{folder}", f"file://{tmp_path}", 200, LENGTH).collect()}
    once = {k: plain_repair(parts, set(), 200) for k, parts in made.items()}
    wanted = {}
    for (split, domain), parts in once.items():
        drop = {d for _, d, _ in plain_documents(once["val", domain])[0]} if split == "train" else set()
        wanted[split, domain] = plain_repair(parts, drop & {d for _, d, _ in plain_documents(parts)[0]}, 200)
    got = get(tmp_path / "repaired")
    assert got == {k: v for k, v in wanted.items() if v}
    assert all(sum(map(len, got[k])) == report[k].n_tokens_out for k in got)
    for k, parts in made.items():
        if k in report:
            docs = plain_documents(parts)[0]
            assert report[k].n_docs_in == len(docs) and report[k].dropped_docs >= len(docs) - len({d for _, d, _ in docs})
    for side in (tmp_path / "repaired").glob("*/*/*.json"):
        row = json.loads(side.read_text())
        assert hashlib.sha256((side.parent / row["file"]).read_bytes()).hexdigest() == row["sha256"]


def test_interrupted_runs_give_the_same_shards(spark, tmp_path):
    r = random.Random(3)
    docs = [[r.randint(3, 900) for _ in range(r.choice([3, 20, 90]))] + [END] for _ in range(50)]
    rows = spark.createDataFrame([(i, bytearray(np.array(d, "<u2").tobytes())) for i, d in enumerate(docs)], "seq long, data binary")
    wanted = plain_pack(docs, [], 200)
    folder = f"file://{tmp_path}"
    state.pack_on(spark, rows.where("seq < 13"), folder, "a", "train", 200, LENGTH)
    before = state.read_json(spark, f"{folder}/state/a.train.json")
    data, waiting = state.read_partial(spark, f"{folder}/state", before["partial"])
    assert 0 < len(data) // 2 < 200 and waiting >= 1
    # A run that dies between its shards and its state: the state stays as it was, the partial buffer too.
    saved = {f: f.read_bytes() for f in (tmp_path / "state").iterdir() if not f.name.startswith(".")}
    state.pack_on(spark, rows.where("seq < 33"), folder, "a", "train", 200, LENGTH)
    for f in (tmp_path / "state").iterdir():
        f.unlink()
    for f, body in saved.items():
        f.write_bytes(body)
    assert state.pack_on(spark, rows.where("seq < 13"), folder, "a", "train", 200, LENGTH)["next_shard"] == before["next_shard"], "nothing new"
    state.pack_on(spark, rows.where("seq < 41"), folder, "a", "train", 200, LENGTH)
    done = state.pack_on(spark, rows, folder, "a", "train", 200, LENGTH, final=True)
    assert done["status"] == "complete" and done["n_documents"] == 50 and done["partial"] is None
    assert get(tmp_path) == {("train", "a"): wanted}
    assert state.pack_on(spark, rows, folder, "a", "train", 200, LENGTH, final=True) == done
    records = state.shard_records(spark, folder).orderBy("creation_order").collect()
    assert [x.n_tokens for x in records] == list(map(len, wanted))
    assert [f for f in (tmp_path / "state").iterdir() if "partial" in f.name] == []
    empty = state.pack_on(spark, rows.limit(0), folder, "b", "val", 200, LENGTH, final=True)
    assert empty["next_shard"] == 0
    (tmp_path / "state" / "bad.json").write_text("{")
    assert state.read_json(spark, f"{folder}/state/bad.json") is None and state.read_json(spark, f"{folder}/state/none.json") is None


def test_ledger(spark, tmp_path):
    rows = spark.createDataFrame([("d", "r", "a.parquet", "ab", 3, "safe", None)], "dataset_id string, revision string, path string, sha256 string, size long, security_status string, av_status string")
    for when in ("2026-01-01", "2026-01-02"):
        state.append_ledger(rows, f"file://{tmp_path}/ledger", when)
    got = spark.read.json(f"file://{tmp_path}/ledger")
    assert sorted(x.timestamp_checked for x in got.collect()) == ["2026-01-01", "2026-01-02"] and {"upstream_hash", "local_sha256", "config"} <= set(got.columns)


def test_windows_over_shards_cycle(spark, corpus):
    folder, made = corpus
    index = shards.window_index(spark, f"file://{folder}", LENGTH)
    counts = {k: [len(p) // (LENGTH + 1) for p in parts] for k, parts in made.items()}
    for blocks in (1 << 16, 3):
        got = {}
        for x in shards.cycled(index, 5, 60, blocks).collect():
            got.setdefault((x.split, x.domain), {})[x.item] = (x.epoch, x.file, x.window)
        for k, sizes in counts.items():
            all_ = [(f"shard-{i:05d}.bin", w) for i, n in enumerate(sizes) for w in range(n)]
            assert got[k] == {i: (i // len(all_), *all_[i % len(all_)]) for i in range(5, 60)}
