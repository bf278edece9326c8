"""Removal of repeated byte strings by suffix sorting.

Every byte covered by a ``MATCH``-byte string that also starts elsewhere in the
corpus is found with sorted suffixes and the common prefixes of neighbours.

Suffixes are sorted in two stages: those smaller than their successor (type S)
are sorted directly, the rest (type L) follow from them by one scan over the
buckets of first bytes.  A suffix whose common prefix with a neighbour in that
order has ``MATCH`` bytes marks a repeated string.

Equal strings first have to meet in one task.  Each ``MATCH``-byte string has a
least ``GRAM``-byte hash in it (the leftmost of equals), its anchor; equal
strings have equal anchors at equal places.  Neighbouring strings with one
anchor form a run, a run's bytes are its context, and equal contexts of an
anchor (told by their MD5) are counted and sent once.  An anchor seen once
repeats nothing, one with copies of a single context repeats all of it.  The
contexts of all others are sorted in blocks, anchor by anchor.

An anchor with more than ``CONTEXTS`` different contexts would outgrow a task.
Its strings are dealt by where the anchor stands in them, in cells of ``width``
places, and by the bytes that all strings of a cell have in common; contexts are
cut to a cell's strings.  A group with one context left is settled by its count,
a group of at most ``CONTEXTS`` is sorted like any anchor, and a larger one is
dealt again in cells an eighth as wide.  A group of cells of one place holds
equal strings only, so a few rounds settle every string.

Defined results: null text has no bytes; a text of fewer than MATCH bytes keeps
all of them; copies of a text repeat each other, so one of MATCH bytes or more
loses everything in all its copies; ties don't arise, as all copies go; extra
columns are ignored, whatever their names; an empty table has no rows; very
long texts are hashed in pieces that overlap by MATCH - 1 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuswright.llm.store import drop, free_shuffles, lean, written
from corpuswright.llm.words import mix

MATCH = 400
GRAM = 64
CONTEXTS = 2048
#: Bytes of text hashed at once, of contexts sorted at once.
PIECE, BLOCK = 1 << 19, 1 << 18
#: Runs held before they are sent on with the number of their text's copies so far.
HELD = 1 << 16
_BASE = 0x9E3779B97F4A7C15 | 1
_PLACE = np.uint64((1 << 24) - 1)
#: Stands between contexts; no byte of UTF-8.
BETWEEN = 0xFF


# ---- suffix sorting -------------------------------------------------------


def suffix_types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the last one never is."""
    n = len(t)
    if n == 0:
        return np.zeros(0, np.bool_)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int16) - t[:-1].astype(np.int16))
    step[-1] = -1
    ahead = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(ahead[::-1])[::-1]] > 0  # of each place, the next one that differs


def two_stage(t: np.ndarray, keep: np.ndarray | None = None, depth: int | None = None) -> np.ndarray:
    """Suffixes of t in order: all, or those kept and the few that place them; with depth, ordered by so many bytes at least."""
    n, raw = len(t), t.tobytes()
    smaller = suffix_types(t)
    if keep is None:
        keep = np.ones(n, np.bool_)
    else:
        # A suffix of type L is placed by its successor: keep all up to the next one of type S.
        s_at = np.append(np.flatnonzero(smaller), n - 1)
        kept = np.flatnonzero(keep)
        edge = keep.astype(np.int32)
        edge -= np.bincount(s_at[np.minimum(np.searchsorted(s_at, kept), len(s_at) - 1)] + 1, minlength=n + 1)[:n].astype(np.int32)
        keep = np.cumsum(edge) > 0
    rest = keep & ~smaller
    direct = np.flatnonzero(keep & smaller).tolist()
    direct.sort(key=(lambda i: raw[i : i + depth]) if depth else (lambda i: raw[i:]))
    s = np.array(direct, np.int64)
    bounds = np.searchsorted(t[s], np.arange(257)) if len(s) else np.zeros(257, np.int64)
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]

    def induce(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[rest[before]]
        if not len(before):
            return
        c = t[before]
        order = np.argsort(c, kind="stable")
        before, c = before[order], c[order]
        cut = np.flatnonzero(np.diff(c)) + 1
        for part, b in zip(np.split(before, cut), c[np.concatenate([[0], cut])].tolist(), strict=True):
            waiting[b].append(part)

    out = []
    if n and rest[-1]:
        induce(np.array([n]))  # the empty suffix comes first
    for c in range(256):
        while waiting[c]:
            wave = np.concatenate(waiting[c])
            waiting[c] = []
            out.append(wave)
            induce(wave)
        own = s[bounds[c] : bounds[c + 1]]
        if len(own):
            out.append(own)
            induce(own)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefixes(t: np.ndarray, order: np.ndarray, cut: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it, at most cut; 0 for the first. Eight bytes are compared at once."""
    n = len(t)
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    words = np.zeros(n + 1, np.uint64)  # the eight bytes from each place on, the first one highest; nothing after the end
    padded = np.concatenate([t, np.zeros(8, np.uint8)])
    for j in range(8):
        words[:n] |= padded[j : j + n].astype(np.uint64) << np.uint64(56 - 8 * j)
    left = np.minimum(n - np.maximum(order[1:], order[:-1]), cut)  # no more than the shorter one has
    live = np.arange(1, len(order))
    k = 0
    while len(live):
        i, j = np.minimum(order[live - 1] + k, n), np.minimum(order[live] + k, n)
        differ = words[i] ^ words[j]
        end = (differ != 0) | (k + 8 >= left[live - 1])
        done = live[end]
        if len(done):
            x = differ[end]
            same = np.full(len(done), 8)
            for b in range(7, -1, -1):
                same[x >> np.uint64(56 - 8 * b) != 0] = b
            out[done] = np.minimum(k + same, left[done - 1])
        live = live[~end]
        k += 8
    return out


def repeated_starts(contexts: list[bytes], starts: list[int], twice: list[bool], match: int = MATCH) -> list[np.ndarray]:
    """Of each context, which of its first ``starts`` match-byte strings occur again in any of them; twice: the context itself does, so all of its strings."""
    begin, at = [], 0
    for c in contexts:
        begin.append(at)
        at += len(c) + 1
    t = np.frombuffer(b"\xff".join([*contexts, b""]), np.uint8)
    edge = np.zeros(len(t) + 1, np.int8)
    edge[begin] += 1
    edge[np.array(begin) + np.array(starts)] -= 1
    keep = np.cumsum(edge[:-1], dtype=np.int8) > 0
    order = two_stage(t, keep, match)
    order = order[keep[order]]
    again = np.flatnonzero(common_prefixes(t, order, match) >= match)
    found = np.zeros(len(t), np.bool_)
    found[order[again - 1]] = True
    found[order[again]] = True
    return [np.ones(k, np.bool_) if two else found[b : b + k] for b, k, two in zip(begin, starts, twice, strict=True)]


# ---- anchors and runs -----------------------------------------------------


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _power_tables.have[0] is None or len(_power_tables.have[0]) < n:
        up = np.full(n, _BASE % (1 << 64), np.uint64)
        down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _power_tables.have = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return _power_tables.have[0][:n], _power_tables.have[1][:n]


_power_tables.have = (None, None)


def prefix_hashes(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """h, down: (h[j] - h[i]) * down[i] tells t[i:j]."""
    up, down = _power_tables(len(t) + 1)
    h = np.zeros(len(t) + 1, np.uint64)
    np.cumsum(mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE % (1 << 64)))[t] * up[: len(t)], dtype=np.uint64, out=h[1:])
    return h, down


def runs(t: np.ndarray, first: np.ndarray, last: np.ndarray, match: int = MATCH) -> tuple[np.ndarray, ...]:
    """Runs of the strings that start at first[i] to last[i] (one pair for each text): text, start, number of starts, anchor's hash."""
    n = len(t)
    empty = np.zeros(0, np.int64)
    if n < match or not len(first):
        return empty, empty, empty, empty
    h, down = prefix_hashes(t)
    m = n - GRAM + 1
    gram = mix((h[GRAM:] - h[:m]) * down[:m])
    key = (gram & ~_PLACE) | np.arange(m, dtype=np.uint64)
    width = match - GRAM + 1
    have, size = key, 1
    while size * 2 <= width:
        have = np.minimum(have[:-size], have[size:])
        size *= 2
    if size < width:
        have = np.minimum(have[: n - match + 1], have[width - size : width - size + n - match + 1])
    anchor_at = (have & _PLACE).astype(np.int64)
    valid = np.zeros(n + 1, np.int32)
    np.add.at(valid, first, 1)
    np.add.at(valid, last + 1, -1)
    x = np.flatnonzero(np.cumsum(valid)[: n - match + 1] > 0)
    a = anchor_at[x]
    new = np.ones(len(x), np.bool_)
    new[1:] = (np.diff(a) != 0) | (np.diff(x) != 1)
    new |= np.isin(x, first)
    at = np.flatnonzero(new)
    x0, count = x[at], np.diff(np.append(at, len(x)))
    place = a[at]
    return np.searchsorted(first, x0, side="right") - 1, x0, count, gram[place].view(np.int64)


def _md5(data: bytes) -> bytes:
    return hashlib.md5(data, usedforsecurity=False).digest()


def _occurrences(match: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The runs of the task's texts; a text met again while its runs are held is counted, later it is a further text."""
        copies: dict[bytes, int] = {}
        found: list[tuple] = []
        pending: list[tuple[bytes, bytes, int]] = []

        def flush() -> int:
            parts, first, last, at = [], [], [], 0
            for _, part, _ in pending:
                first.append(at)
                last.append(at + len(part) - match)
                parts.append(part)
                at += len(part)
            whole = b"".join(parts)
            doc, x0, count, anchor = runs(np.frombuffer(whole, np.uint8), np.array(first, np.int64), np.array(last, np.int64), match)
            context = [_md5(whole[a:z]) for a, z in zip(x0.tolist(), (x0 + count - 1 + match).tolist(), strict=True)]
            found.append(([pending[i][0] for i in doc.tolist()], x0 - np.array(first, np.int64)[doc] + np.array([p[2] for p in pending], np.int64)[doc], count, anchor, context))
            pending.clear()
            return len(x0)

        def sent() -> Iterator[pa.RecordBatch]:
            for names, x0, count, anchor, context in found:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(x0), pa.array(count, pa.int64()), pa.array(anchor), pa.array(context, pa.binary()), pa.array([copies[x] for x in names], pa.int64())], names=["name", "x0", "starts", "anchor", "context", "copies"])
            found.clear()
            copies.clear()

        held = n_runs = 0
        for b in batches:
            for text in b.column("text"):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                if len(data) < match:
                    continue
                name = _md5(data)
                copies[name] = copies.get(name, 0) + 1
                if copies[name] > 1:
                    continue
                for i in range(0, len(data) - match + 1, PIECE):
                    part = data[i : i + PIECE + match - 1]
                    pending.append((name, part, i))
                    held += len(part)
                    if held >= PIECE:
                        n_runs += flush()
                        held = 0
                if n_runs >= HELD:
                    if pending:
                        flush()
                    yield from sent()
                    held = n_runs = 0
        if pending:
            flush()
        yield from sent()

    return run


# ---- the corpus -----------------------------------------------------------


def _with_text(rows: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """rows (id, name, at) with the text of that id."""
    own = docs.select(F.col(key).alias("__id"), F.col(text).alias("text")).where(F.length("text") > 0)
    return own.join(rows, F.col("__id").eqNullSafe(F.col("id"))).select("name", "text", "at")


def _contexts(match: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, text, at in zip(b.column("name").to_pylist(), b.column("text"), b.column("at").to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes()
                if _md5(data) == name:  # not another row with the same id
                    yield pa.RecordBatch.from_arrays([pa.array([x["anchor"] for x in at], pa.int64()), pa.array([x["context"] for x in at], pa.binary()), pa.array([x["twice"] for x in at], pa.bool_()), pa.array([x["starts"] for x in at], pa.int64()), pa.array([data[x["x0"] : x["x0"] + x["starts"] - 1 + match] for x in at], pa.binary())], names=["anchor", "context", "twice", "starts", "bytes"])

    return run


_CONTEXT = "anchor long, context binary, twice boolean, starts long, bytes binary"
_VERDICT = "anchor long, context binary, repeated binary"


def _verdicts(anchor: list[int], context: list[bytes], marks: list[np.ndarray]) -> pa.RecordBatch:
    some = [i for i, m in enumerate(marks) if m.any()]
    return pa.RecordBatch.from_arrays([pa.array([anchor[i] for i in some], pa.int64()), pa.array([context[i] for i in some], pa.binary()), pa.array([np.packbits(marks[i], bitorder="little").tobytes() for i in some], pa.binary())], names=["anchor", "context", "repeated"])


def _sorted_blocks(match: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Contexts, anchor by anchor: which of their strings repeat."""
        held: dict[tuple[int, bytes], tuple[bytes, int, bool]] = {}
        size, last = 0, None

        def close() -> pa.RecordBatch:
            marks = repeated_starts([x[0] for x in held.values()], [x[1] for x in held.values()], [x[2] for x in held.values()], match)
            return _verdicts([k[0] for k in held], [k[1] for k in held], marks)

        for b in batches:
            for anchor, context, twice, starts, data in zip(*(b.column(c).to_pylist() for c in ("anchor", "context", "twice", "starts", "bytes")), strict=True):
                if anchor != last and size >= BLOCK:
                    yield close()
                    held, size = {}, 0
                last = anchor
                held[anchor, context] = (data, starts, twice)
                size += len(data)
        if held:
            yield close()

    return run


def _cells(width: int, match: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Contexts cut to the strings of each cell: (anchor, context, j0, starts), the cell's group, the MD5 of the part."""
        for b in batches:
            rows = []
            for anchor, context, twice, at, data in zip(*(b.column(c).to_pylist() for c in ("anchor", "context", "twice", "at", "bytes")), strict=True):
                place = _place(data, anchor)
                for piece in at:
                    j, last = piece["j0"], piece["j0"] + piece["starts"] - 1
                    while j <= last:
                        cell = (place - j) // width  # of the places that the anchor has in strings from here on
                        z = min(last, place - cell * width)
                        low, high = cell * width, min(cell * width + width - 1, match - GRAM)
                        # What all strings of the cell have: from the anchor's least place in them to the end of the one where it stands last.
                        common = data[place - low : place - high + match]
                        group = int.from_bytes(_md5(b"%d %d " % (anchor, cell) + common)[:8], "little", signed=True)
                        rows.append((anchor, context, j, z - j + 1, group, _md5(b"%d " % (place - j) + data[j : z + match]), 1 + twice))
                        j = z + 1
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["anchor", "context", "j0", "starts", "group", "part", "n"])

    return run


def _place(data: bytes, anchor: int) -> int:
    """Where the anchor begins in its context: the leftmost gram with its hash, as runs() compares them."""
    t = np.frombuffer(data, np.uint8)
    h, down = prefix_hashes(t)
    m = len(t) - GRAM + 1
    gram = mix((h[GRAM:] - h[:m]) * down[:m])
    return int(np.flatnonzero((gram & ~_PLACE) == (np.uint64(anchor % (1 << 64)) & ~_PLACE))[0])


def covered(x0: list[int], marks: list[bytes], n: int, match: int = MATCH) -> list[tuple[int, int]]:
    """The bytes covered by the strings that start at x0[i] + j for every set bit j: maximal runs (from, to)."""
    bits = np.flatnonzero(np.unpackbits(np.frombuffer(b"".join(marks), np.uint8), bitorder="little"))
    size = np.array([len(m) for m in marks], np.int64)
    at = bits + np.repeat(np.array(x0, np.int64) - 8 * (np.cumsum(size) - size), size)[bits >> 3]
    edge = np.bincount(at, minlength=n + 1) - np.bincount(at + match, minlength=n + 1)
    inside = np.concatenate([[0], (np.cumsum(edge)[:n] > 0).astype(np.int8), [0]])
    turn = np.flatnonzero(np.diff(inside))
    return list(zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True))


_EVERY = "unhex(concat(repeat('FF', int(starts div 8)), if(starts % 8 = 0, '', lpad(hex(shiftleft(1, int(starts % 8)) - 1), 2, '0'))))"


def _hot_verdicts(hot: DataFrame, match: int, parts: int) -> tuple[DataFrame, list[str]]:
    """(anchor, context, j0, repeated) of the contexts of hot anchors, and the folders of the tables behind it. hot: a written table of contexts."""
    spark, paths, out = hot.sparkSession, [], None
    todo = hot.select("anchor", "context", "twice", "bytes", F.array(F.struct(F.lit(0).cast("long").alias("j0"), "starts")).alias("at"))
    width = 1 << (match - GRAM).bit_length()
    while True:
        width = max(1, width >> 3)
        cells, path = written(todo.mapInArrow(lean(_cells(width, match)), "anchor long, context binary, j0 long, starts long, group long, part binary, n long"), "cells")
        one = cells.groupBy("group", "part").agg(F.sum("n").alias("n"), F.min(F.struct("anchor", "context", "j0")).alias("e"), F.first("starts").alias("starts"))
        several = one.groupBy("group").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("different")).where("total > 1")
        one, one_path = written(one.join(several, "group").select("group", "part", "e.*", "starts", (F.col("n") > 1).alias("twice"), "different"), "parts")
        same = one.where("different = 1").select("group", "part", F.expr(_EVERY).alias("repeated"))
        few = one.where(F.col("different").between(2, CONTEXTS)).join(hot.select("anchor", "context", "bytes"), ["anchor", "context"])
        few = few.select(F.col("group").alias("anchor"), F.col("part").alias("context"), "twice", "starts", F.substring("bytes", F.col("j0").cast("int") + 1, (F.col("starts") - 1 + match).cast("int")).alias("bytes"))
        found = few.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(lean(_sorted_blocks(match)), _VERDICT).toDF("group", "part", "repeated")
        found, found_path = written(same.unionByName(found), "settled")
        paths += [path, one_path, found_path]
        settled = cells.join(found, ["group", "part"]).select("anchor", "context", "j0", "repeated")
        out = settled if out is None else out.unionByName(settled)
        free_shuffles(spark)
        open_ = one.where(F.col("different") > CONTEXTS).select("group", "part")
        if not open_.limit(1).count():
            return out, paths
        left = cells.join(open_, ["group", "part"]).groupBy("anchor", "context").agg(F.collect_list(F.struct("j0", "starts")).alias("at"))
        todo = hot.select("anchor", "context", "twice", "bytes").join(left, ["anchor", "context"])


def repeated_marks(docs: DataFrame, key: str = "doc_id", text: str = "text", match: int = MATCH) -> DataFrame:
    """name (MD5 of the text's bytes), at: places of it (x0) and, as bits, which strings from each on repeat. A row for each text that loses bytes, in a written table."""
    spark = docs.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    where, where_path = written(docs.select(F.col(text).alias("text")).mapInArrow(lean(_occurrences(match)), "name binary, x0 long, starts long, anchor long, context binary, copies long"), "runs")
    contexts = where.groupBy("anchor", "context").agg(F.sum("copies").alias("n"), F.min(F.struct("name", "x0")).alias("e"), F.first("starts").alias("starts"))
    several = contexts.groupBy("anchor").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("different")).where("total > 1")
    contexts, contexts_path = written(contexts.join(several, "anchor").select("anchor", "context", F.col("e.name").alias("name"), F.col("e.x0").alias("x0"), (F.col("n") > 1).alias("twice"), "starts", "different"), "contexts")
    same = contexts.where("different = 1").select("anchor", "context", F.expr(_EVERY).alias("repeated"))
    wanted, wanted_path = written(contexts.where("different > 1").withColumn("hot", F.col("different") > CONTEXTS).join(_first(docs, key, text), "name"), "wanted")
    free_shuffles(spark)

    def fetched(hot: bool) -> DataFrame:
        rows = wanted.where(F.col("hot") == F.lit(hot)).groupBy("id", "name").agg(F.collect_list(F.struct("anchor", "context", "twice", "x0", "starts")).alias("at"))
        return _with_text(rows, docs, key, text).mapInArrow(lean(_contexts(match)), _CONTEXT)

    found, found_path = written(fetched(False).repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(lean(_sorted_blocks(match)), _VERDICT), "verdicts")
    paths = [where_path, contexts_path, wanted_path, found_path]
    found = found.unionByName(same).select("anchor", "context", F.array(F.struct(F.lit(0).cast("long").alias("j0"), "repeated")).alias("of"))
    if wanted.where("hot").limit(1).count():
        free_shuffles(spark)
        hot, hot_path = written(fetched(True), "hot")
        more, more_paths = _hot_verdicts(hot, match, parts)
        found = found.unionByName(more.groupBy("anchor", "context").agg(F.collect_list(F.struct("j0", "repeated")).alias("of")))
        paths += [hot_path, *more_paths]
    free_shuffles(spark)
    marks = where.join(found, ["anchor", "context"]).groupBy("name").agg(F.collect_set(F.struct("x0", "of")).alias("at"))
    flat = F.flatten(F.transform("at", lambda x: F.transform(x["of"], lambda o: F.struct((x["x0"] + o["j0"]).alias("x"), o["repeated"].alias("m")))))
    out, _ = written(marks.select("name", flat.alias("at")).select("name", F.struct(F.col("at.x").alias("x0"), F.col("at.m").alias("repeated")).alias("at")), "marks")
    for p in paths:
        drop(spark, p)
    free_shuffles(spark)
    return out


def _first(docs: DataFrame, key: str, text: str) -> DataFrame:
    return named(docs, key, text).groupBy("name").agg(F.min("id").alias("id"))


def named(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id and name (the MD5 of its text's bytes) of every row."""
    data = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    return docs.select(F.col(key).alias("id"), F.unhex(F.md5(data)).alias("name"))


def _marked(docs: DataFrame, key: str, text: str, match: int) -> DataFrame:
    """The documents and __at, their marks (null: nothing repeats)."""
    marks = repeated_marks(docs, key, text, match)
    of = named(docs, key, text).select("id", "name").distinct().join(marks, "name").withColumnsRenamed({"id": "__id", "name": "__name", "at": "__at"})
    data = F.unhex(F.md5(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")))
    return docs.join(of, F.col(key).eqNullSafe(F.col("__id")) & (data == F.col("__name")), "left").select(*docs.columns, "__at")


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text", match: int = MATCH) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256, from and to (the removed runs) and text (what is kept, less characters cut in part) of every row."""
    rows = _marked(docs.select(F.col(key), F.col(text)), key, text, match)
    schema = docs.select(F.col(key), *(F.lit(0).cast("long").alias(c) for c in ("n_bytes", "n_removed", "n_spans")), F.lit("").alias("kept_sha256"), *(F.array(F.lit(0).cast("long")).alias(c) for c in ("from", "to")), F.lit("").alias("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for value, at in zip(b.column(text), b.column("__at").to_pylist(), strict=True):
                data = value.as_buffer().to_pybytes() if value.is_valid else b""
                found = covered(at["x0"], at["repeated"], len(data), match) if at else []
                kept, done = [], 0
                for a, z in [*found, (len(data), len(data))]:
                    kept.append(data[done:a])
                    done = z
                out.append((len(data), sum(z - a for a, z in found), len(found), hashlib.sha256(b"".join(kept)).hexdigest(), [a for a, _ in found], [z for _, z in found], "".join(x.decode("utf-8", "ignore") for x in kept)))
            kinds = [pa.int64()] * 3 + [pa.string()] + [pa.list_(pa.int64())] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(key), *(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds))], names=schema.names)

    return rows.mapInArrow(lean(run), schema)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", match: int = MATCH) -> DataFrame:
    """The documents, with all their columns, less the characters that lie wholly in repeated bytes; a text that loses all of them goes."""
    rows = _marked(docs, key, text, match)
    names, at_column = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keep = [], []
            for value, at in zip(b.column(text), b.column("__at"), strict=True):
                if not at.is_valid:
                    texts.append(value.as_py())
                    keep.append(True)
                    continue
                whole, at = value.as_buffer().to_pybytes(), at.as_py()
                parts, done = [], 0
                for a, z in covered(at["x0"], at["repeated"], len(whole), match):
                    # A character that is covered in part stays.
                    while a < z and whole[a] & 0xC0 == 0x80:
                        a += 1
                    while z > a and z < len(whole) and whole[z] & 0xC0 == 0x80:
                        z -= 1
                    parts.append(whole[done:a])
                    done = z
                texts.append(b"".join([*parts, whole[done:]]).decode())
                keep.append(bool(texts[-1]))
            columns = [pa.array(texts, pa.string()) if i == at_column else b.column(c) for i, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return rows.mapInArrow(lean(run), docs.schema)


def op3_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return removed(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text")
