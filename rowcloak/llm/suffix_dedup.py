"""Removal of repeated byte strings by column-wise construction of a collection's suffix order.

Windows of ``length`` bytes are dealt out by content: each has an anchor, the ``anchor``-byte string
in it with the least hash (the leftmost of several), so equal windows have equal anchors at equal
places. A run of windows with one anchor occurrence is a segment; anchors that occur once are left
out. The segments with one anchor are a collection of strings lined up at the anchor, so only
suffixes that start in one column can share a window. The collection is built column by column from
the right: each round inserts one symbol of every string, sorts the suffixes stably by it, which is
the step of the (positional) Burrows-Wheeler transform, and updates the common prefixes of
neighbours. Between the steps anchors, strings and runs lie in sequential files in the shared folder;
a task streams its strings from there and holds the columns of at most STRINGS of them, with one
group more. A window is repeated when its suffix shares ``length`` bytes with a neighbour, or its
segment occurs twice.

Equal segments travel once with their count. Anchors with too many different segments for a task
are split: windows left and right of their middle are dealt out again by the longer string that
they have in common, until the groups fit or a group is a single window's content.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import KeyFilter, drop_table, packed, skew_join, text_of, write_table

LENGTH, ANCHOR, GROUP_LIMIT, STRINGS, HOT = 200, 64, 50_000, 1 << 15, 2_000
BLOCK = 1 << 19
DOC = ["_ord", "_tk"]
LAST = (1 << 63) - 1
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


class Roller:
    """Powers for hashes of ``anchor``-byte strings at all places of a block."""

    def __init__(self, n: int):
        inverse = pow(int(_BASE), -1, 1 << 64)
        self.up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _BASE, np.uint64)]))
        self.down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(inverse), np.uint64)]))


_ROLLER: list[Roller] = []


def segments(data: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, anchor place, first window, last window) of the runs of windows of a text."""
    if not _ROLLER:
        _ROLLER.append(Roller(BLOCK + 4096))
    up, down = _ROLLER[0].up, _ROLLER[0].down
    wide = length - anchor + 1
    out = []
    for lo in range(0, len(data) - length + 1, BLOCK):
        part = data[lo:lo + BLOCK + length - 1].astype(np.uint64) + np.uint64(1)
        total = np.concatenate([[np.uint64(0)], np.cumsum(part * up[:len(part)], dtype=np.uint64)])
        h = (total[anchor:] - total[:-anchor]) * down[:len(part) - anchor + 1]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        best = (h >> np.uint64(20) << np.uint64(20)) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while size * 2 <= wide:
            best = np.minimum(best[:-size], best[size:])
            size *= 2
        if size < wide:
            best = np.minimum(best[:len(best) - (wide - size)], best[wide - size:])
        place = (best & np.uint64((1 << 20) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:], [len(place)]]) - 1
        at = place[first]
        out.append((h[at].view(np.int64), at + lo, first + lo, last + lo))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out))


def repeated(text: list[bytes], lead: np.ndarray, group: np.ndarray, weight: np.ndarray, length: int, columns: int) -> np.ndarray:
    """Which windows of each string are repeated in its group (strings by group, one for each text).

    String i fills the columns from ``lead[i]`` on; a window's column is where it starts.
    """
    n = len(text)
    ends = lead + np.fromiter(map(len, text), np.int64, n)
    most = int(ends.max())
    out = np.zeros((n, columns), bool)
    grid = np.zeros((most, n), np.uint8)  # a row for each column
    for lo in range(0, n, 1024):
        some = np.zeros((min(1024, n - lo), most), np.uint8)
        for i, t in enumerate(text[lo:lo + 1024]):
            some[i, lead[lo + i]:ends[lo + i]] = np.frombuffer(t, np.uint8)
        grid[:, lo:lo + 1024] = some.T
    order, until = np.zeros(0, np.int64), np.zeros(0, np.int64)  # suffix order; column where it parts from the one before
    for j in range(most - 1, -1, -1):
        symbol = grid[j]
        live = lead[order] <= j
        if not live.all():  # strings that begin further right leave
            keep = np.flatnonzero(live)
            until = np.minimum.reduceat(np.append(until, 0), np.concatenate([[0], keep + 1]))[:-1]
            order = order[keep]
        new = np.flatnonzero(ends == j + 1)
        if len(new):  # an empty suffix comes first in its group and shares nothing
            order, until = np.concatenate([new, order]), np.concatenate([np.full(len(new), j + 1), until])
            if len(order) > len(new):
                until[len(new)] = j + 1
            o = np.argsort(group[order], kind="stable")
            moved = np.concatenate([[True], o[1:] != o[:-1] + 1])
            order, until = order[o], np.where(moved, j + 1, until[o])
        if not len(order):
            continue
        key = group[order] << 8 | symbol[order]
        o = np.argsort(key, kind="stable")
        same = np.concatenate([[False], key[o[1:]] == key[o[:-1]]])
        fresh = np.full(len(order), j)
        pair = np.flatnonzero(same)
        if len(pair):
            spans = np.column_stack([o[pair - 1] + 1, o[pair] + 1]).ravel()
            fresh[pair] = np.minimum.reduceat(np.append(until, 0), spans)[::2]
        order, until = order[o], fresh
        if j < columns:
            long = until - j >= length
            found = long | np.concatenate([long[1:], [False]]) | ((weight[order] > 1) & (ends[order] - j >= length))
            out[order[found], j] = True
    return out


def _judge(batches: Iterator[pa.RecordBatch], length: int, columns: int) -> Iterator[pa.RecordBatch]:
    """Rows (h, digest, lead, text, weight) sorted by h; gives (h, digest, first, last) runs of repeated windows."""
    held: dict[tuple[int, bytes], list] = {}
    groups = 0

    def flush() -> pa.RecordBatch:
        keys = list(held)
        values = [held[k] for k in keys]
        h = np.array([k[0] for k in keys], np.int64)
        group = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]])).astype(np.int64)
        flag = repeated([v[1] for v in values], np.array([v[0] for v in values], np.int64), group,
                        np.array([v[2] for v in values], np.int64), length, columns)
        edge = np.diff(np.pad(flag.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        i, first = np.nonzero(edge == 1)
        _, stop = np.nonzero(edge == -1)
        return pa.RecordBatch.from_arrays([pa.array(h[i]), pa.array([keys[k][1] for k in i], pa.binary()), pa.array(first.astype(np.int32)), pa.array((stop - 1).astype(np.int32))], ["h", "digest", "first", "last"])

    last = None
    for b in batches:
        for h, digest, lead, text, weight in zip(*(c.to_pylist() for c in b.columns)):
            if h != last:
                if len(held) >= STRINGS:
                    yield flush()
                    held = {}
                last = h
            v = held.get((h, digest))
            if v:
                v[2] += weight
            else:
                held[h, digest] = [lead, text, weight]
    if held:
        yield flush()


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(_ord, _tk, _spans): the maximal byte runs, as (start, end), that repeated strings cover."""
    columns = length - anchor + 1  # a window's column: its start less that of the anchor's first window
    base = keyed(docs)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                h, place, first, last = segments(np.frombuffer(b.column(2)[i].as_buffer(), np.uint8), length, anchor)
                if len(h):
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(b.column(0)[i], len(h)), pa.repeat(b.column(1)[i], len(h)), pa.array(h), pa.array(first),
                         pa.array((place - first).astype(np.int16)), pa.array((last - first).astype(np.int16))],
                        ["_ord", "_tk", "h", "first", "ahead", "more"])

    def merged(batches):  # one record batch for many texts
        held, n = [], 0
        for b in anchors(batches):
            held.append(b)
            n += b.num_rows
            if n >= 50_000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    place = "_ord long, _tk long, h long, first long, ahead short, more short"
    found = write_table(base.select(*DOC, F.col("_text").cast("binary").alias("t")).mapInArrow(merged, place), "suffix-anchors")
    again = write_table(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "suffix-again")
    common = again.where(F.col("n") > HOT)
    lists = write_table(skew_join(found, again.select("h"), ["h"], common, [*DOC, "first"]).groupBy(*DOC).agg(
        F.collect_list(F.struct("h", "first", "ahead", "more")).alias("list")), "suffix-lists")
    drop_table(found) if not found.isEmpty() else None

    key = F.xxhash64(*DOC)
    hit = KeyFilter(lists, key).mark(base.select(*DOC, F.col("_text").cast("binary").alias("t")), key, "_hit").where("_hit").drop("_hit")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        texts: dict[tuple[int, bytes], list] = {}
        size = 0
        names = ["_ord", "_tk", "h", "digest", "start", "lead", "text", "weight"]

        def flush():
            keys, v = list(texts), list(texts.values())
            none = pa.nulls(len(v), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.binary()), none,
                                               pa.array([x[0] for x in v], pa.int32()), pa.array([x[1] for x in v], pa.binary()), pa.array([x[2] for x in v], pa.int64())], names)

        for b in batches:
            for i in range(b.num_rows):
                text, items = b.column(2)[i].as_py(), b.column(3)[i].values
                h, first, ahead, more = (items.field(k).to_pylist() for k in range(4))
                digests = []
                for hi, a, k, m in zip(h, first, ahead, more):
                    s = text[a:a + m + length]
                    d = xxh3_128_digest(s + k.to_bytes(2, "little"))
                    digests.append(d)
                    v = texts.get((hi, d))
                    if v:
                        v[2] += 1
                    else:
                        texts[hi, d] = [columns - 1 - k, s, 1]
                        size += len(s) + 150
                n = len(h)
                none = pa.nulls(n, pa.int32())
                zero = np.array(first, np.int64) + np.array(ahead, np.int64) - (columns - 1)  # the text's place of column 0
                yield pa.RecordBatch.from_arrays([pa.repeat(b.column(0)[i], n), pa.repeat(b.column(1)[i], n), pa.array(h, pa.int64()), pa.array(digests, pa.binary()),
                                                  pa.array(zero), none, pa.nulls(n, pa.binary()), none.cast(pa.int64())], names)
                if size > 48 << 20:
                    yield flush()
                    texts, size = {}, 0
        if texts:
            yield flush()

    pieces = write_table(hit.join(lists, DOC).select(*DOC, "t", "list").mapInArrow(
        cut, "_ord long, _tk long, h long, digest binary, start long, lead int, text binary, weight long"), "suffix-pieces")
    drop_table(lists) if not lists.isEmpty() else None
    where = pieces.where("text is null").select(*DOC, "h", "digest", "start")
    strings = pieces.where("text is not null").select("h", "digest", "lead", "text", "weight")
    runs = write_table(judged(strings, length, columns, group_limit), "suffix-runs")

    copied = where.groupBy("h", "digest").agg(F.count("*").alias("n")).where(F.col("n") > HOT)
    spans = skew_join(where, runs, ["h", "digest"], copied, [*DOC, "start"]).select(
        *DOC, F.struct((F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("last") + length).alias("b")).alias("s"))
    listed = spans.groupBy(*DOC).agg(F.collect_set("s").alias("s"))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for s in b.column(2):
                a, z = (s.values.field(k).to_numpy() for k in range(2))
                o = np.argsort(a, kind="stable")
                a, z = a[o], np.maximum.accumulate(z[o])
                new = np.concatenate([[True], a[1:] > z[:-1]])
                stop = np.concatenate([z[np.flatnonzero(new)[1:] - 1], z[-1:]])
                out.append(np.column_stack([a[new], stop]).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.list_(pa.int64())))], ["_ord", "_tk", "_spans"])

    return write_table(listed.mapInArrow(cover, "_ord long, _tk long, _spans array<array<long>>"), "suffix-spans")


def judged(strings: DataFrame, length: int, columns: int, group_limit: int) -> DataFrame:
    """(h, digest, first, last): the runs of repeated windows of each string, hot groups split."""
    run = "h long, digest binary, first int, last int"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _judge(batches, length, columns)

    def whole(rows: DataFrame) -> DataFrame:
        dealt = rows.select("h", "digest", "lead", "text", "weight").repartition("h").sortWithinPartitions("h")
        return dealt.mapInArrow(judge, run)

    hot = write_table(strings.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > group_limit).select("h"), "suffix-hot")
    if hot.isEmpty():
        return whole(strings)
    out = whole(strings.join(hot, "h", "left_anti"))
    rows = strings.join(hot, "h", "left_semi").select(
        F.col("h").alias("h0"), F.col("digest").alias("digest0"), "h", "lead", "text", "weight", F.lit(0).alias("lo"), F.lit(columns - 1).alias("hi"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest, xxh3_128_digest

        for b in batches:
            got = []
            for h0, d0, h, lead, text, weight, lo, hi in zip(*(c.to_pylist() for c in b.columns)):
                mid = (lo + hi) // 2
                for x, y in {(lo, mid), (min(mid + 1, hi), hi)}:  # windows that start in columns x to y share columns y to x + length
                    s, e = max(x, lead), min(y + length, lead + len(text))
                    if e - s < length:
                        continue
                    part = text[s - lead:e - lead]
                    common = text[y - lead:x + length - lead]
                    key = xxh3_64_intdigest(common + x.to_bytes(2, "little"), h & (1 << 63) - 1)
                    got.append((h0, d0, key - (1 << 63), xxh3_128_digest(part + s.to_bytes(2, "little")), s, part, weight, x, y))
            cols = list(zip(*got)) or [[]] * 9
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             ["h0", "digest0", "h", "digest", "lead", "text", "weight", "lo", "hi"])

    width = columns
    while True:
        width = (width + 1) // 2
        rows = write_table(rows.select("h0", "digest0", "h", "lead", "text", "weight", "lo", "hi").mapInArrow(
            split, "h0 long, digest0 binary, h long, digest binary, lead int, text binary, weight long, lo int, hi int"), "suffix-split")
        once = write_table(rows.groupBy("h", "digest").agg(F.first("lead").alias("lead"), F.first("text").alias("text"),
                                                           F.sum("weight").alias("weight")), "suffix-once")
        hot = write_table(once.groupBy("h").agg(F.count("*").alias("n")).where((F.col("n") > group_limit) & F.lit(width > 1)).select("h"), "suffix-hot")
        cool = whole(once.join(hot, "h", "left_anti"))
        origin = rows.select("h0", "digest0", "h", "digest")
        out = out.unionByName(cool.join(origin, ["h", "digest"]).select(F.col("h0").alias("h"), F.col("digest0").alias("digest"), "first", "last"))
        if hot.isEmpty():
            return out
        rows = rows.join(hot, "h", "left_semi")


def keyed(docs: DataFrame) -> DataFrame:
    return (docs.withColumn("_text", text_of()).withColumn("_ord", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)))
            .withColumn("_tk", F.xxhash64("_text")))


def suffix_dedup(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """All columns of ``docs`` plus ``_n_bytes``, ``_spans`` (removed byte runs), ``_kept`` (binary) and ``_kept_text``.

    Texts are UTF-8 bytes, a null one empty. Each byte covered by a ``length``-byte string that also
    starts anywhere else, in the same document or another, is removed; matches don't cross
    documents and are judged on the input, so no copy is spared. Rows that repeat doc_id and text
    are copies of each other. ``_kept_text`` is what is kept without the bytes of characters that
    were cut in two. Texts under ``length`` bytes are kept whole; an empty table gives no
    rows; columns named like the new ones are replaced, others pass unchanged.
    """
    new = ["_n_bytes", "_spans", "_kept", "_kept_text"]
    spans = repeated_spans(docs.select("doc_id", "text"), length, anchor, group_limit)
    key = F.xxhash64(*DOC)
    none = F.expr("cast(array() as array<array<bigint>>)")
    marked = KeyFilter(spans, key).mark(keyed(packed(docs, new)), key, "_hit")
    raw = F.col("_text").cast("binary")
    size = F.octet_length("_text").cast("long").alias("_n_bytes")
    same = marked.where("not _hit").select("_row.*", size, none.alias("_spans"), raw.alias("_kept"), F.col("_text").alias("_kept_text"))
    hit = marked.where("_hit").join(spans, DOC, "left").select("_row", size, F.coalesce("_spans", none).alias("_spans"), raw.alias("_kept"))
    schema = StructType([*hit.schema, StructField("_kept_text", StringType())])

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What lies between the runs: from the end of one to the start of the next."""
        for b in (whole.slice(lo, 256) for whole in batches for lo in range(0, whole.num_rows, 256)):
            kept = []
            for spans, text in zip(b.column(2).to_pylist(), b.column(3)):
                text, ends = memoryview(text.as_buffer()), [0, *(z for _, z in spans)]
                kept.append(b"".join(text[a:z] for a, z in zip(ends, [*(a for a, _ in spans), len(text)])))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(kept, pa.binary()), pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())], schema.names)

    return same.unionByName(hit.mapInArrow(between, schema).select("_row.*", *new))
