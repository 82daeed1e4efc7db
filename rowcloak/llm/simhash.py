"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are first dealt out by masked bits: of six blocks of bits, two fingerprints that
differ in at most four bits agree on two, so each fingerprint goes to the fifteen groups of its
block pairs, and a group too large for a task is dealt out again by the bits it has left. Inside a
group the fingerprints are sorted by Gray rank; runs of neighbours form leaf nodes that hold the
bit pattern their members share, and runs of nodes form upper nodes. A search walks down with the
differences summed so far and gives up a whole node once they exceed the limit, or once the node
lies in the searcher's own component. A group returns a star for each component, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import drop_table, quoted, text_of, write_table

BLOCKS, GROUP_LIMIT, FAN, SALTS = 6, 20_000, 16, 8
FRONTIER = 1 << 17  # (searcher, node) pairs that are looked at together


def fingerprints_of(texts: list[str], width: int = 4) -> list[int]:
    """Signed 64-bit SimHash of each text's shingles of ``width`` words (XXH64, seed 42)."""
    from xxhash import xxh64_intdigest

    out = []
    for text in texts:
        words = text.encode().translate(_LOWER).split()
        if not words:
            out.append(0)
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        flat = b" ".join(words)
        stops = (ends - 1).tolist()
        starts = [0, *ends[:-1].tolist()]
        h = np.array([xxh64_intdigest(flat[a:b], 42) for a, b in zip(starts, stops[width - 1:] or stops[-1:])], np.uint64)
        ones = np.zeros(64, np.int64)
        for lo in range(0, len(h), 1 << 14):
            ones += np.unpackbits(h[lo:lo + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        bits = np.packbits(ones * 2 > len(h), bitorder="little")
        out.append(int(bits.view("<i8")[0]))
    return out


_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def simhash(docs: DataFrame, width: int = 4, keep: list[str] | None = None, out: str = "fp") -> DataFrame:
    """The columns ``keep`` (doc_id) and the fingerprint of each whole text; a null or blank text has fingerprint zero."""
    keep = ["doc_id"] if keep is None else keep
    schema = StructType([*(docs.schema[c] for c in keep), StructField(out, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                cut = b.slice(lo, 128)
                fp = fingerprints_of(cut.column(len(keep)).to_pylist(), width)
                yield pa.RecordBatch.from_arrays([*cut.columns[:len(keep)], pa.array(fp, pa.int64())], schema.names)

    return docs.select(*quoted(keep), text_of().alias("_text0")).mapInArrow(run, schema)


def sub_masks(mask: int, blocks: int = BLOCKS, limit: int = 4) -> list[int]:
    """Masks over ``mask``: one for each choice of the blocks that stay equal among the bits left."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = np.array_split(free, blocks) if len(free) >= blocks else [[b] for b in free]
    same = max(0, len(cuts) - limit)
    return [mask | sum(1 << int(b) for c in some for b in c) for some in combinations(cuts, same)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_order(codes: np.ndarray) -> np.ndarray:
    """The order of codes by their rank in the reflected Gray sequence."""
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return np.argsort(rank, kind="stable")


class GrayIndex:
    """Hierarchical index of one group's distinct fingerprints; finds its components."""

    def __init__(self, codes: np.ndarray, limit: int):
        self.codes, self.limit, n = codes[gray_order(codes)], limit, len(codes)
        self.label = np.arange(n)
        everything = np.uint64(0xFFFFFFFFFFFFFFFF)
        mask, value = np.full(n, everything), self.codes
        self.levels = []  # from the leaves up: (mask, value)
        while len(mask) > FAN or not self.levels:
            cut = np.arange(0, len(mask), FAN)
            first = np.repeat(value[cut], np.diff([*cut, len(mask)]))
            shared = np.bitwise_and.reduceat(mask & ~(value ^ first), cut)
            mask, value = shared, value[cut] & shared
            self.levels.append((mask, value))

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the components of linked members, smaller label first, until nothing changes."""
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            keep = x != y
            a, b, x, y = a[keep], b[keep], x[keep], y[keep]
            if not len(a):
                break
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label[:] = label[label]

    def node_labels(self) -> list[np.ndarray]:
        """The component of each node whose members are all in one, else -1."""
        out, lo, hi = [], self.label, self.label
        for _ in self.levels:
            cut = np.arange(0, len(lo), FAN)
            lo, hi = np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut)
            out.append(np.where(lo == hi, lo, -1))
        return out

    def components(self, block: int = 2048) -> np.ndarray:
        n = len(self.codes)
        for step in range(1, min(FAN, n)):
            near = np.flatnonzero(np.bitwise_count(self.codes[step:] ^ self.codes[:-step]) <= self.limit)
            self.union(near, near + step)
        for start in range(0, n, block):
            self._search(np.arange(start, min(n, start + block)))
        return self.label

    def _search(self, queries: np.ndarray) -> None:
        """Walk down depth first, FRONTIER pairs of searcher and node at a time."""
        own = self.node_labels()
        top = len(self.levels) - 1
        width = len(self.levels[top][0])
        step = max(1, FRONTIER // width)
        stack = [(top, np.repeat(q, width), np.tile(np.arange(width), len(q)), np.zeros(len(q) * width, np.uint8), np.zeros(len(q) * width, np.uint64))
                 for q in (queries[lo:lo + step] for lo in range(0, len(queries), step))]
        while stack:
            k, q, node, spent, known = stack.pop()
            mask, value = self.levels[k]
            spent = spent + np.bitwise_count((self.codes[q] ^ value[node]) & mask[node] & ~known)
            open_ = (spent <= self.limit) & (own[k][node] != self.label[q])
            q, node, spent, known = q[open_], node[open_], spent[open_], mask[node[open_]]
            below = len(self.levels[k - 1][0]) if k else len(self.codes)
            for lo in range(0, len(q), FRONTIER // FAN):
                part = slice(lo, lo + FRONTIER // FAN)
                q2, s2, m2 = (np.repeat(x[part], FAN) for x in (q, spent, known))
                n2 = (node[part, None] * FAN + np.arange(FAN)).ravel()
                inside = n2 < below
                if k:
                    stack.append((k - 1, q2[inside], n2[inside], s2[inside], m2[inside]))
                    continue
                q2, n2, s2, m2 = q2[inside], n2[inside], s2[inside], m2[inside]
                hit = (self.label[q2] != self.label[n2]) & (s2 + np.bitwise_count((self.codes[q2] ^ self.codes[n2]) & ~m2) <= self.limit)
                self.union(q2[hit], n2[hit])


def _stars(mask: np.ndarray, fp: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, the first of its component) of all whole groups in sorted rows."""
    key = fp & mask
    new = np.ones(len(fp), bool)
    new[1:] = (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])
    starts = np.flatnonzero(new)
    sizes = np.diff([*starts, len(fp)])
    code, group = fp.view(np.uint64), np.cumsum(new)
    a, b = [], []
    small = sizes[group - 1] <= FAN
    for step in range(1, FAN):
        i = np.flatnonzero(small[step:] & (group[step:] == group[:-step]))
        i = i[np.bitwise_count(code[i + step] ^ code[i]) <= limit]
        a.append(fp[i + step])
        b.append(fp[i])
    for s, n in zip(starts[sizes > FAN].tolist(), sizes[sizes > FAN].tolist()):
        index = GrayIndex(code[s:s + n], limit)
        label = index.components()
        linked = label != np.arange(n)
        a.append(index.codes[linked].view(np.int64))
        b.append(index.codes[label[linked]].view(np.int64))
    return np.concatenate(a), np.concatenate(b)


def links(fps: DataFrame, limit: int = 4, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(a, b) edges whose components are those of all pairs of distinct ``fp`` within ``limit`` bits."""
    blocks = BLOCKS if limit <= 4 else limit + 2

    @F.pandas_udf("array<long>")
    def deal(mask: pd.Series) -> pd.Series:
        known = {m: [signed(x) for x in sub_masks(m & (1 << 64) - 1, blocks, limit)] for m in set(mask)}
        return mask.map(known)

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.withColumn("mask", F.explode(deal("mask"))).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_m, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def flush(m, f):
            a, b = _stars(m, f, limit)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            held_m = np.concatenate([held_m, batch.column(0).to_numpy()])
            held_f = np.concatenate([held_f, batch.column(1).to_numpy()])
            if len(held_f) >= 1 << 18:
                key = held_f & held_m
                last = np.flatnonzero((held_m[1:] != held_m[:-1]) | (key[1:] != key[:-1]))
                if len(last):
                    cut = last[-1] + 1
                    yield flush(held_m[:cut], held_f[:cut])
                    held_m, held_f = held_m[cut:], held_f[cut:]
        if len(held_f):
            yield flush(held_m, held_f)

    rows = write_table(dealt(fps.select("fp", F.lit(0).cast("long").alias("mask"))).select("mask", "key", "fp"), "simhash-keys")
    found = []
    while True:
        sizes = rows.groupBy("mask", "key").agg(F.count("*").alias("n"))
        many = write_table(sizes.where(F.col("n") > 1), "simhash-sizes")
        cool = rows.join(many.where(F.col("n") <= group_limit).select("mask", "key"), ["mask", "key"], "left_semi")
        ordered = cool.repartition("mask", "key").sortWithinPartitions("mask", "key").select("mask", "fp")
        found.append(write_table(ordered.mapInArrow(run, "a long, b long").distinct(), "simhash-links"))
        hot = many.where(F.col("n") > group_limit).select("mask", "key")
        if hot.isEmpty():
            break
        rows = write_table(dealt(rows.join(hot, ["mask", "key"], "left_semi").select("fp", "mask")).select("mask", "key", "fp").distinct(), "simhash-keys")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that edges (a, b) reach, by alternating large and small stars."""
    now = write_table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        new = write_table(small, "cc")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_table(now) if not now.isEmpty() else None
        now = new
        if state == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = state


def _roots(distinct: DataFrame, limit: int, group_limit: int) -> DataFrame:
    """``distinct`` (fp and more) with the fingerprint that stands for its component."""
    root = components(links(distinct, limit, group_limit))
    return distinct.join(root, distinct.fp == root.node, "left").select(*distinct.columns, F.coalesce("root", "fp").alias("root"))


def simhash_dedup(docs: DataFrame, width: int = 4, limit: int = 4, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(doc_id, fp, component_id, group_size): one row for each row of ``docs``.

    Fingerprints within ``limit`` bits link; component_id is the smallest doc_id of the rows that
    links reach, the row itself included. Null and blank texts have fingerprint zero and link like
    any other; rows that repeat a doc_id each appear; a null doc_id counts only where the component
    has no other (then component_id is null); an empty table gives no rows.
    """
    fps = write_table(simhash(docs, width), "simhash")
    distinct = write_table(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-distinct")
    rooted = _roots(distinct, limit, group_limit)
    best = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("group_size"))
    known = rooted.join(best, "root").select("fp", "component_id", "group_size").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (fps.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
            .join(known, ["fp", "salt"]).select("doc_id", "fp", "component_id", "group_size"))
