"""Near-duplicates by the exact Jaccard similarity of word shingles, found by prefix filtering.

All shingles have one order, seldom ones first; texts that are similar enough share one of the first
fifth of theirs, so only texts that meet there are compared. How often a shingle occurs is taken from
a sketch of fixed size: another order changes the work, never the result. Texts of equal shingles
count once. Texts whose SimHash fingerprints lie together in the Gray-order index are compared first, with,
of the texts that meet, neighbours by size and the largest; then a
forest of pairs that may join what these links left apart; then all pairs still apart. Parity bits of the shingles give a lower bound of the difference,
as many bits as the set has shingles or more, and what passes it is compared by all its shingles.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from .common import KeyFilter, drop_table, filter_bits, packed, text_of, write_table
from .simhash import components, links

SKETCH, CHUNK, SIGN, CACHE, BLOCK = 1 << 22, 1 << 16, 512, 1 << 16, 1 << 18
GROUP = 1 << 14  # sets that one task looks at of those that share a shingle; larger groups are cut by size and hash
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class _Words(dict):
    """XXH64 of words; emptied by shingles() when it grows, and at the end of a task."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        out = self[word] = xxh64_intdigest(word, 42)
        return out


_WORDS = _Words()


def shingles(text: str, width: int = 5) -> np.ndarray:
    """The distinct 64-bit hashes of the shingles of ``width`` words, ascending; fewer words are one shingle."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_WORDS) > CACHE:
        _WORDS.clear()
    x = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    h = np.zeros(max(1, len(words) - width + 1), np.uint64)
    for i in range(min(width, len(words))):
        h = h * np.uint64(0x9E3779B97F4A7C15) + x[i:i + len(h)]
        h ^= h >> np.uint64(31)
    return np.unique(h)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Is the Jaccard similarity of two sets 0.8 at least?"""
    both = np.sort(np.concatenate([a, b]))
    shared = int((both[1:] == both[:-1]).sum())
    return 5 * shared >= 4 * (len(a) + len(b) - shared)


def parity(s: np.ndarray, bits: int = SIGN) -> bytes:
    """For each of ``bits`` classes of shingles, is their number odd? Sets differ in as many shingles as these bits at least."""
    return np.packbits((np.bincount((s >> np.uint64(7)).astype(np.int64) % bits, minlength=bits) & 1).astype(np.uint8)).tobytes()


def wide_parity(s: np.ndarray) -> bytes | None:
    """The parity of more than SIGN shingles in a power of two of classes, no fewer than there are shingles; none of fewer shingles."""
    return parity(s, 1 << (len(s) - 1).bit_length()) if len(s) > SIGN else None


def fingerprint(s: np.ndarray) -> int:
    """The signed 64-bit SimHash of distinct shingles: bits set in over half of them."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(s), 1 << 14):
        ones += np.unpackbits(s[lo:lo + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(ones * 2 > len(s), bitorder="little").view("<i8")[0])


def may_be_similar(x: bytes, y: bytes, n: int) -> bool:
    """By their wide parities, may two sets of ``n`` shingles together be similar? The one with more classes is folded to the other's."""
    p, q = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    return 9 * int(np.bitwise_count(np.bitwise_xor.reduce(q.reshape(-1, len(p))) ^ p).sum(dtype=np.int64)) <= n


def _places(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(42)).astype(np.int64)


def first_shingles(s: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first shingles by how often they occur, then by hash: sets of similarity 0.8 share one of them."""
    n = len(s) - (4 * len(s) + 4) // 5 + 1
    return s[np.lexsort((s, often[_places(s)]))[:n]]


def shingled(docs: DataFrame, width: int) -> DataFrame:
    """The rows of ``docs`` with their sets' hash _k, size _n, fingerprint _fp and parities _sig and _wide, and the tasks' sketches of shingles."""
    rows = packed(docs, []).select("_row", "doc_id", F.xxhash64("doc_id", "text").alias("_th"), text_of().alias("_text"))
    new = [StructField("_k", LongType()), StructField("_n", IntegerType()), StructField("_fp", LongType()), StructField("_sig", BinaryType()), StructField("_wide", BinaryType()), StructField("_chunk", IntegerType()), StructField("_counts", BinaryType())]
    schema = StructType([*(StructField(c, rows.schema[c].dataType) for c in ("_row", "doc_id", "_th")), *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        counts, types = np.zeros(SKETCH, np.uint32), None
        for b in batches:
            types = [c.type for c in b.columns[:3]]
            for lo in range(0, b.num_rows, 128):
                cut = b.slice(lo, 128)
                sets = [shingles(t, width) for t in cut.column(3).to_pylist()]
                np.add.at(counts, _places(np.concatenate(sets)), 1)
                key = np.array([xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64)
                none = pa.nulls(len(sets))
                yield pa.RecordBatch.from_arrays([*cut.columns[:3], pa.array(key), pa.array([len(s) for s in sets], pa.int32()), pa.array([fingerprint(s) for s in sets], pa.int64()), pa.array([parity(s) for s in sets], pa.binary()),
                                                  pa.array([wide_parity(s) for s in sets], pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], schema.names)
        _WORDS.clear()
        if types:
            kinds = [*types, pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            for c in range(SKETCH // CHUNK):
                part = zlib.compress(counts[c * CHUNK:(c + 1) * CHUNK].tobytes(), 1)
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds), pa.array([c], pa.int32()), pa.array([part], pa.binary())], schema.names)

    return rows.mapInArrow(run, schema)


def frequencies(sketches: DataFrame) -> bytes:
    """For each place of the sketch a class of how often its shingles occur, 0 if not noticeably more than all do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for c, part in zip(b.column(0).to_pylist(), b.column(1)):
                total[c] = total.get(c, 0) + np.frombuffer(zlib.decompress(part.as_py()), np.uint32).astype(np.int64)
        for c, counts in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], ["c", "counts"])

    counts = np.zeros((SKETCH // CHUNK, CHUNK), np.uint32)
    for r in sketches.select("_chunk", "_counts").repartition("_chunk").mapInArrow(run, "c int, counts binary").toLocalIterator():
        counts[r["c"]] = np.minimum(np.frombuffer(zlib.decompress(r["counts"]), np.int64), 0xFFFFFFFF)
    usual = counts.mean()
    level = [np.where(c > usual + 4 * usual ** 0.5 + 8, np.minimum(255, 6 * np.log2(np.maximum(c, 1))), 0).astype(np.uint8) for c in counts]  # a chunk at a time spares the driver
    return zlib.compress(np.concatenate(level).tobytes())


def meetings(heads: DataFrame, often: bytes, width: int) -> DataFrame:
    """(tok, k, n, many): the first shingles that two sets or more have among theirs, and how many have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(zlib.decompress(often), np.uint8)
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                cut = b.slice(lo, 128)
                sets = [shingles(t, width) for t in cut.column(1).to_pylist()]
                first = [first_shingles(s, table) if len(s) else s for s in sets]
                many = [len(f) for f in first]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first).view(np.int64)), pa.array(np.repeat(cut.column(0).to_numpy(), many)),
                                                  pa.array(np.repeat(np.array([len(s) for s in sets], np.int32), many))], ["tok", "k", "n"])
        _WORDS.clear()

    met = heads.mapInArrow(run, "tok long, k long, n int").withColumn("many", F.count("*").over(Window.partitionBy("tok")))
    return met.where("many > 1")


def linked(pairs: DataFrame, heads: DataFrame, sets: DataFrame, width: int) -> DataFrame:
    """Those pairs (a, b) whose whole texts' similarity is 0.8 at least.

    Texts are read for pairs that their parities leave only; of large sets, which SIGN bits can't tell
    apart, the wide ones are asked. Each side of a pair reads the sets and texts that are on that side.
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, n = (b.column(i).to_numpy().astype(np.int64) for i in (2, 4))
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint64).reshape(-1, SIGN // 64) for i in (3, 5))
            out = pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(np.minimum(m, n) > SIGN)], ["a", "b", "large"])
            yield out.filter(pa.array(9 * np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= m + n))

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [may_be_similar(x, y, m + n) for m, x, n, y in zip(*(b.column(i).to_pylist() for i in range(2, 6)))]
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, keep = (None, None), []
            for a, x, y in zip(b.column(0).to_pylist(), b.column(2), b.column(3)):
                held = held if held[0] == a else (a, shingles(x.as_py(), width))
                keep.append(similar(held[1], shingles(y.as_py(), width)))
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
        _WORDS.clear()

    def of_side(rows: DataFrame, few: DataFrame, c: str) -> DataFrame:
        return KeyFilter(few, F.xxhash64(c)).mark(rows, F.xxhash64("k"), "_asked").where("_asked").drop("_asked").withColumnRenamed("k", c)

    facts = [sets.select(F.col("_k").alias(c), F.col("_n").alias(f"n_{c}"), F.col("_sig").alias(f"s_{c}")) for c in "ab"]
    few = pairs.join(facts[0], "a").join(facts[1], "b").select("a", "b", "n_a", "s_a", "n_b", "s_b")
    few = write_table(few.mapInArrow(near, "a long, b long, large boolean"), "near-pairs")
    large = few.where("large").select("a", "b")
    bits = sets.where(F.col("_n") > SIGN).select(F.col("_k").alias("k"), "_n", "_wide")
    sides = [of_side(bits, large, c).select(c, F.col("_n").alias(f"n_{c}"), F.col("_wide").alias(f"w_{c}")) for c in "ab"]
    large = large.join(sides[1], "b").join(sides[0], "a").select("a", "b", "n_a", "w_a", "n_b", "w_b").mapInArrow(wide, "a long, b long")
    few = write_table(few.where("not large").select("a", "b").unionByName(large), "near-pairs")
    texts = [of_side(heads, few, c).withColumnRenamed("text", f"t_{c}") for c in "ab"]
    both = few.join(texts[1], "b").join(texts[0], "a").select("a", "b", "t_a", "t_b")
    return write_table(both.mapInArrow(exact, "a long, b long"), "near-links")


def simhash_pairs(sets: DataFrame, limit: int = 4) -> DataFrame:
    """(a, b): sets that fingerprints within ``limit`` bits of each other connect, as a star for each fingerprint and those of the index."""
    first = write_table(sets.groupBy("_fp").agg(F.min("_k").alias("k"), F.count("*").alias("n")), "near-fingerprints")
    same = sets.join(first.where("n > 1"), "_fp").where("_k <> k").select(F.col("_k").alias("x"), F.col("k").alias("y"))
    found = links(first.select(F.col("_fp").alias("fp")), limit)
    x, y = (first.select(F.col("_fp").alias(c), F.col("k").alias(k)) for c, k in zip("ab", "xy"))
    return found.join(x, "a").join(y, "b").select("x", "y").unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def star_pairs(met: DataFrame, group: int = GROUP) -> DataFrame:
    """(a, b): of the sets that meet, each with the next larger one and with the largest; large groups are dealt out by size and hash."""
    w = Window.partitionBy("tok", "_deal").orderBy(F.desc("n"), "k")
    one = F.struct("k", "n")
    block = F.pmod(F.xxhash64("k"), F.ceil(F.col("many") / (8 * group)))
    deal = F.when(F.col("many") > group, F.concat_ws(" ", F.floor(F.log2("n") * 3), block)).otherwise("")  # steps of less than a quarter
    other = met.withColumn("_deal", deal).select("k", "n", F.array(F.lag(one).over(w), F.first(one).over(w)).alias("_o")).select("k", "n", F.explode("_o").alias("o")).where("o is not null and k <> o.k and 5L * n >= 4L * o.n")
    return other.select(F.least("k", "o.k").alias("a"), F.greatest("k", "o.k").alias("b")).distinct()


def dealt_groups(full: DataFrame, group: int) -> DataFrame:
    """(cell, part, n, k, root, _sig) in the order of ``cell``: every two sets that meet and may be similar by size share one.

    A shingle's sets are one cell, part 0. Those of a shingle with more than ``group`` sets are cut
    by the step of their size (sets that link are of one step or of neighbouring ones) and by hash
    into blocks of about ``group / 2``; a cell is then two blocks, its parts 1 and 2, of which only
    pairs across count, or one block alone.
    """
    hot, step = F.col("many") > group, F.floor(F.log2("n") * 3).cast("int")
    blocks = F.least(F.lit(1 << 12), F.ceil(F.col("many") * 2 / group)).cast("int")
    own = F.when(hot, F.pmod(F.xxhash64("k"), blocks)).otherwise(0).cast("int")
    cool = full.where(~hot).select(F.struct("tok", F.lit(0).alias("s"), F.lit(0).alias("x"), F.lit(-1).alias("y"), F.lit(False).alias("up")).alias("cell"),
                                   F.lit(0).alias("part"), "n", "k", "root", "_sig")
    placed = full.where(hot).withColumn("step", step).withColumn("own", own).withColumn("b", F.explode(F.sequence(F.lit(0), blocks - 1)))
    same = F.struct("tok", F.col("step").alias("s"), F.least("own", "b").alias("x"), F.greatest("own", "b").alias("y"), F.lit(False).alias("up"))
    low = F.struct("tok", F.col("step").alias("s"), F.col("own").alias("x"), F.col("b").alias("y"), F.lit(True).alias("up"))
    high = F.struct("tok", (F.col("step") - 1).alias("s"), F.col("b").alias("x"), F.col("own").alias("y"), F.lit(True).alias("up"))
    side = F.when(F.col("own") == F.col("b"), 0).otherwise(F.when(F.col("own") < F.col("b"), 1).otherwise(2))
    cells = F.array(F.struct(same.alias("cell"), side.alias("part")), F.struct(low.alias("cell"), F.lit(1).alias("part")), F.struct(high.alias("cell"), F.lit(2).alias("part")))
    warm = placed.select(F.explode(cells).alias("c"), "n", "k", "root", "_sig").select("c.cell", "c.part", "n", "k", "root", "_sig")
    return cool.unionByName(warm).withColumn("cell", F.xxhash64("cell")).repartition("cell").sortWithinPartitions("cell", "n", "k")


def spanning(label: np.ndarray, q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of places q, r as many as join what they join: a forest over labels, which are joined in ``label``."""
    kept = [np.zeros(0, np.int64)]
    at = np.arange(len(q))
    while True:
        a, b = label[q[at]], label[r[at]]
        at, a, b = at[a != b], a[a != b], b[a != b]
        if not len(at):
            break
        high, first = np.unique(np.maximum(a, b), return_index=True)  # each goes to a lower one, so there are no circles
        parent = np.arange(int(label.max()) + 1)
        parent[high] = np.minimum(a, b)[first]
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label[:] = parent[label]
        kept.append(at[first])
    chosen = np.concatenate(kept)
    return q[chosen], r[chosen]


def cross_pairs(met: DataFrame, roots: DataFrame, sets: DataFrame, group: int = GROUP, forest: bool = False) -> DataFrame:
    """(a, b): the sets that meet, have another root, and may be similar by size and parity.

    With ``forest`` only as many pairs of each group as would join the roots if all were similar.
    """

    def of_group(part, n, k, root, sig):
        hi = np.searchsorted(n, n + n // 4, side="right")  # sorted by n
        many = hi - np.arange(len(n)) - 1
        upto, lo, label = np.cumsum(many), 0, np.unique(root, return_inverse=True)[1]
        while lo < len(n):
            end = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + BLOCK, side="right")))
            c = many[lo:end]
            q = np.repeat(np.arange(lo, end), c)
            r = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + q + 1
            apart = (root[q] != root[r]) & ((part[q] != part[r]) | (part[q] == 0))
            q, r = q[apart], r[apart]
            differ = 9 * np.bitwise_count(sig[q] ^ sig[r]).sum(1, dtype=np.int64)
            near = differ <= n[q] + n[r]
            q, r, differ = q[near], r[near], differ[near] / (n[q] + n[r])[near]
            if forest:  # likely pairs first
                by = np.array_split(np.argsort(differ, kind="stable"), 8)
                q, r = (np.concatenate(x) for x in zip(*(spanning(label, q[i], r[i]) for i in by)))
            yield k[q], k[r]
            lo = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in chain(batches, [None]):
            if b is not None:
                now = [*(b.column(i).to_numpy().astype(np.int64) for i in range(5)), np.frombuffer(b"".join(b.column(5).to_pylist()), np.uint64).reshape(-1, SIGN // 64)]
                held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            if held is None or not len(held[0]):
                continue
            cuts = np.flatnonzero(held[0][1:] != held[0][:-1]) + 1
            starts = [0, *cuts.tolist()] + ([len(held[0])] if b is None else [])
            found = [p for lo, end in zip(starts, starts[1:]) for p in of_group(*(x[lo:end] for x in held[1:]))]
            held = None if b is None else [x[starts[-1]:] for x in held]
            if found:
                x, y = (np.concatenate(z) for z in zip(*found))
                pairs = np.unique(np.column_stack([np.minimum(x, y), np.maximum(x, y)]), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    rooted = met.join(roots, met.k == roots.node, "left").select("tok", "n", "k", "many", F.coalesce("root", "k").alias("root"))
    ends = rooted.groupBy("tok").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("tok")
    live = rooted.join(ends, "tok", "left_semi")
    full = live.join(sets.select(F.col("_k").alias("k"), "_sig"), "k")
    return dealt_groups(full, group).mapInArrow(run, "a long, b long").distinct()


def near_dedup(docs: DataFrame, width: int = 5, group: int = GROUP) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one for each component of linked texts.

    Two texts link if the sets of their shingles of ``width`` words (lower-cased in ASCII; all words
    of a shorter text) have a Jaccard similarity of 0.8 at least; null and blank texts link with each
    other. Shingles, and equal sets, are told by 64-bit hashes. The smallest doc_id stays (null last),
    of rows that repeat it the one with the least hash of the text, and of equal rows any one. More
    than ``group`` sets that share a shingle are compared by several tasks; the result is the same.
    """
    made = write_table(shingled(docs, width), "near-rows")
    rows = made.where("_chunk is null")
    often = frequencies(made.where("_chunk is not null"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("_th").alias("th"), F.col("_k").alias("k"))
    sets = write_table(rows.groupBy("_k").agg(F.min(place).alias("best"), F.count("*").alias("_copies"), F.min("_n").alias("_n"), F.min("_fp").alias("_fp"), F.min("_sig").alias("_sig"), F.min("_wide").alias("_wide")), "near-sets")
    many = sets.where("_copies > 1").select("_k", F.col("best.th").alias("_th"))
    key = F.xxhash64("_k")
    copied = KeyFilter(many, key)
    copied.maps = write_table(copied.maps, "near-many")
    marked = copied.mark(rows.select("_k", "_th", text_of("_row.text").alias("text")), key, "_many")
    alone = marked.where("not _many").select(F.col("_k").alias("k"), "text")  # read from the rows each time: written, the texts would take as much disk again
    chosen = marked.where("_many").join(sets.select("_k", F.col("best.th").alias("_th")), ["_k", "_th"], "left_semi").dropDuplicates(["_k"])
    chosen = write_table(chosen.select(F.col("_k").alias("k"), "text"), "near-heads")
    heads = alone.unionByName(chosen)

    met = write_table(meetings(heads, often, width), "near-meetings")
    stars = linked(simhash_pairs(sets).unionByName(star_pairs(met, group)).distinct(), heads, sets, width)
    root = components(stars)
    for forest in (True, False):  # first as few pairs as may join what stars left apart, then whatever is apart even so
        more = linked(cross_pairs(met, root, sets, group, forest), heads, sets, width)
        root = components(root.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    rooted = sets.join(root, sets["_k"] == root.node, "left").select("best", F.coalesce("root", "_k").alias("root"))
    winners = write_table(rooted.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.k").alias("_k"), F.col("best.th").alias("_th")), "near-winners")
    for used in (met, chosen):
        drop_table(used)
    return staying(rows, winners)


def staying(rows: DataFrame, winners: DataFrame) -> DataFrame:
    """The _row of each of ``winners`` (_k, _th), once.

    Two bitmaps tell which rows may have won and which may have lost or may be repeated; only rows
    that may be both are shuffled, since whole rows of the table would take as much disk as it does.
    """
    twice = rows.groupBy("_k", "_th").agg(F.count("*").alias("n")).join(winners.withColumn("_won", F.lit(True)), ["_k", "_th"], "left")
    odd = write_table(twice.where("n > 1 or _won is null").select("_k", "_th", F.col("_won").isNull().alias("_lost")), "near-odd")
    key = F.xxhash64("_k", "_th")
    seen = KeyFilter(winners, key, filter_bits(winners.count())).mark(rows.select("_row", "_k", "_th"), key, "_may").where("_may")
    flagged = KeyFilter(odd, key, filter_bits(odd.count())).mark(seen, key, "_odd")
    once = flagged.where("not _odd").select("_row.*")
    told = flagged.where("_odd").join(odd.where("_lost"), ["_k", "_th"], "left_anti")
    return once.unionByName(told.dropDuplicates(["_k", "_th"]).select("_row.*"))
