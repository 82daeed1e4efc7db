"""Vector codes: product quantisation over a lexicographic trie of distinct parts.

Vectors of whole numbers are cut into parts of consecutive components; each part position has a codebook.
The distinct parts of a position, with how many vectors have them, are range-partitioned in
lexicographic order, so that each task holds a stretch of the trie of their components. The trie is
gone through depth first: a node has the vector of its prefix's squared distances to all entries, which
its children share and add one component to. Subtrees of few leaves are finished a level at a time, all
their nodes in one array operation. A leaf takes the entry of least distance; its part, weighted by its
multiplicity, is added to that entry's sums, of which a task sends one row for each entry that it used.

Codebooks are all that passes the driver: ``parts`` times ``entries`` rows, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import sha256
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from .common import map_beside, skew_join, salts_for, write_table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LEAVES, HOT = 1_024, 50_000  # leaves of a subtree that is finished level by level; rows of a label that are dealt out
Book = np.ndarray  # entries x components


def whole_components(vector: Column, dims: int, scale: int = SCALE) -> Column:
    """floor(scale x) of each component, within what keeps all sums of squares in 64 bits."""
    bound = float(isqrt((1 << 63) // max(1, dims)) // 2 - 1)
    return F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-bound)), F.lit(bound))).cast("long"))


def usable(vector: Column) -> Column:
    """Is there a vector, without null or non-finite components?"""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return vector.isNotNull() & (F.size(vector) > 0) & finite


def nearest(rows: np.ndarray, book: Book) -> tuple[np.ndarray, np.ndarray]:
    """Of lexicographically sorted distinct rows: each one's nearest entry (the lowest of equals), and its squared distance."""
    n, dims = rows.shape
    entry, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return entry, distance
    # how many components each row shares with the one before it
    differs = rows[1:] != rows[:-1]
    shared = np.append(0, np.where(differs.any(1), differs.argmax(1), dims))
    todo = [(0, n, 0, np.zeros(len(book), np.int64))]  # nodes as (rows from, to, depth, the prefix's distances)
    while todo:
        lo, hi, depth, prefix = todo.pop()
        if hi - lo > LEAVES and depth < dims:
            heads = np.append(lo, lo + 1 + np.flatnonzero(shared[lo + 1:hi] <= depth))
            ends = np.append(heads[1:], hi)
            small = ends - heads <= LEAVES
            for a, z in zip(heads[~small], ends[~small], strict=True):
                todo.append((a, z, depth + 1, prefix + (rows[a, depth] - book[:, depth]) ** 2))
            for a, z in _stretches(heads[small], ends[small]):
                _finish(rows, book, shared, a, z, depth, prefix, entry, distance)
        else:
            _finish(rows, book, shared, lo, hi, depth, prefix, entry, distance)
    return entry, distance


def _stretches(heads: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Adjacent small children joined to stretches of LEAVES rows at most."""
    i = 0
    while i < len(heads):
        j = i + 1
        while j < len(heads) and heads[j] == ends[j - 1] and ends[j] - heads[i] <= LEAVES:
            j += 1
        yield heads[i], ends[j - 1]
        i = j


def _finish(rows: np.ndarray, book: Book, shared: np.ndarray, lo: int, hi: int, depth: int, prefix: np.ndarray, entry: np.ndarray, distance: np.ndarray) -> None:
    """The leaves of the rows from ``lo`` to ``hi``, which have a prefix of ``depth`` components in common."""
    new, node, sums = shared[lo:hi].copy(), np.zeros(hi - lo, np.int64), prefix[None, :]
    new[0] = 0
    for d in range(depth, rows.shape[1]):
        heads = np.flatnonzero(new <= d)  # rows that begin a node of the next level
        step = rows[lo + heads, d][:, None] - book[None, :, d]
        sums = sums[node[heads]] + step * step
        node = np.cumsum(new <= d) - 1
    entry[lo:hi], distance[lo:hi] = sums.argmin(1)[node], sums.min(1)[node]


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dims)


def _sums(batches: Iterator[pa.RecordBatch], books: list[Book]) -> Iterator[pa.RecordBatch]:
    """(part, entry, n, sums) of a task: of (part, vector, n) sorted by part, then vector."""
    dims = books[0].shape[1] if books else 0
    totals: dict[tuple[int, int], list] = {}
    for batch in batches:
        parts, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        rows = matrix(batch.column(1), dims)
        for p in np.unique(parts):
            mine = np.flatnonzero(parts == p)
            entry, _ = nearest(rows[mine], books[p])
            weighted = rows[mine] * n[mine][:, None]
            order = np.argsort(entry, kind="stable")
            used, heads = np.unique(entry[order], return_index=True)
            for e, many, total in zip(used, np.add.reduceat(n[mine][order], heads), np.add.reduceat(weighted[order], heads), strict=True):
                held = totals.setdefault((int(p), int(e)), [0, np.zeros(dims, np.int64)])
                held[0] += int(many)
                held[1] += total
    if totals:
        keys = sorted(totals)
        yield pa.RecordBatch.from_arrays([
            pa.array([p for p, _ in keys], pa.int32()), pa.array([e for _, e in keys], pa.int32()), pa.array([totals[k][0] for k in keys], pa.int64()),
            pa.array([totals[k][1].tolist() for k in keys], pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])


def distinct_parts(vectors: DataFrame, parts: int, width: int) -> DataFrame:
    """(part, vector, n): the distinct parts of each position in lexicographic order, and how many vectors have them."""
    cuts = F.array(*(F.slice("_whole", p * width + 1, width) for p in range(parts)))
    counts = vectors.select(F.posexplode(cuts).alias("part", "vector")).groupBy("part", "vector").agg(F.count("*").alias("n"))
    return write_table(counts.repartitionByRange("part", "vector"), "codes-parts", sort=["part", "vector"])


def trained(distinct: DataFrame, books: list[Book], rounds: int) -> list[Book]:
    """The codebooks after ``rounds`` rounds: each entry the floored mean of its parts, or as it was if it has none."""
    width = books[0].shape[1]
    for _ in range(rounds):
        sums = distinct.mapInArrow(partial(_sums, books=books), "part int, entry int, n long, sums array<long>")
        total = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(d))) for d in range(width))).alias("sums"))
        books = [b.copy() for b in books]
        for r in total.collect():  # a row for each entry of each codebook at most
            books[r["part"]][r["entry"]] = [s // r["n"] for s in r["sums"]]
    return books


def first_books(vectors: DataFrame, parts: int, width: int, entries: int) -> list[Book]:
    """The parts of the ``entries`` smallest vec_ids (null last, then by vector), in that order."""
    few = vectors.orderBy(F.asc_nulls_last("_vec_id"), "_whole").limit(entries).select("_whole").collect()
    rows = np.array([r[0] for r in few], np.int64).reshape(len(few), parts * width)
    return [rows[:, p * width:(p + 1) * width] for p in range(parts)]


def _encode(batches: Iterator[pa.RecordBatch], books: list[Book]) -> Iterator[pa.RecordBatch]:
    """The row, its code and its error: a batch's distinct parts are a trie of their own."""
    width = books[0].shape[1]
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = matrix(batch.column(1), width * len(books))
        code, error = [], np.zeros(len(rows), np.int64)
        for p, book in enumerate(books):
            distinct, of = np.unique(rows[:, p * width:(p + 1) * width], axis=0, return_inverse=True)
            entry, distance = nearest(distinct, book)
            code.append(entry[of])
            error += distance[of]
        digits = max(2, len(f"{max(len(books[0]) - 1, 0):x}"))
        text = ["".join(f"{e:0{digits}x}" for e in row) for row in np.stack(code, 1).tolist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text), pa.array(error)], ["_row", "_code", "_error"])


def books_digest(books: list[Book]) -> str:
    """SHA-256 of all entries' decimal components, by part, entry and position, joined by commas."""
    return sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[Book]]:
    """The columns of ``vectors`` plus ``_code`` and ``_error``, and the codebooks.

    Rows whose vector is null, empty or has a null or non-finite component are left out, and so are
    vectors of another length than that of the smallest vec_id. Where the length is no multiple of
    ``parts``, zeros are added at the end. Components count as floor(``scale`` x); those whose sum of
    squares wouldn't fit 64 bits count as the bound (1.8 10^5 for 64 components). Entries come from the
    ``entries`` smallest vec_ids, of equal ones the lesser vector first and null last; fewer rows give
    fewer entries. Rows that repeat count each time. Without usable rows the result is empty and there
    are no codebooks. Columns named like the new ones are replaced, others pass unchanged.
    """
    new = ["_code", "_error"]
    kept = [c for c in vectors.columns if c not in new]
    good = vectors.where(usable(F.col("embedding")))
    smallest = good.select("vec_id", F.size("embedding").alias("_dims")).orderBy(F.asc_nulls_last("vec_id"), "_dims").limit(1).collect()
    if not smallest:
        return vectors.where("false").select(*(f"`{c}`" for c in kept), F.lit("").alias("_code"), F.lit(0).cast("long").alias("_error")), []
    dims = smallest[0]["_dims"]
    width = -(-dims // parts)
    padded = F.concat(whole_components(F.col("embedding"), width * parts, scale), F.array_repeat(F.lit(0).cast("long"), width * parts - dims))
    good = good.where(F.size("embedding") == dims)
    whole = good.select(F.col("vec_id").alias("_vec_id"), padded.alias("_whole"))
    books = trained(distinct_parts(whole, parts, width), first_books(whole, parts, width, entries), rounds)
    coded = map_beside(good, kept, [padded], partial(_encode, books=books), [StructField("_code", StringType()), StructField("_error", LongType())])
    return coded, books


def label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """``coded`` with ``_label_error``: the errors of all rows of its label (nulls are one label) together."""
    key = F.struct(F.col(label).alias("l"))
    keyed = write_table(coded.withColumn("_label", F.to_json(key)), "codes-rows")
    sums = write_table(keyed.groupBy("_label").agg(F.sum("_error").alias("_label_error"), F.count("*").alias("_n")), "codes-labels")
    hot = sums.where(F.col("_n") > HOT)
    return skew_join(keyed, sums.drop("_n"), ["_label"], hot.select("_label"), ["vec_id", "_code"], salts_for(hot.agg(F.max("_n")).first()[0], HOT)).drop("_label")
