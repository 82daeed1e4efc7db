"""Language-model scores by deleted interpolation.

Maximum-likelihood estimates of all orders up to ``order`` and a uniform floor are mixed; the
mixture weights depend on the frequency bucket of the context (of the longest one that was seen)
and are learned by expectation-maximisation: the training documents of one fold are deleted, the
estimates come from the others, and the weights maximise the likelihood of the deleted fold's
counts. Scores then use the counts of all training documents.

N-grams are 64-bit hashes. A chunk of documents is counted by itself; its sorted distinct hashes go
to buckets by their leading bits, where the corpus counts are summed and sent back to each chunk in
the order of its hashes. So a shuffle carries each chunk's distinct n-grams once, whatever their
frequency, and neither the vocabulary nor the counts meet in one place. There is a bucket for every
few chunks, so that one holds as much whatever the corpus. Of many chunks each would have little for
a bucket; so they are merged in blocks of about the square root of their number first, the blocks
then as if they were chunks, and the counts come back the same way. Rows sent then grow with the
number of chunks to the power of one and a half, and each has thousands of n-grams.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, LongType, StructField, StructType

from .common import crc_fold, drop_table, text_of, write_table

ORDER, CHUNK_BYTES, BUCKETS = 2, 8 << 20, 20
CHUNKS_A_BUCKET = 4  # a bucket gets as many n-grams as this many chunks have
WIDE = 1024  # more chunks than this are merged in blocks first
MERGE_TASKS = 20_000  # partitions of a merge at most; a task with several buckets merges one after another
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
START, END = 8, 16  # what stands for the places before a text and for its end, beside word hashes


def planes(x: np.ndarray) -> bytes:
    """An array's bytes, those of equal weight together, which compresses well."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def whole(b: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(b, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def split_chunks(docs: DataFrame, train: Column, deleted: Column) -> DataFrame:
    """(chunk, ids, part, ends, vocabulary, tokens): texts as word numbers of their chunk.

    part: 0 training, 1 the deleted fold of training, 2 held out.
    """
    schema = StructType([StructField("chunk", LongType()), StructField("ids", ArrayType(docs.schema["doc_id"].dataType)),
                         *(StructField(c, BinaryType()) for c in ("part", "ends", "vocabulary", "tokens"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        def flush():
            known, new = {b"": 0}, 1
            words = []
            for t in texts:
                for w in t:
                    if w not in known:
                        known[w] = new
                        new += 1
                words.append(np.fromiter(map(known.__getitem__, t), np.int32, len(t)))
                words.append(np.zeros(1, np.int32))  # the end
            h = np.array([END, *(xxh64_intdigest(w) for w in list(known)[1:])], np.uint64)
            ends = np.cumsum([len(t) + 1 for t in texts]).astype(np.int64)
            return pa.RecordBatch.from_arrays([
                pa.array([chunk], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([np.array(parts, np.uint8).tobytes()], pa.binary()),
                *(pa.array([x.tobytes()], pa.binary()) for x in (ends, h)), pa.array([planes(np.concatenate(words))], pa.binary())], schema.names)

        texts, ids, parts, size, chunk, kind = [], [], [], 0, None, None
        for b in batches:
            kind = b.column(0).type
            for doc, text, part, base in zip(*(c.to_pylist() for c in b.columns)):
                chunk = base if chunk is None else chunk
                texts.append(text.translate(_LOWER).split())
                ids.append(doc)
                parts.append(part)
                size += len(text)
                if size >= CHUNK_BYTES:
                    yield flush()
                    texts, ids, parts, size, chunk = [], [], [], 0, chunk + 1
        if texts:
            yield flush()

    part = F.when(train & ~deleted, 0).when(train, 1).otherwise(2)
    return docs.select("doc_id", text_of().cast("binary").alias("text"), part.alias("part"),
                       (F.spark_partition_id().cast("long") * (1 << 32)).alias("base")).mapInArrow(run, schema)


class Chunk:
    """The n-gram hashes of a chunk: one of each order for each token, and the contexts before texts."""

    def __init__(self, ends: bytes, vocabulary: bytes, tokens: bytes, part: bytes, order: int):
        self.ends = np.frombuffer(ends, np.int64)
        words = np.frombuffer(vocabulary, np.uint64)[whole(tokens, np.int32)]
        begin = np.concatenate([[0], self.ends[:-1]])
        n, docs = len(words), len(self.ends)
        lengths = self.ends - begin
        self.part = np.frombuffer(part, np.uint8)
        # each text gets order - 1 starts in front; ``at`` are the places of its own tokens
        pad = order - 1 or 1
        self.at = np.arange(n) + np.repeat(np.arange(1, docs + 1) * pad, lengths)
        line = np.full(n + docs * pad, START, np.uint64)
        line[self.at] = words
        self.token_part = np.repeat(self.part, lengths)
        self.line_part = np.repeat(self.part, lengths + pad)
        grams, h = [], line
        for k in range(1, order + 1):
            if k > 1:
                h = np.concatenate([[np.uint64(0)], h[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + line * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(k)
                h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(29)
            grams.append(h & ~np.uint64(7) | np.uint64(k))
        self.grams = grams
        self.front = np.zeros(len(line), bool)  # the last start of each text: the context of its first token
        self.front[self.at[begin] - 1] = True
        own = np.zeros(len(line), bool)
        own[self.at] = True
        self.counted = [np.flatnonzero(own | self.front) if k < order else np.flatnonzero(own) for k in range(1, order + 1)]
        self.order = order

    def distinct(self, inverse: bool = False):
        """The sorted hashes, with the place of each counted n-gram among them or their counts by part."""
        every = np.concatenate([g[c] for g, c in zip(self.grams, self.counted)])
        part = np.concatenate([self.line_part[c] for c in self.counted])
        if inverse:
            u, inv = np.unique(every, return_inverse=True)
            place, lo = [], 0
            for c in self.counted:
                where = np.zeros(len(self.grams[0]), np.int64)
                where[c] = inv[lo:lo + len(c)]
                place.append(where)
                lo += len(c)
            return u, place
        o = np.argsort(every)
        every, part = every[o], part[o]
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        counts = [np.add.reduceat((part == k).astype(np.int64), first).astype(np.uint32) for k in (0, 1)]
        return every[first], counts

    def components(self, counts: np.ndarray, place: list[np.ndarray], n: float, v: float) -> tuple[np.ndarray, np.ndarray]:
        """For each token: estimates of all orders (uniform, unigram, ...) and the context's bucket."""
        p = [np.full(len(self.at), 1 / (v + 1)), counts[place[0][self.at]] / max(n, 1)]
        bucket = np.zeros(len(self.at), np.int64)
        for k in range(2, self.order + 1):
            context = counts[place[k - 2][self.at - 1]]
            p.append(counts[place[k - 1][self.at]] / np.maximum(context, 1))
            seen = context > 0
            bucket[seen] = (k - 2) * BUCKETS + 1 + np.minimum(np.log2(context[seen]).astype(np.int64), BUCKETS - 1)
        return np.stack(p), bucket


def _column(t: pa.Table, name: str) -> list:
    return t.column(name).to_pylist()


def _by_bucket(u: np.ndarray, counts: list[np.ndarray], buckets: int) -> Iterator[tuple]:
    """(bucket, hashes, counts ...) of sorted hashes: a row at most for each n-gram, however many buckets."""
    bucket = ((u >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(u)]):
        yield int(bucket[lo]), planes(np.diff(u[lo:hi], prepend=np.uint64(0))), *(planes(x[lo:hi]) for x in counts)


def _merged(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct hashes of a bucket's rows, where each row's are among them, and their summed counts."""
    hashes = [np.cumsum(whole(x, np.uint64), dtype=np.uint64) for x in _column(t, "hashes")]
    u, inv = np.unique(np.concatenate(hashes), return_inverse=True)
    counts = [np.bincount(inv, np.concatenate([whole(x, np.uint32) for x in _column(t, c)]), len(u)).astype(np.uint32) for c in ("kept", "deleted")]
    return u, inv, np.cumsum([0, *map(len, hashes)]), counts


SENT = "bucket long, chunk long, hashes binary, kept binary, deleted binary"
ANSWERED = "chunk long, bucket long, kept binary, trained binary, stats array<double>"


def _sent(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    cols = zip(*rows) if rows else [()] * 5
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], ["bucket", "chunk", "hashes", "kept", "deleted"])


def _answered(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.float64()))
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["chunk", "bucket", "kept", "trained", "stats"])


def _answers(sent: DataFrame, buckets: int) -> DataFrame:
    """The counts of each bucket, sent back to the chunks (or blocks) that asked, and its totals."""
    def merge(t: pa.Table) -> pa.Table:
        u, inv, sizes, (kept, deleted) = _merged(t)
        trained, bucket = kept + deleted, _column(t, "bucket")[0]
        word = (u & np.uint64(7) == 1) & (u != np.uint64(START & ~7 | 1))
        nv = [[float(x[word].sum()), float((x[word] > 0).sum())] for x in (kept, trained)]
        rows = [(c, bucket, planes(kept[inv[a:b]]), planes(trained[inv[a:b]]), None) for c, a, b in zip(_column(t, "chunk"), sizes, sizes[1:])]
        return _answered([*rows, (-1, bucket, None, None, nv[0] + nv[1])])

    return sent.repartition(min(buckets, MERGE_TASKS), "bucket").groupBy("bucket").applyInArrow(merge, ANSWERED)


def corpus_counts(chunks: DataFrame, order: int, buckets: int, blocks: int = 1) -> DataFrame:
    """(chunk, bucket, kept, trained, stats): the corpus counts of each chunk's distinct hashes.

    kept: in training but the deleted fold; trained: in all training. A row of chunk -1 for each
    bucket has the tokens and token types of both (stats). With ``blocks`` over one, chunks are merged in that
    many blocks first, each by as many buckets as suit its chunks.
    """
    fine = buckets if blocks == 1 else max(1, -(-buckets // blocks))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, chunk, part, ends, vocabulary, tokens in (tuple(x.as_py() for x in r) for r in zip(*b.columns)):
                u, counts = Chunk(ends, vocabulary, tokens, part, order).distinct()
                for bucket, *rest in _by_bucket(u, counts, fine):
                    yield from _sent([(block * fine + bucket, chunk, *rest)]).to_batches()

    sent = chunks.select(F.pmod(F.xxhash64("chunk"), F.lit(blocks)).cast("long").alias("block"), "chunk", "part", "ends", "vocabulary", "tokens").mapInArrow(emit, SENT)
    if blocks == 1:
        return _answers(sent, buckets)

    def pass_on(t: pa.Table) -> pa.Table:
        u, _, _, counts = _merged(t)
        place = _column(t, "bucket")[0]  # of the block and its bucket, which ask the corpus as a chunk does
        return _sent([(bucket, place, *rest) for bucket, *rest in _by_bucket(u, counts, buckets)])

    def give_back(left: pa.Table, right: pa.Table) -> pa.Table:
        _, inv, sizes, _ = _merged(left)
        kept, trained = (np.concatenate([whole(x, np.uint32) for _, x in sorted(zip(_column(right, "bucket"), _column(right, c)))]) for c in ("kept", "trained"))
        return _answered([(c, p, planes(kept[inv[a:b]]), planes(trained[inv[a:b]]), None)
                          for c, p, a, b in zip(_column(left, "chunk"), _column(left, "bucket"), sizes, sizes[1:])])

    tasks = min(blocks * fine, MERGE_TASKS)
    sent = write_table(sent, "lm-sent", heavy=True)
    of_blocks = write_table(_answers(sent.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(pass_on, SENT), buckets), "lm-blocks", heavy=True)
    asked = of_blocks.where("chunk >= 0").withColumnRenamed("chunk", "place")
    back = sent.groupBy("bucket").cogroup(asked.groupBy("place")).applyInArrow(give_back, ANSWERED)
    return back.unionByName(of_blocks.where("chunk = -1"))


def learn_weights(samples: DataFrame, width: int, size: int, rounds: int = 30, close: float = 1e-5) -> np.ndarray:
    """Mixture weights (bucket, component) by expectation-maximisation over the deleted fold's counts."""
    weights = np.full((size, width), 1 / width)
    before = -np.inf
    for _ in range(rounds):
        def expect(batches: Iterator[pa.RecordBatch], now=weights) -> Iterator[pa.RecordBatch]:
            total, like = np.zeros((size, width)), 0.0
            for b in batches:
                for bucket, p, n in zip(*(c.to_pylist() for c in b.columns)):
                    k, n = np.frombuffer(bucket, np.uint8), whole(n, np.uint32)
                    x = whole(p, np.float32).reshape(width, -1) * now[k].T
                    mix = x.sum(0)
                    like += float(n @ np.log(mix))
                    x *= n / mix
                    for i in range(width):
                        total[:, i] += np.bincount(k, x[i], size)
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()]), pa.array([like])], ["total", "like"])

        got = samples.mapInArrow(expect, "total array<double>, like double").select(
            "like", F.posexplode("total")).groupBy("pos").agg(F.sum("col").alias("x"), F.sum("like").alias("like")).collect()
        total = np.zeros(size * width)
        for r in got:
            total[r["pos"]] = r["x"]
        like = got[0]["like"] if got else 0.0
        if not total.any():
            return weights
        total = total.reshape(size, width) + 1e-3  # unseen buckets stay even, no weight is nothing
        weights = total / total.sum(1, keepdims=True)
        if like - before < close * abs(like):
            break
        before = like
    return weights


def lm_score(docs: DataFrame, held_out: Column, deleted: Column, order: int = ORDER, buckets: int | None = None, blocks: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each whole text.

    Words are runs of other than ASCII white space, A-Z lower-cased, and an end closes each text.
    ``held_out`` rows are scored but not learned from; ``deleted`` ones of the rest are the fold that
    the weights are learned on. base_score is the add-one unigram score, score the mixture's log10
    probability. A null or blank text is its end alone; repeated rows count and are scored each; a
    null doc_id is as good as any; without training rows every probability is the uniform floor's;
    an empty table gives no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    held = F.coalesce(held_out, F.lit(False))
    chunks = write_table(split_chunks(docs, ~held, F.coalesce(deleted, F.lit(False))), "lm-chunks", heavy=True)
    n_chunks = chunks.count()
    buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_chunks // CHUNKS_A_BUCKET))
    blocks = blocks or (1 if n_chunks <= WIDE else math.isqrt(n_chunks))
    answers = write_table(corpus_counts(chunks, order, buckets, blocks), "lm-counts", heavy=True)
    stats = answers.where("chunk = -1").select(*(F.sum(F.col("stats")[i]) for i in range(4))).first()
    n_kept, v_kept, n, v = (float(x or 0) for x in stats)
    size, width = (order - 1) * BUCKETS + 1, order + 1
    back = answers.where("chunk >= 0").select("chunk", "bucket", "kept", "trained")

    def counts_of(t: pa.Table, name: str) -> np.ndarray:
        rows = sorted(zip(_column(t, "bucket"), _column(t, name)))
        return np.concatenate([whole(x, np.uint32) for _, x in rows]).astype(np.float64)

    def chunk_of(t: pa.Table) -> Chunk:
        return Chunk(*(_column(t, c)[0] for c in ("ends", "vocabulary", "tokens", "part")), order)

    def sample(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = chunk_of(left)
        _, place = chunk.distinct(inverse=True)
        some = np.flatnonzero(chunk.token_part == 1)
        p, bucket = chunk.components(counts_of(right, "kept"), place, n_kept, v_kept)
        rows = np.column_stack([bucket[some], *p[1:, some].astype(np.float32).view(np.int32).astype(np.int64)])
        o = np.lexsort(rows.T)  # equal estimates are told by all their columns and sent once
        new = np.flatnonzero(np.concatenate([[True], (rows[o[1:]] != rows[o[:-1]]).any(axis=1)])[:len(o)])
        first, times = o[new], np.diff(new, append=len(o))
        k = bucket[some][first].astype(np.uint8)
        return pa.table([pa.array([k.tobytes()], pa.binary()), pa.array([planes(p[:, some][:, first].astype(np.float32).ravel())], pa.binary()),
                         pa.array([planes(times.astype(np.uint32))], pa.binary())], ["bucket", "p", "n"])

    pairs = lambda: chunks.groupBy("chunk").cogroup(back.groupBy("chunk"))
    samples = write_table(pairs().applyInArrow(sample, "bucket binary, p binary, n binary"), "lm-samples", heavy=True)
    weights = learn_weights(samples, width, size)
    drop_table(samples) if not samples.isEmpty() else None
    schema = StructType([docs.schema["doc_id"], StructField("held_out", BooleanType()), *(StructField(c, LongType()) for c in ("n_tokens", "n_known", "train_tokens")),
                         StructField("base_score", DoubleType()), StructField("score", DoubleType())])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = chunk_of(left)
        _, place = chunk.distinct(inverse=True)
        counts = counts_of(right, "trained")
        p, bucket = chunk.components(counts, place, n, v)
        logp = np.log10((weights[bucket].T * p).sum(0))
        c = counts[place[0][chunk.at]]
        base = np.log10((c + 1) / (n + v + 1))
        begin = np.concatenate([[0], chunk.ends[:-1]])
        return pa.table([left.column("ids").combine_chunks().flatten(), pa.array(chunk.part == 2), pa.array(chunk.ends - begin),
                         pa.array(np.add.reduceat((c > 0).astype(np.int64), begin)), pa.array(np.full(len(begin), int(n))),
                         pa.array(np.add.reduceat(base, begin)), pa.array(np.add.reduceat(logp, begin))], schema.names)

    return pairs().applyInArrow(score, schema)


def folds(n: int = 7, held: int = 2, deleted: int = 3) -> tuple[Column, Column]:
    """Conditions for the held-out fold and the deleted one, by crc32 of doc_id as text."""
    fold = crc_fold(F.col("doc_id"), n)
    return fold == held, fold == deleted
