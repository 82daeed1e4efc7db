"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of its documents' tokens. Every window of ``size`` tokens serves the queues
in turn; a queue's credit grows by ``size`` times its target share a window, it is served whole
tokens, and the part it is owed (its deficit, less than one token) is carried on. After ``i``
windows the queues up to the k-th have therefore been served ``floor(i * size * P_k)`` tokens,
``P_k`` being their shares' sum: deficits over any number of windows, and so over partitions, are
known without serving the windows one after the other. When a queue runs dry its share of that
window is refilled by the others, which then divide its share; every window but the last is full.

Only the token totals of sources that are large enough for a queue of their own pass the driver,
and two sums for all others, so many sources (hosts, say) do no harm. The tokens stay with their document: a task
turns a document's place in its queue into its pieces by the plan, without a shuffle by window.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, LongType, BinaryType, StringType

from .common import text_of, write_table

SHARES = 1 << 16  # a share is a whole number of these parts
CACHE_WORDS = 300_000
SIGNS = frozenset(b"%c" % c for c in b".,;:!?)\"")  # ASCII signs that often end a word; none takes part in a contraction
SMALL, UNNAMED = "small", "unnamed"  # queues that sources without one of their own share


class ChunkTokenizer(dict):
    """Token ids of whole texts by a tokenizers file that lower-cases and never crosses white space.

    Texts are cut at ASCII white space and each distinct chunk is encoded once: pieces of Latin
    letters, digits and signs by the vocabulary's model, anything else by the whole tokenizer. The
    chunks (this dict) are remembered for the worker's next batches, up to a fixed number; then they
    become the older ones, which are still looked up, and those before them are forgotten.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        from .bpe import byte_chars

        super().__init__()
        self.older: dict[bytes, bytes] = {}
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model.tokenize
        self.kind, self.code = (np.uint16, "H") if self.tok.get_vocab_size() <= 1 << 16 else (np.uint32, "I")
        with open(path, encoding="utf-8") as f:
            steps = json.load(f)["pre_tokenizer"]["pretokenizers"]
        self.pieces = regex.compile(steps[0]["pattern"]["Regex"]).findall
        self.simple = regex.compile("[\x21-\x26\x28-\x7e\xa1-\xff\u0100-\u012f\u0131-\u024f]+").fullmatch
        self.chars = dict(byte_chars())

    def __missing__(self, chunk: bytes) -> bytes:
        out = self.older.get(chunk) or self.ids(chunk)
        self[chunk] = out
        return out

    def ids(self, chunk: bytes) -> bytes:
        if chunk.isalpha():  # ASCII letters are one piece
            return self.packed([t.id for t in self.model(chunk.decode().lower())])
        if chunk[:-1].isalpha() and chunk[-1:] in SIGNS:  # so they are before a sign, which is the other
            word = chunk[:-1]
            return (self.get(word) or self.older.get(word) or self.ids(word)) + self[chunk[-1:]]
        text = chunk.decode()
        if not self.simple(text) or "<|" in text:
            return self.packed(self.tok.encode(text, add_special_tokens=False).ids)
        low = text.lower()
        return self.packed([t.id for p in ([low] if low.isalpha() else self.pieces(low))
                            for t in self.model(p if p.isascii() else p.encode().decode("latin-1").translate(self.chars))])

    def packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def encode(self, texts: list[str], end: int) -> list[bytes]:
        """The ids of each text and then ``end``, as little-endian bytes of ``kind``."""
        tail, out = np.array([end], self.kind).tobytes(), []
        for t in texts:
            raw = t.encode()
            chunks = (raw if b"<|" in raw else raw.lower()).split()
            out.append(b"".join([*map(self.__getitem__, chunks), tail]))
            if len(self) > CACHE_WORDS:
                self.older = dict(self)
                self.clear()
        return out


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
    return _TOKENIZERS[path]


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int, source: str = "source") -> DataFrame:
    """(doc_id, queue, part, start_in_part, n, ids): each task numbers its own part of each queue."""
    schema = StructType([docs.schema["doc_id"], StructField("queue", StringType()), StructField("part", LongType()),
                         StructField("start_in_part", LongType()), StructField("n", LongType()),
                         StructField("ids", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, at = tokenizer(tokenizer_path), {}
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                cut = b.slice(lo, 256)
                ids = tok.encode(cut.column(3).to_pylist(), end_id)
                n = [len(x) // np.dtype(tok.kind).itemsize for x in ids]
                starts = []
                for q, k in zip(cut.column(1).to_pylist(), n):
                    starts.append(at.get(q, 0))
                    at[q] = starts[-1] + k
                yield pa.RecordBatch.from_arrays([*cut.columns[:3], pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], schema.names)

    return docs.select("doc_id", F.coalesce(F.col(source).cast("string"), F.lit("")).alias("queue"),
                       F.spark_partition_id().cast("long").alias("part"), text_of().alias("text")
                       ).mapInArrow(run, schema)


class Plan:
    """The windows of all queues as runs of equal rounds; one queue at least ends with each run."""

    def __init__(self, totals: list[int], weights: list[float], size: int):
        self.size, self.runs = size, []  # (first window, windows, served before, parts up to each queue or takes)
        left = np.array(totals, dtype=np.int64)
        natural, aims = left.astype(float), np.array(weights, dtype=float)
        served, window = np.zeros(len(left), np.int64), 0
        while left.sum() > 0:
            live = (left > 0) & (aims > 0)
            share = np.where(live, aims, 0) if live.any() else np.where(left > 0, natural, 0)
            live = share > 0
            parts = np.where(live, np.maximum(np.round(share / share.sum() * SHARES), 2 * SHARES // size + 1), 0).astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(parts)])
            rounds = int(min(left[live] * upto[-1] // (parts[live] * size))) + 1
            while rounds and (np.diff(rounds * size * upto // upto[-1]) > left).any():
                rounds -= 1
            if rounds:
                self.runs.append((window, rounds, served.copy(), upto, False))
                took = np.diff(rounds * size * upto // upto[-1])
                left, served, window = left - took, served + took, window + rounds
            if left.sum():  # the window in which a queue runs dry: the others refill what it lacks
                take = np.minimum(np.diff(size * upto // upto[-1]), left)
                for some in (live, left > 0):
                    for q in np.flatnonzero(some):
                        take[q] += min(left[q] - take[q], size - take.sum())
                self.runs.append((window, 1, served.copy(), np.concatenate([[0], np.cumsum(take)]), True))
                left, served, window = left - take, served + take, window + 1
        self.windows = window

    def pieces(self, q: int, first: int, n: int) -> list[tuple[int, int, int, int]]:
        """(start in the document, length, window, offset there) of a document's n tokens from ``first`` of queue q."""
        out, at, end = [], first, first + n
        bases = [r[2][q] for r in self.runs]
        k = int(np.searchsorted(bases, at, side="right")) - 1
        while at < end:
            window, rounds, served, upto, once = self.runs[k]
            lo, hi, whole = int(upto[q]), int(upto[q + 1]), int(upto[-1])
            if once:
                got = [(0, lo, hi - lo)]
            elif hi == lo:
                got = []
            else:
                got = self._rounds(at - int(served[q]), end - int(served[q]), lo, hi, whole, rounds)
            base = int(served[q])
            for i, offset, take in got:
                start = base if once else base + i * self.size * hi // whole - i * self.size * lo // whole
                a, b = max(at, start), min(end, start + take)
                if a < b:
                    out.append((a - first, b - a, window + i, offset + a - start))
                    at = b
            k += 1
        return out

    def _rounds(self, x: int, y: int, lo: int, hi: int, whole: int, rounds: int) -> Iterator[tuple[int, int, int]]:
        i = max(0, x * whole // ((hi - lo) * self.size) - 2)
        while i < rounds:
            a, b = i * self.size, (i + 1) * self.size
            start = a * hi // whole - a * lo // whole
            if start >= y:
                return
            offset = b * lo // whole - a * lo // whole
            yield i, offset, (b * hi // whole - a * hi // whole) - offset
            i += 1


def pack(docs: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 2, source: str = "source",
         targets: dict[str, float] | None = None, broadcast_rows: int = 500_000) -> DataFrame:
    """Pieces (doc_id, queue, start, length, doc_tokens, sequence_id, offset, ids).

    ``targets`` gives the token shares of sources; without it each source has its share of all
    tokens, so that all queues end together. Sources it does not name are packed once the named
    ones are used up. Sources with a share under two tokens a window share one queue, unnamed ones
    with so few of all tokens another. ``ids`` has the piece's ids as little-endian unsigned 32-bit
    numbers. A null text is empty: its document is ``end_id`` alone; a null source is the queue '';
    rows that repeat a doc_id are packed each; an
    empty table gives no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    tokens = write_table(tokenised(docs, tokenizer_path, end_id, source), "pack-tokens")
    parts = write_table(tokens.groupBy("queue", "part").agg(F.sum("n").alias("n")), "pack-parts")
    totals = write_table(parts.groupBy("queue").agg(F.sum("n").alias("n")), "pack-totals")
    whole = totals.agg(F.sum("n")).first()[0] or 0
    # a queue of its own needs two tokens a window, so at most size / 2 sources a kind have one; the others go by two sums
    given = spark.createDataFrame([(q, float(w)) for q, w in (targets or {}).items()], "queue string, target double")
    least = 2 / size * (sum(max(w, 0) for w in (targets or {}).values()) or 1)
    share = F.col("n") / F.lit(float(whole or 1))
    aimed = totals.join(F.broadcast(given), "queue", "left").withColumn("aim", F.coalesce("target", F.lit(0.0)) if targets else share)
    own = F.when(F.col("aim") > 0, F.col("aim") >= least).otherwise(share >= 2 / size)
    kinds = write_table(aimed.select("queue", "n", "aim", own.alias("own"), F.when(F.col("aim") > 0, SMALL).otherwise(UNNAMED).alias("shared")), "pack-queues")
    queues = [tuple(r) for r in kinds.where("own").select("queue", "n", "aim").orderBy("queue").collect()]
    rest = {r["shared"]: (r["n"], r["aim"]) for r in kinds.where("not own").groupBy("shared").agg(F.sum("n").alias("n"), F.sum("aim").alias("aim")).collect()}
    number = [(q, k) for k, (q, _, _) in enumerate(queues)]
    at = {kind: len(queues) + k for k, kind in enumerate(sorted(rest))}
    both = [(n, aim) for _, n, aim in queues] + [rest[kind] for kind in sorted(rest)]
    plan = Plan([int(n) for n, _ in both], [float(aim) for _, aim in both], size)

    numbers = spark.createDataFrame(number, "queue string, number int")
    place = F.coalesce("number", F.when(F.col("shared") == SMALL, at.get(SMALL)).otherwise(at.get(UNNAMED)))
    placed_queues = kinds.join(F.broadcast(numbers), "queue", "left").select("queue", place.cast("int").alias("q"))
    # a place in the queue: the parts before, then within the part the sources that share the queue
    by_part = write_table(parts.join(placed_queues, "queue"), "pack-places")
    earlier = Window.partitionBy("q").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("q", "part").orderBy("queue").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.groupBy("q", "part").agg(F.sum("n").alias("n")).select("q", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    bases = by_part.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, ["q", "part"]).select(
        "queue", "part", "q", (F.col("start") + F.col("inside")).alias("base"))
    if by_part.count() <= broadcast_rows:
        bases = F.broadcast(bases)
    placed = tokens.join(bases, ["queue", "part"]).select(
        "doc_id", "queue", "q", (F.col("base") + F.col("start_in_part")).alias("first"), "n", "ids")
    schema = StructType([docs.schema["doc_id"], StructField("queue", StringType()), *(
        StructField(c, LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")),
        StructField("ids", BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                some, at, rows = b.slice(lo, 500), [], []
                for i, (q, first, n, ids) in enumerate(zip(*(c.to_pylist() for c in some.columns[2:]))):
                    wide = memoryview(np.frombuffer(ids, np.uint16 if len(ids) == 2 * n else np.uint32).astype("<u4").tobytes())
                    for s, k, w, o in plan.pieces(q, first, n):
                        at.append(i)
                        rows.append((s, k, n, w, o, bytes(wide[4 * s:4 * (s + k)])))
                *numbers, ids = zip(*rows)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in some.columns[:2]), *(pa.array(x, pa.int64()) for x in numbers), pa.array(ids, pa.binary())], schema.names)

    return placed.mapInArrow(cut, schema)
