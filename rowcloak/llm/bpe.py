"""BPE encoding and decoding with a pair occurrence index.

A task gathers the distinct pre-tokens of its texts into one symbol sequence and maps each adjacent
pair of symbols that has a rank to all its positions. The active ranks are applied in ascending
order, each to all its positions at once; a merge removes the pairs it consumes from the sequence
and adds the pairs it makes with its neighbours to their ranks' lists. Texts are then looked up.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StringType

from .common import map_beside, text_of

#: Fixed value: the pre-token pattern of byte-level BPE files, white space spelt as a property.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
           r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
GROUP_BYTES, CACHE_WORDS = 12 << 20, 150_000


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Numbers(dict):
    """Numbers its keys as they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class PairIndexBpe:
    """A byte-level BPE vocabulary file and the pair occurrence index over batches of pre-tokens."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, chars = spec["model"]["vocab"], byte_chars()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.width = max(max(vocab.values()), *(t["id"] for t in spec["added_tokens"])) + 1 if spec["added_tokens"] else max(vocab.values()) + 1
        self.base = np.array([vocab[chars[b]] for b in range(256)], np.int64)
        key = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        self.left, self.right = key // self.width, key % self.width
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.order = np.argsort(key)
        self.keys = key[self.order]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.find = regex.compile(PATTERN).findall
        back = {c: b for b, c in chars.items()}
        self.bytes = {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in vocab.items()}
        self.bytes |= {i: t.encode() for t, i in self.added.items()}
        self.known, self.coded = Numbers(), []  # pre-tokens by number of first use, their ids

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 if it has none."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each pre-token as bytes of little-endian 32-bit numbers."""
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        symbol = self.base[np.frombuffer(b"".join(raw), np.uint8)]
        n = len(symbol)
        ends = np.cumsum(lengths)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[ends - 1], prv[ends - lengths] = -1, -1
        alive = np.ones(n, bool)
        lists: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray) -> None:
            rank = self.ranks(symbol[at], symbol[nxt[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            o = np.argsort(rank, kind="stable")
            at, rank = at[o], rank[o]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, some in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts) if len(cuts) else [at]):
                if r not in lists:
                    lists[r] = []
                    heapq.heappush(heap, r)
                lists[r].append(some)

        note(np.flatnonzero(nxt >= 0))
        while heap:
            r = heapq.heappop(heap)
            found = lists.pop(r)
            at = found[0] if len(found) == 1 else np.concatenate(found)
            a, b = self.left[r], self.right[r]
            at = at[alive[at] & (symbol[at] == a) & (nxt[at] >= 0)]
            at = at[symbol[nxt[at]] == b]
            if a == b and len(at) > 1:  # of overlapping occurrences every second one, from the left
                at = np.unique(at)
                start = np.ones(len(at), bool)
                start[1:] = nxt[at[:-1]] != at[1:]
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(start, place, 0))) % 2 == 0]
            if not len(at):
                continue
            gone = nxt[at]
            after = nxt[gone]
            symbol[at], alive[gone], nxt[at] = self.made[r], False, after
            more = after >= 0
            prv[after[more]] = at[more]
            before = prv[at]
            note(np.unique(np.concatenate([at[more], before[before >= 0]])))
        kept = symbol[alive].astype("<i4").tobytes()
        count = np.add.reduceat(alive, ends - lengths) if n else np.zeros(0, np.int64)
        stop = (np.cumsum(count) * 4).tolist()
        return [kept[a:b] for a, b in zip([0, *stop], stop)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes of little-endian 32-bit numbers."""
        if len(self.known) > CACHE_WORDS:
            self.known, self.coded = Numbers(), []
        at, first = self.known.__getitem__, len(self.coded)
        used = []
        for t in texts:
            parts = self.split.split(t) if self.split else [t]
            words = self.find(t) if len(parts) == 1 else [w for p in parts for w in ([p] if p in self.added else self.find(p))]
            used.append(np.fromiter(map(at, words), np.int32, len(words)))
        new = list(islice(self.known, first, None))
        plain = [w for w in new if w not in self.added]
        ids = dict(zip(plain, self.encode_words(plain))) if plain else {}
        self.coded += [ids[w] if w in ids else np.array([self.added[w]], "<i4").tobytes() for w in new]
        get = self.coded.__getitem__
        return [b"".join(map(get, u.tolist())) for u in used]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


_MODELS: dict[str, PairIndexBpe] = {}


def model(path: str) -> PairIndexBpe:
    if path not in _MODELS:
        _MODELS[path] = PairIndexBpe(path)
    return _MODELS[path]


def _groups(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for i, n in enumerate(pa.compute.binary_length(column).to_pylist()):
        if size and size + n > most:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(column):
        yield lo, len(column)


def bpe_encode(docs: DataFrame, vocab_path: str, text: str = "text", out: str = "_ids", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (else all) of ``docs`` with the ids of the whole text as an array column.

    A null text is empty and has no ids; added tokens in a text become their own id; other columns
    pass unchanged, a column named like ``out`` is replaced; an empty table gives no rows.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(vocab_path)
        for batch in batches:
            column = batch.column(1)
            for lo, hi in _groups(column, GROUP_BYTES):
                ids = bpe.encode(column.slice(lo, hi - lo).to_pylist())
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(ends, flat)], ["_row", out])

    return map_beside(docs, kept, [text_of(text)], run, [StructField(out, ArrayType(IntegerType()))])


def bpe_decode(df: DataFrame, vocab_path: str, ids: str = "_ids", out: str = "_decoded") -> DataFrame:
    """``df`` with the text of an ids column; null or empty ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(vocab_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                cut = batch.slice(lo, 512)
                texts = [bpe.decode(x.values.to_numpy()) if x.is_valid else "" for x in cut.column(1)]
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.array(texts, pa.string())], ["_row", out])

    return map_beside(df, [c for c in df.columns if c != out], [F.col(ids)], run, [StructField(out, StringType())])
