"""Quality rules: an isolation forest over the statistics that rules look at.

The statistics of a text are counted from its bytes for many texts at once: words are cut and numbered
by hashing, so nothing is made for a word but its place in an array. Their shares are what the forest
sees; length is not among them, since a long text is no bad one.

Of each share only what lies beyond its usual range counts, the range in which all but a thousandth of
the good labelled rows are, on either side: so what is usual is alike, however it varies.

An isolation tree splits a small sample at random places of random statistics until each row is alone;
what few splits isolate is unlike the rest. A text's score is 2^(-mean path length / c(sample)), and the
threshold comes from labelled rows: of all thresholds that keep at least a stated share of the good
ones, the one that tells good from bad best, in the middle of the gap there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField

from .common import map_beside, text_of
from .words import WHITE, byte_class, bytes_of, codes_of, counted, cut, passes, word_starts

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_marks", "n_plain_words"]
FEATURES = ["symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "odd_word_share", "word_length"]
TREES, SAMPLE, LABELLED, KEEP, USUAL = 200, 64, 20_000, 0.99, 0.999
MIN_WORDS, MAX_REPEAT = 50, 0.5
_SYMBOL = np.isin(np.arange(256), [*b"#*$%&|<>"])
_MARK = byte_class((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
_DIGIT, _UPPER = byte_class((0x30, 0x39)), byte_class((0x41, 0x5A))
_LETTER = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_INNER = byte_class((0x80, 0xBF))  # bytes of a character behind its first


def _within(flags: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """How many flags each text has."""
    return np.diff(np.searchsorted(np.flatnonzero(flags), begins))


def _paired(keys: np.ndarray, more: np.ndarray, many: int) -> tuple[np.ndarray, int]:
    """Numbers of the pairs of two numbers, the second below ``many``, and how many there are."""
    codes, values = codes_of(pa.array(keys * max(many, 1) + more))
    return codes, len(values)


def count_rules(texts: pa.Array) -> np.ndarray:
    """COUNTS of each text (binaries without nulls, a bounded number of bytes at a time), a row for each text."""
    data, begins = bytes_of(texts)
    n = len(texts)
    full = ~WHITE[data]
    first = word_starts(full, begins)
    starts = np.flatnonzero(first)
    n_words = np.diff(np.searchsorted(starts, begins))
    doc = np.repeat(np.arange(n), n_words)
    codes, words = codes_of(cut(data, full, first))
    # three-word windows within a text: numbers of (text, word), then with the next word, then with the one after
    repeat = np.zeros(n, np.int64)
    if len(codes) > 2:
        inside = doc[:-2] == doc[2:]
        key, _ = _paired(doc[:-2][inside], codes[:-2][inside], len(words))
        key, _ = _paired(key, codes[1:-1][inside], len(words))
        key, many = _paired(key, codes[2:][inside], len(words))
        again = np.flatnonzero(inside)[np.bincount(key, minlength=many)[key] > 1]
        covered = np.zeros(len(codes), bool)
        for k in range(3):
            covered[again + k] = True
        repeat = np.bincount(doc[covered], minlength=n)
    # lines: a text's last one has no line feed
    feed = data == 0x0A
    at = np.flatnonzero(feed)
    line_doc = np.searchsorted(begins, at, "right") - 1
    bounds = np.sort(np.concatenate([at + 1, begins[1:]]), kind="stable")
    owner = np.sort(np.concatenate([line_doc, np.arange(n)]), kind="stable")
    heads = np.append(0, bounds[:-1])
    has_word = np.diff(np.searchsorted(starts, np.append(0, bounds))) > 0
    feeds = np.append(0, np.cumsum(feed))
    shift = feeds[heads]  # line feeds before the line
    lines = pa.Array.from_buffers(pa.binary(), len(bounds), [None, pa.py_buffer(np.append(heads - shift, len(data) - len(at)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[~feed]))])
    line_codes, distinct = codes_of(lines)
    key, _ = counted(owner[has_word] * max(len(distinct), 1) + line_codes[has_word])
    worded = np.bincount(owner[has_word], minlength=n)
    dup = worded - np.bincount(key // max(len(distinct), 1), minlength=n)
    # from one word's start to the next one's there are no letters but that word's
    plain = np.add.reduceat(_LETTER[data], starts, dtype=np.int64) > 0 if len(starts) else np.zeros(0, bool)
    chars = full & ~_INNER[data]
    return np.stack([n_words, _within(chars, begins), _within(_SYMBOL[data], begins), dup, repeat, worded, _within(_UPPER[data], begins),
                     _within(_LETTER[data] & chars, begins), _within(_DIGIT[data], begins), _within(_MARK[data], begins),
                     np.bincount(doc[plain], minlength=n)], 1).astype(np.int64)


def features(counts: np.ndarray) -> np.ndarray:
    """FEATURES from COUNTS, each between 0 and 1 but for the mean word length."""
    c = dict(zip(COUNTS, counts.T.astype(float), strict=True))
    of = lambda a, b: a / np.maximum(b, 1)
    return np.stack([np.minimum(of(c["n_symbols"], c["word_chars"]), 1), of(c["n_dup_lines"], c["n_lines"]), of(c["n_repeat_words"], c["n_words"]),
                     of(c["n_upper"], c["n_letters"]), of(c["n_digits"], c["word_chars"]), of(c["n_marks"], c["word_chars"]),
                     of(c["n_words"] - c["n_plain_words"], c["n_words"]), np.minimum(of(c["word_chars"], c["n_words"]), 20)], 1)


def base_failed(counts: np.ndarray) -> np.ndarray:
    """Too few words, or too many of them in windows that repeat."""
    n, repeat = counts[:, COUNTS.index("n_words")], counts[:, COUNTS.index("n_repeat_words")]
    return (n < MIN_WORDS) | (100 * repeat > round(100 * MAX_REPEAT) * n)


def usual_depth(n: np.ndarray | int) -> np.ndarray:
    """c(n): the mean path length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), (n == 2).astype(float))


@dataclass
class RuleForest:
    """Trees as arrays (statistic, split, first child of two; a leaf has no statistic), the usual ranges, the threshold."""

    low: np.ndarray
    high: np.ndarray
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    sample: int
    threshold: float = 1.0

    def beyond(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x - self.high, 0) + np.maximum(self.low - x, 0)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2^(-mean path length / c(sample)) of rows of FEATURES."""
        x, total = self.beyond(x), np.zeros(len(x))
        for feature, split, child, length in self.trees:
            node = np.zeros(len(x), np.int64)
            while True:
                inner = np.flatnonzero(feature[node] >= 0)
                if not len(inner):
                    break
                at = node[inner]
                node[inner] = child[at] + (x[inner, feature[at]] >= split[at])
            total += length[node]
        return np.exp2(-total / max(len(self.trees), 1) / max(float(usual_depth(self.sample)), 1e-9))


def grow(rows: np.ndarray, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An isolation tree of the rows, as deep as the logarithm of their number."""
    limit, nodes, todo = int(np.ceil(np.log2(max(len(rows), 2)))), [[-1, 0.0, 0, 0.0]], [(0, rows, 0)]
    while todo:
        at, mine, depth = todo.pop()
        low, high = mine.min(0), mine.max(0)
        varied = np.flatnonzero(high > low)
        if len(mine) < 2 or depth >= limit or not len(varied):
            nodes[at][3] = depth + float(usual_depth(len(mine)))
            continue
        f = int(random.choice(varied))
        cut_at = random.uniform(low[f], high[f])
        cut_at = cut_at if cut_at > low[f] else high[f]  # so that either side has a row
        right = mine[:, f] >= cut_at
        nodes[at][:3] = [f, cut_at, len(nodes)]
        todo += [(len(nodes), mine[~right], depth + 1), (len(nodes) + 1, mine[right], depth + 1)]
        nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
    f, s, c, p = zip(*nodes, strict=True)
    return np.array(f), np.array(s), np.array(c), np.array(p)


def calibrated(good: np.ndarray, bad: np.ndarray, keep: float) -> float:
    """The score above which rows go: at least ``keep`` of the good ones stay, and it tells the two best."""
    if not len(good):
        return 1.0
    every = np.unique(np.concatenate([good, bad]))
    cuts = np.append((every[:-1] + every[1:]) / 2, 1.0)
    stay = np.searchsorted(np.sort(good), cuts, "right") / len(good)
    gone = 1 - np.searchsorted(np.sort(bad), cuts, "right") / max(len(bad), 1) if len(bad) else np.zeros(len(cuts))
    worth = np.where(stay >= keep, stay + gone, -1.0)
    best = np.flatnonzero(worth >= worth.max() - 1e-12)
    return float(cuts[best[np.argmax(np.diff(every, append=1.0)[best])]])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Beside the kept columns, COUNTS."""
    for batch in batches:
        for lo, hi in passes(batch.column(1)):
            counts = count_rules(batch.column(1).slice(lo, hi - lo))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(c) for c in counts.T)], ["_row", *COUNTS])


def _judge(batches: Iterator[pa.RecordBatch], forest: RuleForest | None, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Beside the kept columns, COUNTS, whether the base rules fail, the forest's score and the verdict."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(1)
        counts = np.concatenate([count_rules(texts.slice(lo, hi - lo)) for lo, hi in passes(texts)])
        failed = base_failed(counts)
        score = forest.score(features(counts)) if forest else np.zeros(len(counts))
        kept = ~failed & (score <= (forest.threshold if forest else 1.0))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in counts.T), pa.array(failed), pa.array(score), pa.array(kept)], ["_row", *names])


def labelled_counts(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """(_good, *COUNTS) of ``most`` documents with a label at most, those of the smallest hashes of doc_id."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    few = labels.where("doc_id is not null and quality is not null").select("doc_id", (F.col("quality") > 0).alias("_good")).orderBy(*order).limit(most)
    own = docs.select("doc_id", text_of().cast("binary").alias("_text")).join(F.broadcast(few), "doc_id")
    found = map_beside(own, ["doc_id", "_good"], [F.col("_text")], _counts, [StructField(c, LongType()) for c in COUNTS])
    return found.orderBy(*order, "_good", *COUNTS).limit(most).select("_good", *COUNTS)


def fit_rule_forest(docs: DataFrame, labels: DataFrame, trees: int = TREES, sample: int = SAMPLE, most: int = LABELLED, keep: float = KEEP, usual: float = USUAL, seed: int = 42) -> RuleForest | None:
    """A forest and its threshold from documents (doc_id, text) and labels (doc_id, quality; more than 0 is good).

    ``most`` bounds the labelled rows that are looked at. Rows that fail the base rules aren't learned
    from. Null ids and qualities are left out, other columns aside. Without two rows of which one is
    good there is no forest (None).
    """
    rows = labelled_counts(docs, labels, most).toPandas()
    good, counts = rows["_good"].to_numpy(bool), rows[COUNTS].to_numpy(np.int64)
    left = ~base_failed(counts)
    good, x = good[left], features(counts[left])
    if len(x) < 2 or not good.any():
        return None
    low, high = np.quantile(x[good], 1 - usual, axis=0), np.quantile(x[good], usual, axis=0)
    forest, random = RuleForest(low, high, [], min(sample, len(x))), np.random.default_rng(seed)
    beyond = forest.beyond(x)
    forest.trees = [grow(beyond[random.choice(len(x), forest.sample, replace=False)], random) for _ in range(trees)]
    score = forest.score(x)
    forest.threshold = calibrated(score[good], score[~good], keep)
    return forest


def judge_rules(docs: DataFrame, forest: RuleForest | None) -> DataFrame:
    """All columns of ``docs`` plus ``_``-prefixed COUNTS, ``_base_failed``, ``_score`` and ``_kept``.

    Words are runs of bytes other than ASCII white space, characters are code points. n_dup_lines counts
    lines with a word that equal an earlier one of the text, n_repeat_words the words in three-word windows
    that the text has twice or more, n_lines the lines with a word, n_plain_words the words with a letter.
    ``_kept`` is false where the base rules fail (fewer than 50 words, over half of them in windows that
    repeat) or the forest's score is above its threshold; without a forest the base rules alone decide,
    with a score of 0. Null and empty texts have no words and fail. Equal texts have equal results, however
    often; an empty table gives no rows. Columns named like the new ones are replaced, others pass unchanged.
    """
    fields = [*(StructField(f"_{c}", LongType()) for c in COUNTS), StructField("_base_failed", BooleanType()), StructField("_score", DoubleType()), StructField("_kept", BooleanType())]
    names = [f.name for f in fields]
    return map_beside(docs, [c for c in docs.columns if c not in names], [text_of().cast("binary")], partial(_judge, forest=forest, names=names), fields)
