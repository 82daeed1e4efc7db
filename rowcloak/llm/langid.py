"""Language identification by string kernels.

A text's features are the n-grams of one to four characters that it has, lower-cased, anything but
letters being space (presence, blended spectrum). The kernel of two texts is the number of n-grams
they share over the root of the product of their numbers. A Nystroem map over landmark texts turns
it into vectors, on which one ridge regression a language is fitted (one against the rest). Texts
are scored in batches: presence matrix times landmarks, then times the regressions' weights.

A text with all n-grams is as near to every language, so presence says nothing on very long texts. They
are cut into segments of about SEGMENT characters, each is scored by itself, and the text's decision
values are the means of its segments', each weighing as much as it has characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from .common import crc_fold, map_beside

DIM, BATCH, SEGMENT = 1 << 15, 64, 8_192
SAMPLE, LANGUAGES = 25_600, 4_000  # rows that are learned from at most, and languages
UNKNOWN = "und"


def letters() -> np.ndarray:
    """Is each code point a letter?"""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


_LETTER: list[np.ndarray] = []


def normalised(text: str) -> np.ndarray:
    """The code points of the lower-cased text, one space for each run of other characters than letters and at the ends."""
    if not _LETTER:
        _LETTER.append(letters())
    low, parts, before, step = text.lower(), [np.array([32], np.uint32)], False, 1 << 20
    for lo in range(0, len(low), step):
        code = np.frombuffer(low[lo:lo + step].encode("utf-32-le", "surrogatepass"), np.uint32)
        alpha = _LETTER[0][code]
        keep = alpha | np.concatenate([[before], alpha[:-1]])
        before = bool(alpha[-1])
        parts.append(np.where(alpha, code, np.uint32(32))[keep])
    if before:
        parts.append(parts[0])
    code = np.concatenate(parts)
    return code[1:] if len(code) > 1 and code[1] == 32 else code


def segments(text: str, longest: int = 4) -> list[np.ndarray]:
    """The normalised text in parts of about SEGMENT code points, none for a text without letters.

    Parts overlap by what an n-gram needs, so each n-gram is in one.
    """
    code = normalised(text)
    if len(code) < 2:
        return []
    many = max(1, round(len(code) / SEGMENT))
    cuts = np.linspace(0, len(code), many + 1).astype(int)
    return [code[a:z + longest - 1] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]


def presence(code: np.ndarray, longest: int = 4) -> np.ndarray:
    """Which of DIM hashed n-grams a segment has."""
    out, some = np.zeros(DIM, np.uint8), code.astype(np.uint64)
    h = np.zeros(len(some), np.uint64)
    for n in range(1, min(longest, len(some)) + 1):
        h = h[:len(some) - n + 1] * np.uint64(0x100000001B3) + some[n - 1:] + np.uint64(n)
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        out[mixed >> np.uint64(49)] = 1
    return out


class KernelModel:
    """Landmarks and weights of the one-against-the-rest kernel ridge regressions."""

    def __init__(self, marks: np.ndarray, langs: list[str], weights: np.ndarray):
        self.langs, self.marks, self.weights = langs, np.packbits(marks, axis=1), weights
        self._wide: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"_wide": None}

    @staticmethod
    def kernel(x: np.ndarray, marks: np.ndarray) -> np.ndarray:
        k = x @ marks.T
        return k / np.sqrt(np.maximum(x.sum(1), 1)[:, None] * np.maximum(marks.sum(1), 1)[None, :])

    @classmethod
    def fit(cls, features: np.ndarray, labels: list[str], landmarks: int = 192, ridge: float = 1e-3) -> KernelModel:
        langs = sorted(set(labels))
        y = np.array([langs.index(c) for c in labels])
        rank = np.zeros(len(y), np.int64)  # the k-th of its language, so that each has landmarks
        for k in range(len(langs)):
            rank[y == k] = np.arange((y == k).sum())
        chosen = np.lexsort((y, rank))[:landmarks]
        marks = features[chosen].astype(np.float32)
        kmm = cls.kernel(marks, marks).astype(float)  # rows are taken by blocks: as floats all features would be four times as large
        knm = np.concatenate([cls.kernel(features[lo:lo + BATCH].astype(np.float32), marks).astype(float) for lo in range(0, len(features), BATCH)])
        values, vectors = np.linalg.eigh(kmm)
        root = vectors * np.where(values > 1e-6, 1 / np.sqrt(np.maximum(values, 1e-6)), 0)  # K_mm^(-1/2), rotated
        phi = np.column_stack([knm @ root, np.ones(len(features))])
        target = np.where(y[:, None] == np.arange(len(langs)), 1.0, -1.0)
        share = 1 / np.bincount(y, minlength=len(langs))[y]  # each language weighs the same
        beta = np.linalg.solve((phi * share[:, None]).T @ phi + ridge * np.eye(phi.shape[1]), (phi * share[:, None]).T @ target)
        return cls(marks.astype(np.uint8), langs, np.vstack([root @ beta[:-1], beta[-1:]]))

    def decide(self, x: np.ndarray) -> np.ndarray:
        """The decision values of each row of features, one for each language."""
        if self._wide is None:
            self._wide = np.unpackbits(self.marks, axis=1, count=DIM).astype(np.float32)
        return self.kernel(x.astype(np.float32), self._wide) @ self.weights[:-1] + self.weights[-1]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Each text's language and its share of exp(4 f) over the languages' f; without letters, UNKNOWN and 0."""
        total, weight = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        held: list[tuple[int, np.ndarray]] = []

        def settle() -> None:
            at = np.array([i for i, _ in held])
            size = np.array([len(code) for _, code in held], float)
            np.add.at(total, at, self.decide(np.stack([presence(code) for _, code in held])) * size[:, None])
            np.add.at(weight, at, size)
            held.clear()

        for i, text in enumerate(texts):
            for code in segments(text or ""):
                held.append((i, code))
                if len(held) == BATCH:
                    settle()
        if held:
            settle()
        f = total / np.maximum(weight, 1)[:, None]
        e = np.exp(4 * (f - f.max(1, keepdims=True)))
        best, known = f.argmax(1), weight > 0
        score = np.where(known, e[np.arange(len(f)), best] / e.sum(1), 0.0)
        return [self.langs[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)], score


def fit_language_model(docs: DataFrame, train, per_language: int = 400, sample: int = SAMPLE, landmarks: int = 192) -> KernelModel | None:
    """Fit on ``per_language`` rows of each language, on fewer where all together would pass ``sample``.

    ``train`` is a condition on the rows that may be learned from. All languages are learned, each
    from one row at least and with three landmarks where ``landmarks`` are too few for that; above
    LANGUAGES of them, which one kernel matrix can't hold, this raises an error. The rows of a
    language are those with the smallest hash of doc_id and text, so the choice doesn't depend on
    the partitioning; of a long text one segment is learned from, which the hash picks. The features of the chosen rows (4 KB each, 100 MB for the whole sample) are
    all that reaches the driver. None without any.
    """
    rows = docs.where(train).where("lang is not null and text is not null").select(
        F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("h"))
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"lang has more than {LANGUAGES} values")
    if not sizes:
        return None
    per_language = max(1, min(per_language, sample // len(sizes)))
    landmarks = max(landmarks, min(3, per_language) * len(sizes))
    common = docs.sparkSession.createDataFrame([tuple(r) for r in sizes], "lang string, count long")
    # of a common language only hashes that can be among the smallest are sorted, four times what is taken
    k = F.pmod("h", F.lit(1 << 40))
    near = rows.join(F.broadcast(common), "lang").withColumn("k", k).where(F.col("k") < F.lit(4.0 * per_language * (1 << 40)) / F.col("count"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("k", "h"))
    chosen = near.withColumn("n", place).where(F.col("n") <= per_language).select("lang", "h")
    ids = chosen.dropDuplicates(["h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [segments(t) for t in b.column(1).to_pylist()]
            bits = [np.packbits(presence(s[h % len(s)])).tobytes() if s else None for s, h in zip(parts, b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(bits, pa.binary())], ["lang", "h", "x"])

    texts = (docs.where(train).withColumn("h", F.xxhash64("doc_id", "text")).select("h", "text")
             .join(F.broadcast(ids), "h").select("lang", "text", "h"))
    got = texts.mapInArrow(run, "lang string, h long, x binary").where("x is not null").dropDuplicates(["h"]).orderBy("h").collect()
    if not got:
        return None
    packed = np.frombuffer(b"".join(r["x"] for r in got), np.uint8).reshape(len(got), -1)
    features = np.unpackbits(packed, axis=1, count=DIM)
    return KernelModel.fit(features, [r["lang"] for r in got], landmarks)


def predict_language(docs: DataFrame, model: KernelModel | None, text: str = "text", pred: str = "_lang_pred", score: str = "_score") -> DataFrame:
    """``docs`` with the language of the whole text and a score from 0 to 1.

    The score is near the reciprocal of the number of languages where a text's segments speak for
    none of them, or for several alike.

    A text that is null, empty or without a letter gets `und` and score 0, as does every text when
    there was nothing to learn from. Columns named like the new ones are replaced, others pass
    unchanged; repeated rows get the same answer; an empty table gives no rows.
    """
    kept = [c for c in docs.columns if c not in (pred, score)]
    new = [StructField(pred, StringType()), StructField(score, DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, BATCH):
                cut = b.slice(lo, BATCH)
                texts = cut.column(1).to_pylist()
                lang, points = model.predict(texts) if model else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.array(lang, pa.string()), pa.array(points)], ["_row", pred, score])

    return map_beside(docs, kept, [F.col(text).cast("string")], run, new)


def train_fold(n: int = 4, held: int = 2):
    """The rows that may be learned from: crc32 of doc_id as text modulo n is not ``held``."""
    return crc_fold(F.col("doc_id"), n) != held
