"""Exact deduplication through a log-structured merge index of digests (DataFrame functions only).

A batch's entries (digest, doc_id, copies) go to MEMTABLES memtables by their input task; each is
flushed as one run, sorted by digest, with a filter (a bitmap over the digests) beside it. Compaction
merges the runs of a level: entries that no other run's filter knows pass as they are, only the
others meet in a shuffle, where the smallest identifier stays and copies add up. A batch becomes one
run of level 1; ``fanout`` runs of a level become one of the next. Rows whose digest has copies are
hits: their normalised texts are compared with the text of the row that stays, byte by byte; a row
that differs (a digest collision) is regrouped by text. Rows that the filters of earlier batches
let pass are looked up in those runs, and what is found is verified against the texts kept there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BITMAP_BITS, KeyFilter, filter_bits, packed, salts_for, scratch_path, skew_join, text_of, write_table

SPACE = "[\\x20\\x09-\\x0D]+"
MEMTABLES, FANOUT, HOT = 4, 8, 500
NEW = ["_keep_id", "_group_size", "_kept", "_text_sha256"]


def normalised(col: Column) -> Column:
    return F.regexp_replace(col, SPACE, " ")


class Run:
    """A sorted run of entries, one for each digest, and its filter."""

    def __init__(self, spark: SparkSession, path: str, filter_path: str, bits: int):
        self.spark, self.path, self.filter_path, self.bits = spark, path, filter_path, bits

    def entries(self) -> DataFrame:
        return self.spark.read.parquet(self.path).select("digest", "doc_id", "copies")

    def bitmaps(self) -> DataFrame:
        return self.spark.read.parquet(self.filter_path).select("_bucket", "_bitmap")

    def mark(self, df: DataFrame, digest: str, flag: str) -> DataFrame:
        """``df`` with a boolean column: may the digest be in this run?"""
        return KeyFilter(df, F.xxhash64(digest), self.bits, self.bitmaps()).mark(df, F.xxhash64(digest), flag)


class DigestIndex:
    """Levels of sorted digest runs below one shared folder, and the texts that hits are verified against.

    ``texts``: keep each distinct text once, so that later batches can be verified; without, the
    index serves one batch.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT, texts: bool = True, memtables: int = MEMTABLES):
        self.spark, self.path, self.fanout, self.keeps, self.memtables = spark, path or scratch_path(spark, "lsm"), fanout, texts, memtables
        self.levels: list[list[Run]] = [[], []]
        self.written = 0
        self.texts: list[str] = []

    def _write(self, entries: DataFrame, level: int, names: list[int] | None = None) -> None:
        """Write one run, or one for each value of the column ``run``, with filters."""
        while len(self.levels) <= level:
            self.levels.append([])
        out = f"{self.path}/level={level}/{self.written}"
        self.written += 1
        parts = ["run"] if names else []
        (entries.select(*parts, "digest", "doc_id", "copies").sortWithinPartitions(*parts, "digest")
         .write.option("compression", "zstd").partitionBy(*parts).parquet(f"{out}/entries"))
        back = self.spark.read.schema(entries.select(*parts, "digest", "doc_id", "copies").schema).parquet(f"{out}/entries")
        bits = filter_bits(back.count())
        slot = F.pmod(F.xxhash64("digest"), F.lit(bits)).cast("long")
        (back.select(*parts, slot.alias("_slot")).groupBy(*parts, F.floor(F.col("_slot") / BITMAP_BITS).alias("_bucket"))
         .agg(F.bitmap_construct_agg(F.pmod(F.col("_slot"), F.lit(BITMAP_BITS))).alias("_bitmap"))
         .write.partitionBy(*parts).parquet(f"{out}/filters"))
        if names:
            there = {r["run"] for r in back.select("run").distinct().collect()}
            self.levels[level] += [Run(self.spark, f"{out}/entries/run={k}", f"{out}/filters/run={k}", bits) for k in names if k in there]
        else:
            self.levels[level].append(Run(self.spark, f"{out}/entries", f"{out}/filters", bits))

    def flush(self, entries: DataFrame) -> Run | None:
        """Flush (digest, doc_id, copies) entries as memtables, merge them to one run; the run (None for no entries)."""
        memtable = F.pmod(F.spark_partition_id(), F.lit(self.memtables)).alias("run")
        runs = entries.select(memtable, "digest", "doc_id", "copies").groupBy("run", "digest").agg(
            F.min("doc_id").alias("doc_id"), F.sum("copies").alias("copies"))
        self._write(runs, 0, list(range(self.memtables)))
        if not self.levels[0]:
            return None
        self.compact(0)
        batch = self.levels[1][-1]
        level = 1
        while len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1
        return batch

    def compact(self, level: int) -> None:
        """Merge a level's runs into one run of the next level, smallest identifier first."""
        runs = self.levels[level]
        if not runs:
            return
        parts = []
        for run in runs:
            part, flags = run.entries(), []
            for i, other in enumerate(r for r in runs if r is not run):
                part, flags = other.mark(part, "digest", f"_in{i}"), [*flags, F.col(f"_in{i}")]
            parts.append(part.select("digest", "doc_id", "copies", reduce(lambda a, b: a | b, flags, F.lit(False)).alias("_meets")))
        every = reduce(DataFrame.unionByName, parts)
        met = every.where("_meets").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.sum("copies").alias("copies"))
        self._write(every.where("not _meets").drop("_meets").unionByName(met), level + 1)
        self.levels[level] = []

    def runs(self) -> list[Run]:
        return [r for level in self.levels for r in level]

    def entries(self) -> DataFrame | None:
        """One row for each digest, whatever was compacted so far (None for an empty index)."""
        if not self.runs():
            return None
        every = reduce(DataFrame.unionByName, (r.entries() for r in self.runs()))
        return every.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.sum("copies").alias("copies"))

    def keep_texts(self, texts: DataFrame) -> None:
        """Keep a batch's (digest, norm, doc_id, copies), a row for each distinct text."""
        out = f"{self.path}/texts/{len(self.texts)}"
        texts.select("digest", "norm", "doc_id", "copies").sortWithinPartitions("digest").write.option("compression", "zstd").parquet(out)
        self.texts.append(out)

    def find(self, runs: list[Run], digests: DataFrame) -> DataFrame:
        """Those distinct ``digest`` values that the runs have: probed through the filters, then looked up."""
        found = []
        for run in runs:
            may = run.mark(digests, "digest", "_may").where("_may").select("digest")
            found.append(run.entries().select("digest").join(may, "digest", "left_semi"))
        return reduce(DataFrame.unionByName, found).distinct()


def exact_dedup(docs: DataFrame, digest=None, index: DigestIndex | None = None) -> DataFrame:
    """All columns of ``docs`` plus ``_keep_id``, ``_group_size``, ``_kept``, ``_text_sha256``.

    Texts are equal when identical after each run of ASCII white space becomes one space; a null
    text counts as empty. Of equal texts the smallest doc_id stays; rows that repeat one doc_id
    with equal text are one document, so each of them carries ``_kept`` as true. A null doc_id
    never stays in a group that has an id; a group of null ids only has ``_keep_id`` null and all
    rows kept. An empty table gives no rows; columns named like the new ones are replaced. ``digest``
    maps the normalised text to a binary digest (SHA-256); a weaker one only costs more verification.

    With an ``index`` the batches given to it before count as rows too: identifiers, sizes and
    what stays are those of all batches up to this one (an answer given for an earlier batch isn't
    changed by a smaller identifier that comes later).
    """
    digest = digest or (lambda text: F.unhex(F.sha2(text, 256)))
    index = index or DigestIndex(docs.sparkSession, texts=False)
    earlier, old_texts = index.runs(), list(index.texts)
    base = packed(docs, NEW).withColumn("_norm", normalised(text_of())).withColumn("_digest", digest(F.col("_norm")))
    run = index.flush(base.select(F.col("_digest").alias("digest"), "doc_id", F.lit(1).cast("long").alias("copies")))
    sha = F.lower(F.sha2(F.col("_norm"), 256))
    if run is None:
        none = base.select("*", F.col("doc_id").alias("_keep_id"), F.lit(1).cast("long").alias("_group_size"), F.lit(True).alias("_kept"), sha.alias("_text_sha256"))
        return none.select("_row.*", *NEW)
    now = _in_batch(base, run.entries().where("copies > 1"), sha)
    if index.keeps:
        now = write_table(now, "lsm-batch")
        first = now.groupBy("_digest", "_norm").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
        index.keep_texts(first.select(F.col("_digest").alias("digest"), F.col("_norm").alias("norm"), "doc_id", "copies"))
        if earlier and old_texts:
            now = _with_earlier(now, index, earlier, docs.sparkSession.read.parquet(*old_texts))
    return now.select("_row.*", *NEW)


def _in_batch(base: DataFrame, hits: DataFrame, sha: Column) -> DataFrame:
    """(_row, doc_id, _norm, _digest and the new columns) by the copies inside the batch."""
    out = ["_row", "doc_id", "_norm", "_digest", *NEW]
    facts = hits.agg(F.count("*"), F.max("copies")).first()
    salts = salts_for(facts[1], HOT)
    marked = KeyFilter(hits, F.xxhash64("digest"), filter_bits(facts[0])).mark(base, F.xxhash64("_digest"), "_hit")
    single = lambda df: df.withColumns({"_keep_id": F.col("doc_id"), "_group_size": F.lit(1).cast("long"), "_kept": F.lit(True), "_text_sha256": sha}).select(*out)
    alone = single(marked.where("not _hit"))

    known = hits.select(F.col("digest").alias("_digest"), F.col("doc_id").alias("_keep_id"), F.col("copies").alias("_group_size"))
    hot = known.where(F.col("_group_size") > HOT)
    tagged = marked.where("_hit").drop("_hit").withColumn("_task", F.monotonically_increasing_id())
    hit = write_table(skew_join(tagged, known, ["_digest"], hot, ["doc_id", "_task"], salts, "left"), "lsm-hits")
    # the text that stays, once a digest; any one of equal-id rows will do
    keeper = hit.where("doc_id <=> _keep_id and _group_size > 1").groupBy("_digest").agg(F.min("_norm").alias("_keep_norm"))
    verified = skew_join(hit, keeper, ["_digest"], hot, ["doc_id", "_task"], salts, "left").withColumn(
        "_same", F.col("_norm").cast("binary") == F.col("_keep_norm").cast("binary"))
    false = single(verified.where("_group_size is null"))  # what the bitmap let pass by chance
    grouped = verified.where("_group_size is not null")
    # the groups without any collision, which with SHA-256 are all
    bad = grouped.where("not coalesce(_same, false)").select("_digest").distinct()
    kept = F.col("doc_id").eqNullSafe(F.col("_keep_id"))
    clean = grouped.join(bad, "_digest", "left_anti").withColumns({"_kept": kept, "_text_sha256": sha}).select(*out)
    mixed = grouped.join(bad, "_digest", "left_semi").drop("_keep_id", "_group_size")
    by_text = mixed.groupBy("_norm").agg(F.min("doc_id").alias("_keep_id"), F.count("*").alias("_group_size"))
    collided = mixed.join(by_text, "_norm").withColumns({"_kept": kept, "_text_sha256": sha}).select(*out)
    return reduce(DataFrame.unionByName, (alone, false, clean, collided))


def _with_earlier(now: DataFrame, index: DigestIndex, earlier: list[Run], texts: DataFrame) -> DataFrame:
    """A batch's rows with the identifiers and copies of earlier batches counted in."""
    own = now.select(F.col("_digest").alias("digest")).distinct()
    found = write_table(index.find(earlier, own), "lsm-found")
    size = filter_bits(found.count())
    old = KeyFilter(found, F.xxhash64("digest"), size).mark(texts, F.xxhash64("digest"), "_may").where("_may")
    old = old.groupBy(F.col("digest").alias("_digest"), F.col("norm").cast("binary").alias("_bytes")).agg(F.min("doc_id").alias("_old_id"), F.sum("copies").alias("_old_n"))
    rows = KeyFilter(found, F.xxhash64("digest"), size).mark(now, F.xxhash64("_digest"), "_may").withColumn("_task", F.monotonically_increasing_id())
    hot = rows.where(F.col("_may") & (F.col("_group_size") > HOT)).select("_digest").distinct()
    salts = salts_for(rows.agg(F.max("_group_size")).first()[0], HOT)
    met = skew_join(rows.where("_may").withColumn("_bytes", F.col("_norm").cast("binary")), old, ["_digest", "_bytes"],
                    rows.where("_may").join(hot, "_digest", "left_semi").select("_digest", F.col("_norm").cast("binary").alias("_bytes")).distinct(), ["doc_id", "_task"], salts, "left")
    keep = F.least("_keep_id", "_old_id")
    met = met.withColumns({"_keep_id": keep, "_group_size": F.col("_group_size") + F.coalesce("_old_n", F.lit(0).cast("long"))}).withColumn("_kept", F.col("doc_id").eqNullSafe(F.col("_keep_id")))
    return rows.where("not _may").select("_row", *NEW).unionByName(met.select("_row", *NEW))
