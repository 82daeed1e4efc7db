"""Line deduplication by a distributed suffix array over line-ID sequences (DataFrame functions only).

The lines of a document that hold anything but white space form a sequence; its suffixes are sorted
by prefix doubling: the rank of a suffix by its first 2h lines is the place of the pair (rank by h
lines at i, rank by h lines at i + h) among all such pairs. A suffix whose rank is its own, or that of
suffixes equal to the end, has its place in the array and takes no further part, so the tables shrink
each round; doubling goes on until all have theirs. The lines that neighbours have in common are
found by the ranks by fewer lines. Each suffix asks for as many lines, k, as have ``min_chars``
characters together; the suffixes with the same k lines are an interval of the array whose longest
common prefix has these lines at least. In each interval the earliest place stays and the others are
later copies, of k lines each; later copies that overlap or touch join to repeated runs, which are
deleted. A run so ends where the last k lines end that repeat: short lines behind it stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import KeyFilter, drop_table, filter_bits, packed, salts_for, skew_join, text_of, write_table

MIN_CHARS, HOT = 40, 2_000
DOC = ["_ord", "_tkey"]
LAST = (1 << 63) - 1
WHITE = "[\\x20\\x09-\\x0D]+"


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the text, and its place among documents: doc_id (null last), then text digest."""
    return (docs.withColumn("_text", text_of())
            .withColumn("_ord", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)))
            .withColumn("_tkey", F.unhex(F.md5(F.col("_text").cast("binary")))))


def sequences(docs: DataFrame, min_chars: int) -> DataFrame:
    """(_ord, _tkey, i, line, last, k, left, id): a row for each line with anything in it, the i-th of its document.

    k: how many lines from this one on have ``min_chars`` characters that aren't white space (null if
    the document ends before); line and last: the numbers of the first and the last of them among all lines;
    left: how many rows the document has from this one on.
    """
    facts = F.transform(F.split("_text", "\n", -1), lambda x, n: F.struct(
        n.alias("line"), x.alias("l"), F.least(F.length(F.regexp_replace(x, WHITE, "")), F.lit(min_chars)).alias("c")))
    full = keyed(docs).select(*DOC, F.filter(facts, lambda x: x["c"] > 0).alias("_s"))
    enough = lambda s, x: F.when(s["c"] >= min_chars, s).otherwise(F.struct((s["c"] + x["c"]).alias("c"), (s["k"] + 1).alias("k")))
    none = F.struct(F.lit(0).alias("c"), F.lit(0).alias("k"))
    # every line of the sequence has a character at least, so min_chars lines are enough
    asked = F.transform("_s", lambda x, n: F.when(x["c"] >= min_chars, F.struct(x["c"].alias("c"), F.lit(1).alias("k"))).otherwise(
        F.aggregate(F.slice(F.col("_s"), n + 1, F.lit(min_chars)), none, enough)))
    # the last line's number is looked up before the lines are dealt out, so that none of them carries the document
    lines = F.transform(F.arrays_zip(F.col("_s").alias("s"), asked.alias("w")), lambda x, n: F.struct(
        x["s"]["line"].alias("line"), x["s"]["l"].alias("l"), (F.size("_s") - n).alias("left"), F.when(x["w"]["c"] >= min_chars, x["w"]["k"]).alias("k"),
        F.when(x["w"]["c"] >= min_chars, F.get("_s", n + x["w"]["k"] - 1)["line"]).alias("last")))
    # the outer form, as for the other one Spark tests the array's size beforehand, working all of it out again for each line
    rows = full.select(*DOC, lines.alias("_lines")).select(*DOC, F.posexplode_outer("_lines").alias("i", "x")).where("x is not null")
    return rows.select(*DOC, "i", "x.line", "x.last", "x.k", "x.left", F.unhex(F.md5(F.col("x.l").cast("binary"))).alias("id"))


def dealt_out(classes: DataFrame, keys: list[str]) -> DataFrame:
    """``classes``, written in range partitions by their keys, with the number of the partition, _part."""
    return write_table(classes.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "lines-classes")


def numbered(dealt: DataFrame, keys: list[str], group: str | None = None) -> DataFrame:
    """What dealt_out() gave, with ``rank``: how much n the classes in front have, in key order; of the same ``group`` (the first key) only, if named.

    Where classes have a ``first`` place, ``before`` is that of the class in front, of the same group.
    Each partition is counted by itself and then moved by those before it, of which there is one row each.
    """
    placed = "first" in dealt.columns
    rows = dealt.withColumn("_g", F.col(group) if group else F.lit(0)).withColumn("_first", F.col("first") if placed else F.lit(None))
    ends = rows.groupBy("_part").agg(F.min("_g").alias("_lo"), F.max("_g").alias("_hi"))
    tails = rows.join(F.broadcast(ends), "_part").where("_g = _hi").groupBy("_part").agg(
        F.sum("n").alias("_sum"), F.max(F.struct(*keys, "_first"))["_first"].alias("_tail"))
    earlier = ends.join(tails, "_part").select(F.col("_part").alias("_p"), F.col("_hi").alias("_of"), "_sum", "_tail")
    moved = ends.join(F.broadcast(earlier), (F.col("_p") < F.col("_part")) & (F.col("_of") == F.col("_lo")), "left").groupBy("_part", "_lo").agg(
        F.coalesce(F.sum("_sum"), F.lit(0)).alias("_move"), F.max(F.struct("_p", "_tail"))["_tail"].alias("_tail"))
    w = Window.partitionBy("_part", "_g").orderBy(*keys)
    start = F.col("_g") == F.col("_lo")
    out = rows.join(F.broadcast(moved), "_part").withColumn(
        "rank", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.when(start, F.col("_move")).otherwise(0))
    if placed:
        out = out.withColumn("before", F.coalesce(F.lag("_first").over(w), F.when(start, F.col("_tail"))))
    return out.drop("_part", "_g", "_first", "_lo", "_move", "_tail")


def ranked(classes: DataFrame, keys: list[str]) -> DataFrame:
    """``classes`` (keys, n) with ``rank``: the number of suffixes in front of each, in key order."""
    return numbered(dealt_out(classes, keys), keys)


def _joined(rows: DataFrame, classes: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """Each row with its class; classes of more than HOT rows, ``hot``, are dealt over tasks."""
    most = hot.agg(F.max("n")).first()[0]
    return skew_join(rows, classes, keys, hot, [*DOC, "i"], salts_for(most, HOT)) if most else rows.join(classes, keys)


def _rerank(rows: DataFrame, keys: list[str], h: int, shown: list[str]) -> DataFrame:
    """The rows, written with the columns ``shown``, among them their rank by two keys, h lines in all, the first key being their rank by fewer.

    n: how many have it; many: may more lines tell these apart; head: is it the first place of these;
    before: for a head, the first place of the rank in front, if their ranks by fewer lines are the same.
    """
    place, rest = F.struct(*DOC, "i"), F.struct("_tkey", "i")
    differ = (F.min(rest) != F.max(rest)) & (F.max("left") > h)  # the same place of the same text, or what ends by then, is equal to the end
    dealt = dealt_out(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(place).alias("first"), differ.alias("many")), keys)
    hot = dealt.where(F.col("n") > HOT)
    classes = numbered(dealt, keys, keys[0]).withColumn("rank", F.col("rank") + F.col(keys[0]))
    head = place == F.col("first")
    out = write_table(_joined(rows, classes, keys, hot).withColumns({"head": head, "before": F.when(head, F.col("before"))}).select(*shown), "lines-ranks")
    drop_table(dealt)
    return out


def _beside(rows: DataFrame, live: DataFrame, n: int) -> DataFrame:
    """The rows of documents that have one of ``n`` live ones, and maybe some others."""
    return KeyFilter(live, F.xxhash64(*DOC), filter_bits(n)).mark(rows, F.xxhash64(*DOC), "_may").where("_may").drop("_may")


def suffix_array(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The suffix array of all sequences, and the common prefixes of its neighbours.

    The first has (_ord, _tkey, i, line, last, k, left, rank, n, head, h) for every suffix. rank: the number of suffixes in
    front; only suffixes of the same lines up to the end, n of them, share one, and stand in it by place, head
    being the first. h: how many lines told the rank, as a power of two. The second has (rank, lcp): how many lines
    the suffix in front has in common with those of that rank; ranks without a row share none.
    """
    own = [*DOC, "i", "line", "last", "k", "left"]
    shown = [*own, "rank", "n", "head", "many"]
    now = _rerank(rows.withColumn("k1", F.lit(0).cast("long")), ["k1", "id"], 1, shown)
    alone = now.where("n = 1").withColumn("h", F.lit(1))
    now = write_table(now.where("n > 1").distinct(), "lines-ranks")  # rows that repeat a document stand at one place
    done, live, levels, bounds, h = [alone, now.where("not many").withColumn("h", F.lit(1))], now.where("many"), [], [], 1
    told = reduce(DataFrame.unionByName, done).select(*DOC, "i", "rank")  # those beside live ones, so that each round reads fewer
    old = None
    while n := live.count():
        levels.append(live.select(*DOC, "i", "rank"))
        told = write_table(_beside(told, live, n), "lines-told")
        if old:
            drop_table(old)
        old = told
        asked = live.select(*own, F.col("rank").alias("k1"), (F.col("i") + h).alias("_to"))
        ahead = told.unionByName(levels[-1]).select(*DOC, F.col("i").alias("_to"), F.col("rank").alias("k2"))
        pairs = asked.join(ahead, [*DOC, "_to"], "left").withColumn("k2", F.coalesce("k2", F.lit(-1))).drop("_to")
        h *= 2
        pairs = write_table(pairs, "lines-pairs")
        now = _rerank(pairs, ["k1", "k2"], h, [*shown, "before"])
        drop_table(pairs)
        bounds.append(now.where("before is not null"))
        done.append(now.where("not many").select(*shown).withColumn("h", F.lit(h)))
        told, live = told.unionByName(done[-1].select(*DOC, "i", "rank")), now.where("many")
    return reduce(DataFrame.unionByName, done).drop("many"), common_prefixes(levels, bounds, rows)


def common_prefixes(levels: list[DataFrame], bounds: list[DataFrame], rows: DataFrame) -> DataFrame:
    """(rank, lcp) of suffix_array(): bounds[t] are ranks whose first 2^t lines and not 2^(t+1) are those in front.

    What they have in common behind the first 2^t lines is found by the ranks by half as many lines,
    a quarter, and so on; suffixes of the same such rank go on behind its lines.
    """
    if not bounds:
        return rows.select(F.lit(0).cast("long").alias("rank"), F.lit(0).alias("lcp")).limit(0)
    out, apart, old = bounds[0].select("rank", F.lit(1).alias("lcp")), None, None
    for t in range(len(bounds) - 1, 0, -1):
        new = bounds[t].select("rank", F.lit(1 << t).alias("lcp"), F.struct(*DOC).alias("da"), (F.col("i") + (1 << t)).alias("ia"),
                               F.struct(*(F.col(f"before.{c}") for c in DOC)).alias("db"), (F.col("before.i") + (1 << t)).alias("ib"))
        apart = new if apart is None else apart.unionByName(new)
        for s in "ab":
            apart = apart.join(levels[t - 1].select(F.struct(*DOC).alias(f"d{s}"), F.col("i").alias(f"i{s}"), F.col("rank").alias(f"r{s}")), [f"d{s}", f"i{s}"], "left")
        more = F.when(F.col("ra") == F.col("rb"), 1 << (t - 1)).otherwise(0)
        apart = write_table(apart.select("rank", "da", "db", *((F.col(c) + more).alias(c) for c in ("lcp", "ia", "ib"))), "lines-prefixes")
        if old:
            drop_table(old)
        old = apart
    return out if apart is None else out.unionByName(apart.select("rank", "lcp"))


def later_copies(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(_ord, _tkey, i, line, last, k, rank): the k lines from each line on that also stand earlier.

    Suffixes with the same k lines ask for as many, so they are neighbours in the suffix array, and an
    interval begins where a suffix has less than its k lines in common with the one in front. rank: the
    place of the interval in the array.
    """
    own = [*DOC, "i", "line", "last", "k"]
    array, prefixes = suffix_array(write_table(sequences(docs, min_chars), "lines"))
    asked = array.where("k is not null and (h > 1 or n > 1)")  # a line that stands nowhere else begins an interval of its own
    heads = asked.where("head").join(prefixes, "rank", "left").withColumn("n", (F.coalesce("lcp", F.lit(0)) < F.col("k")).cast("long"))
    rows = heads.drop("lcp").unionByName(asked.where("not head").withColumn("n", F.lit(0).cast("long"))).withColumnRenamed("rank", "at")
    rows = ranked(rows.select(*own, "at", "n"), ["at", *DOC, "i"]).select(*own, "at", (F.col("rank") + F.col("n")).alias("interval"))
    rows = write_table(rows, "lines-intervals")
    place = F.struct(*DOC, "i")
    first = write_table(rows.groupBy("interval").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.min("at").alias("rank")).where("n > 1"), "lines-first")
    hot = first.where(F.col("n") > HOT)
    return _joined(rows, first.drop("n"), ["interval"], hot).where(place != F.col("first")).select(*own, "rank")


def repeated_runs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(_ord, _tkey, start, n_lines): the maximal runs of lines that later copies cover."""
    starts = later_copies(docs, min_chars).select(*DOC, "line", "last")
    w = Window.partitionBy(*DOC).orderBy("line", "last")
    upto = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("line") > upto + 1, F.lit(True)).cast("int")
    run = F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (starts.withColumn("_fresh", fresh).withColumn("_run", run).groupBy(*DOC, "_run")
            .agg(F.min("line").alias("start"), (F.max("last") - F.min("line") + 1).alias("n_lines")).drop("_run"))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """All columns of ``docs`` plus ``_kept_text``, ``_n_lines``, ``_n_removed`` and ``_n_runs``.

    A text is cut at line feeds; a null or empty text is one empty line. Lines of nothing but ASCII
    white space are left out of account. Of each run of lines, one or more, that has ``min_chars``
    characters besides white space at least, in other documents or the same, the first by doc_id
    (null last), then by text digest and line, stays and every later copy is deleted, with the white
    lines inside it and lines that only overlap it. What is left is joined by line feeds; a text of which no line is
    left is empty, and its row stays. Rows that repeat doc_id and text are one document with one
    result for each row. An empty table gives no rows. Columns named like the new ones are replaced,
    others pass unchanged.
    """
    new = ["_kept_text", "_n_lines", "_n_removed", "_n_runs"]
    runs = repeated_runs(docs.select("doc_id", "text"), min_chars)
    cut = write_table(runs.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("start", "n_lines"))).alias("_runs")), "lines-runs")
    key = F.xxhash64(*DOC)
    marked = KeyFilter(cut, key, filter_bits(cut.count())).mark(keyed(packed(docs, new)), key, "_hit")
    whole = F.split("_text", "\n", -1)
    same = marked.where("not _hit").select(
        "_row.*", F.col("_text").alias("_kept_text"), F.size(whole).cast("long").alias("_n_lines"),
        F.lit(0).cast("long").alias("_n_removed"), F.lit(0).cast("long").alias("_n_runs"))
    hit = marked.where("_hit").join(cut, DOC, "left").withColumn("_lines", whole).withColumn(
        "_runs", F.coalesce("_runs", F.expr("cast(array() as array<struct<start:int,n_lines:int>>)")))
    # what lies between the runs: from the end of one to the start of the next
    ends = F.concat(F.array(F.lit(0)), F.transform("_runs", lambda r: r["start"] + r["n_lines"]))
    begins = F.concat(F.transform("_runs", lambda r: r["start"]), F.array(F.size("_lines")))
    left = F.flatten(F.zip_with(ends, begins, lambda a, b: F.slice(F.col("_lines"), a + 1, b - a)))
    gone = F.aggregate("_runs", F.lit(0).cast("long"), lambda n, r: n + r["n_lines"])
    part = hit.select("_row.*", F.array_join(left, "\n").alias("_kept_text"), F.size("_lines").cast("long").alias("_n_lines"),
                      gone.alias("_n_removed"), F.size("_runs").cast("long").alias("_n_runs"))
    return same.unionByName(part)
