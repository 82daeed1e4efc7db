"""Source divergence audit by ranking of count cells.

How much does a source say otherwise than the sources around it in the same language? Two answers for
each (lang, source) group: its divergence from each other source of the language, summed over the
terms, and the terms that it uses more than the language does, by their share of the divergence. Both
depend on a term by two counts only, so terms are grouped into cells of equal counts and the arithmetic
is done once for each cell.

- Terms: cells of (count in the group, count in the language). The cells' values are merged where equal
  and ranked by cumulative multiplicity; only the cells that reach the asked ranks are expanded to their
  terms, which are then ordered by UTF-8 within a value.
- Pairs: cells of (count in one source, count in the other). With g(x, y) for the value of counts x and
  y, a term adds g(x, 0) + [g(0, y) - g(0, 0)] + [g(x, y) - g(x, 0) - g(0, y) + g(0, 0)]; the last is
  zero unless both counts are positive. So what a term without one of the two sources adds follows from
  each source's own histogram of counts, and only terms that both have need their joint cells, which are
  merged within a block of terms before anything is shuffled.

Shares are whole numbers, p = 1 + floor(10^9 (count + 1) / (N + V)); the products that could pass 64
bits are decimals, so all is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import KeyFilter, filter_bits, skew_join, text_of, salts_for, write_table
from .words import byte_class, bytes_of, codes_of, counted, cut, passes, word_starts

SCALE, MIN_DOCS, RANKS = 1_000_000_000, 3, 200
BLOCK, PAIRS, HOT, PASS = 8_192, 1 << 21, 4_096, 1 << 20
LETTER = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
GROUP = ["lang", "source"]


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of runs of texts: occurrences, and documents that have the term."""
    for batch in batches:
        langs, lang_names = codes_of(batch.column(0))
        sources, source_names = codes_of(batch.column(1))
        group = langs * len(source_names) + sources
        for lo, hi in passes(batch.column(2), PASS):
            data, begins = bytes_of(batch.column(2).slice(lo, hi - lo))
            inside = LETTER[data]
            first = word_starts(inside, begins)
            codes, terms = codes_of(cut(_LOWER[data], inside, first))
            many = len(terms)
            if not many:
                continue
            doc = np.repeat(np.arange(lo, hi), np.diff(np.searchsorted(np.flatnonzero(first), begins)))
            key, n = counted(doc * many + codes)
            at, inverse = np.unique(group[key // many] * many + key % many, return_inverse=True)
            g = at // many
            yield pa.RecordBatch.from_arrays([
                lang_names.take(pa.array(g // len(source_names))), source_names.take(pa.array(g % len(source_names))),
                terms.take(pa.array(at % many)).cast(pa.string()),
                pa.array(np.bincount(inverse, n).astype(np.int64)), pa.array(np.bincount(inverse).astype(np.int64))],
                ["lang", "source", "term", "n", "docs"])


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, first) of terms in ``min_docs`` documents of their language at least.

    n, lang_n: occurrences in the group and in the language; first: is this the term's first source?
    """
    counts = docs.mapInArrow(_terms, "lang string, source string, term string, n long, docs long").groupBy(*GROUP, "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    return counts.select(*GROUP, "term", "n", F.sum("n").over(w).alias("lang_n"), F.sum("docs").over(w).alias("_docs"),
                         (F.min("source").over(w) == F.col("source")).alias("first")).where(F.col("_docs") >= min_docs).drop("_docs")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (count + 1) / (total + terms)), exact; null where there is no term."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", wide(count + 1) * F.lit(SCALE).cast("decimal(10,0)"), F.nullif(wide(total + terms), F.lit(0).cast("decimal(20,0)"))) + 1


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) of shares."""
    return F.call_function("div", (p - q) * (p - q), q)


def _joint(key: tuple, table: pa.Table) -> pa.Table:
    """(lang, a, b, x, y, terms): of a block of terms, how many have counts x and y in the sources a < b.

    The pairs of sources of a term are made a bounded number at a time and merged at once.
    """
    column = {c: table.column(c).combine_chunks() for c in ("lang", "source", "term", "n")}
    langs, lang_names = codes_of(column["lang"])
    names = column["source"].unique().sort()
    sources = codes_of(pa.concat_arrays([names, column["source"]]))[0][len(names):]
    terms = codes_of(column["term"])[0] * len(lang_names) + langs
    levels, n = np.unique(column["n"].to_numpy(), return_inverse=True)
    order = np.lexsort((sources, terms))
    terms, n, group = terms[order], n[order], (langs * len(names) + sources)[order]
    groups, group = np.unique(group, return_inverse=True)
    ends = np.append(np.flatnonzero(np.diff(terms)), len(terms) - 1) + 1
    later = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(terms)) - 1  # entries of the term behind each
    upto = np.append(0, np.cumsum(later))
    found, lo = [], 0
    while lo < len(terms):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + PAIRS, "right")) - 1)
        left = np.repeat(np.arange(lo, hi), later[lo:hi])
        right = left + 1 + np.arange(len(left)) - np.repeat(upto[lo:hi] - upto[lo], later[lo:hi])
        pair, of_pair = np.unique(group[left] * len(groups) + group[right], return_inverse=True)
        cell, many = np.unique((of_pair * len(levels) + n[left]) * len(levels) + n[right], return_counts=True)
        found.append((pair[cell // len(levels) ** 2], cell // len(levels) % len(levels), cell % len(levels), many))
        lo = hi
    pair, x, y, many = (np.concatenate(c) for c in zip(*found, strict=True))
    a, b = groups[pair // len(groups)], groups[pair % len(groups)]
    return pa.table([lang_names.take(pa.array(a // len(names))), names.take(pa.array(a % len(names))), names.take(pa.array(b % len(names))),
                     pa.array(levels[x]), pa.array(levels[y]), pa.array(many.astype(np.int64))], ["lang", "a", "b", "x", "y", "terms"])


def joint_cells(kept: DataFrame) -> DataFrame:
    """(lang, a, b, x, y, terms): the terms that two sources a < b of a language both have, by their counts."""
    blocks = max(1, -(-kept.count() // BLOCK))
    dealt = kept.select("lang", "source", "term", "n", F.pmod(F.xxhash64("lang", "term"), F.lit(blocks)).alias("_block"))
    made = dealt.groupBy("_block").applyInArrow(_joint, "lang string, a string, b string, x long, y long, terms long")
    return made.groupBy("lang", "a", "b", "x", "y").agg(F.sum("terms").alias("terms"))


def pair_divergences(kept: DataFrame, groups: DataFrame, cells: DataFrame) -> DataFrame:
    """(lang, source, item, value): each group against each other source of its language, over all kept terms."""
    near = groups.select("lang", F.col("source").alias("a"), F.col("p0").alias("a0"), F.col("n_group").alias("a_n"), "vocabulary", F.col("own_terms").alias("a_terms"))
    far = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("b0"), F.col("n_group").alias("b_n"))
    wide = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(38,0)")
    both = near.join(far, "lang").where("a <> b")
    empty = both.select("lang", "a", "b", wide((F.col("vocabulary") - F.col("a_terms")) * divergence(F.col("a0"), F.col("b0"))).alias("value"))
    levels = cells.groupBy(*GROUP, "p").agg(F.sum("terms").alias("terms")).select("lang", F.col("source").alias("own"), "p", "terms")
    # a source's own histogram, as that of the first and as that of the second of a pair
    sides = levels.join(groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0")), "lang").where("own <> other").join(
        groups.select("lang", F.col("source").alias("own"), F.col("p0").alias("own0")), ["lang", "own"])
    as_first = F.struct(F.col("own").alias("a"), F.col("other").alias("b"), (F.col("terms") * divergence(F.col("p"), F.col("q0"))).alias("v"))
    as_second = F.struct(F.col("other").alias("a"), F.col("own").alias("b"),
                         (F.col("terms") * (divergence(F.col("q0"), F.col("p")) - divergence(F.col("q0"), F.col("own0")))).alias("v"))
    alone = sides.select("lang", F.explode(F.array(as_first, as_second)).alias("s")).select("lang", "s.a", "s.b", wide(F.col("s.v")).alias("value"))
    met = joint_cells(kept).join(near, ["lang", "a"]).join(far, ["lang", "b"])
    pa_, pb = share(F.col("x"), F.col("a_n"), F.col("vocabulary")), share(F.col("y"), F.col("b_n"), F.col("vocabulary"))
    met = met.select("lang", "a", "b", "terms", "a0", "b0", pa_.alias("pa"), pb.alias("pb"))
    rest = lambda p, q, p0, q0: F.col("terms") * (divergence(p, q) - divergence(p, q0) - divergence(p0, q) + divergence(p0, q0))
    c = F.col
    ways = F.array(F.struct(c("a"), c("b"), rest(c("pa"), c("pb"), c("a0"), c("b0")).alias("v")),
                   F.struct(c("b").alias("a"), c("a").alias("b"), rest(c("pb"), c("pa"), c("b0"), c("a0")).alias("v")))
    joint = met.select("lang", F.explode(ways).alias("s")).select("lang", "s.a", "s.b", wide(F.col("s.v")).alias("value"))
    return empty.unionByName(alone).unionByName(joint).groupBy("lang", "a", "b").agg(F.sum("value").cast("long").alias("value")).select(
        "lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")


def top_terms(kept: DataFrame, cells: DataFrame, ranks: int = RANKS) -> DataFrame:
    """(lang, source, item, value, rank): each group's first terms, of those that it uses more than its language."""
    above = cells.where("p > q")
    values = above.groupBy(*GROUP, "value").agg(F.sum("terms").alias("terms"))
    best = Window.partitionBy(*GROUP).orderBy(F.desc("value"))
    # a value has a term at least, so no more values than ranks are needed
    few = values.withColumn("_nth", F.row_number().over(best)).where(F.col("_nth") <= ranks)
    before = F.coalesce(F.sum("terms").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = write_table(few.withColumn("_before", before).where(F.col("_before") < ranks).select(*GROUP, "value"), "divergence-values")
    cell = [*GROUP, "n", "lang_n"]
    wanted = write_table(above.join(reached, [*GROUP, "value"]).select(*cell, "value", "terms"), "divergence-cells")
    near = KeyFilter(wanted, F.xxhash64(*cell), filter_bits(wanted.count())).mark(kept.select(*cell, "term"), F.xxhash64(*cell), "_near").where("_near").drop("_near")
    hot = wanted.where(F.col("terms") > HOT)
    terms = skew_join(near, wanted.drop("terms"), cell, hot, ["term"], salts_for(hot.agg(F.max("terms")).first()[0], HOT))
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), F.asc("term")))
    return terms.select(*GROUP, F.col("term").alias("item"), "value", rank.alias("rank")).where(F.col("rank") <= ranks)


def divergence_audit(docs: DataFrame, min_docs: int = MIN_DOCS, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source departs from its language.

    Terms are runs of letters (ASCII ones lower-cased, everything beyond ASCII counts as a letter); a
    language keeps those in ``min_docs`` of its documents. Part ``pair`` has each other source of the
    language, all ranks; part ``term`` the kept terms whose share in the group is larger than in the
    language, to ``ranks``. Ranks go by value, largest first, then item in UTF-8. Null text, lang and
    source are empty strings; a group without terms has pairs only, of value 0 where the language keeps
    no term; a source alone in its language has no pairs. Each row of ``docs`` is a document, repeated
    ones too. An empty table gives no rows. Other columns are left aside.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    kept = write_table(kept_terms(docs.select(name("lang"), name("source"), text_of().cast("binary").alias("text")), min_docs), "divergence-terms")
    langs = kept.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.sum(F.col("first").cast("long")).alias("vocabulary"))
    own = kept.groupBy(*GROUP).agg(F.sum("n").alias("n_group"), F.count("*").alias("own_terms"))
    seen = docs.select(name("lang"), name("source")).distinct()
    groups = seen.join(own, GROUP, "left").join(langs, "lang", "left").fillna(0, ["n_group", "own_terms", "n_lang", "vocabulary"])
    groups = write_table(groups.withColumn("p0", share(F.lit(0), F.col("n_group"), F.col("vocabulary"))), "divergence-groups")
    cells = kept.groupBy(*GROUP, "n", "lang_n").agg(F.count("*").alias("terms")).join(groups, GROUP).withColumns({
        "p": share(F.col("n"), F.col("n_group"), F.col("vocabulary")), "q": share(F.col("lang_n"), F.col("n_lang"), F.col("vocabulary"))})
    cells = write_table(cells.select(*GROUP, "n", "lang_n", "terms", "p", "q", divergence(F.col("p"), F.col("q")).alias("value")), "divergence-levels")
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), F.asc("item")))
    pairs = pair_divergences(kept, groups, cells).withColumn("rank", rank)
    shape = lambda df, part: df.select(*GROUP, F.lit(part).alias("part"), "item", "value", "rank")
    return shape(pairs, "pair").unionByName(shape(top_terms(kept, cells, ranks), "term"))
