"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_decode, bpe_encode
from .common import crc_fold, table
from .divergence import divergence_audit
from .exact_dedup import exact_dedup
from .html_extract import extract_main_text
from .jpeg import read_media, store_media
from .langid import fit_language_model, predict_language, train_fold
from .line_dedup import line_dedup
from .lm_score import folds, lm_score
from .packing import pack
from .rule_forest import fit_rule_forest, judge_rules
from .simhash import simhash_dedup
from .suffix_dedup import suffix_dedup
from .vector_code import books_digest, label_errors, vector_codes


def vocabulary(name: str) -> str:
    """The place of an installed public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents").select("doc_id", "text"), *folds())


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_keep_id").alias("keep_id"), F.col("_group_size").alias("group_size"),
                      F.col("_kept").alias("kept"), F.col("_text_sha256").alias("text_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), vocabulary("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"),
                      F.col("_n_runs").alias("n_runs"), F.sha2("_kept_text", 256).alias("kept_sha256"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("_main_text").alias("text"), F.length("_main_text").cast("long").alias("n_chars"))


def op6_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = read_media(store_media(table(spark, sf_dir, "documents"), keep=["doc_id"]))
    return out.select("doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_payload_bytes").alias("payload_bytes"),
                      F.sha2("_payload", 256).alias("payload_sha256"), F.crc32(F.substring("_payload", -32, 32)).alias("tail_crc32"),
                      F.octet_length("_media").cast("long").alias("media_bytes"), F.sha2("_media", 256).alias("media_sha256"),
                      F.col("_feature").alias("feature"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_50k.json")
    ids = bpe_encode(table(spark, sf_dir, "documents"), path, keep=["doc_id"])
    out = bpe_decode(ids, path)
    decimal = F.concat_ws(",", F.col("_ids").cast("array<string>"))
    return out.select("doc_id", F.size("_ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"),
                      F.sha2("_decoded", 256).alias("decoded_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predict_language(docs.select("doc_id", "text"), fit_language_model(docs, train_fold()))
    return out.select("doc_id", (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return out.select("doc_id", F.col("_n_bytes").alias("n_bytes"), gone.alias("n_removed"),
                      F.size("_spans").cast("long").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op12_rule_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judge_rules(docs, fit_rule_forest(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", *(F.col(f"_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                      F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_score").alias("score"))


def op13_vector_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    out = label_errors(coded.select("vec_id", "label", "_code", "_error"))
    return out.select("vec_id", F.col("_code").alias("code"), F.col("_error").alias("error"), F.col("_label_error").alias("label_error"),
                      F.lit(books_digest(books)).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": op1_lm_score,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_packing": op3_packing,
    "op4_line_dedup": op4_line_dedup,
    "op5_html": op5_html,
    "op6_jpeg": op6_jpeg,
    "op7_bpe": op7_bpe,
    "op8_simhash": op8_simhash,
    "op9_langid": op9_langid,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_divergence": op11_divergence,
    "op12_rule_forest": op12_rule_forest,
    "op13_vector_code": op13_vector_code,
}

def _codes_sql(rounds: int = 4) -> str:
    """The rounds of op13 one after another; distances as |p|^2 - 2 p e + |e|^2, whole numbers that doubles hold exactly."""
    parts = "unnest([1, 2, 3, 4])"
    steps = ["""
        WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS MATERIALIZED (SELECT vec_id, label, part, v[(part - 1) * (len(v) // 4) + 1 : part * (len(v) // 4)] AS w FROM (SELECT *, %s AS part FROM k)),
        b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, w AS c FROM p
               QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= 256)""" % parts]
    near = """
        a{i} AS MATERIALIZED (SELECT vec_id, label, p.part, w, min({{'d': list_inner_product(w, w) - 2 * list_inner_product(w, c) + list_inner_product(c, c), 'e': e}}) AS m
               FROM p JOIN b{i} b ON p.part = b.part GROUP BY vec_id, label, p.part, w)"""
    mean = """
        s{i} AS (SELECT part, m.e AS e, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM a{i}),
        n{i} AS (SELECT part, e, list(x ORDER BY j) AS c FROM (SELECT part, e, j, floor(sum(x) / count(*)) AS x FROM s{i} GROUP BY ALL) GROUP BY ALL),
        b{j} AS MATERIALIZED (SELECT b.part, b.e, coalesce(n.c, b.c) AS c FROM b{i} b LEFT JOIN n{i} n ON b.part = n.part AND b.e = n.e)"""
    for i in range(rounds):
        steps += [near.format(i=i), mean.format(i=i, j=i + 1)]
    steps.append(near.format(i=rounds))
    return ",".join(steps) + """,
        r AS (SELECT vec_id, label, string_agg(lower(printf('%02x', m.e)), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error
              FROM a{i} GROUP BY vec_id, label),
        h AS (SELECT sha256(string_agg(t, ',' ORDER BY part, e)) AS codebooks_sha256
              FROM (SELECT part, e, array_to_string(list_transform(c, lambda x: x::BIGINT), ',') AS t FROM b{i}))
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM r, h""".replace("{i}", str(rounds))


ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
        g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept,
               sha256(d.norm) AS text_sha256
        FROM d JOIN g ON d.norm = g.norm""",
    # lines with anything in them; of each the fewest lines from it on that have 40 characters; the later copies of those
    "op4_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
        c AS (SELECT *, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS n FROM l),
        s AS (SELECT doc_id, list(line ORDER BY i) AS lines, list(i ORDER BY i) AS nos, list(n ORDER BY i) AS ns FROM c WHERE n > 0 GROUP BY doc_id),
        p AS (SELECT *, unnest(range(1, len(ns) + 1)) AS p FROM s),
        e AS (SELECT *, list_filter(range(p, least(p + 40, len(ns) + 1)), lambda x: list_sum(ns[p:x]) >= 40)[1] AS e FROM p),
        f AS (SELECT doc_id, nos[p] AS a, nos[e] AS z, row_number() OVER (PARTITION BY array_to_string(lines[p:e], chr(10)) ORDER BY doc_id, p) AS nth
              FROM e WHERE e IS NOT NULL),
        g AS (SELECT DISTINCT doc_id, unnest(range(a, z + 1)) AS i FROM f WHERE nth > 1),
        m AS (SELECT l.doc_id, l.i, l.line, g.i IS NOT NULL AS gone FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i),
        r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM m)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_runs,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM r GROUP BY doc_id""",
    "op11_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
        t AS (SELECT i, lang, source, unnest(ts) AS term FROM d),
        v AS (SELECT lang, term, count(*) AS cl FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 3),
        c AS (SELECT t.lang, t.source, t.term, count(*) AS c FROM t JOIN v ON t.lang = v.lang AND t.term = v.term GROUP BY ALL),
        l AS (SELECT lang, count(*)::HUGEINT AS nv, sum(cl)::HUGEINT AS nl FROM v GROUP BY lang),
        g AS (SELECT s.lang, s.source, coalesce(sum(c.c), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) s
              LEFT JOIN c ON s.lang = c.lang AND s.source = c.source GROUP BY ALL),
        m AS (SELECT g.lang, g.source, v.term, coalesce(c.c, 0) AS c,
                     1 + (1000000000 * (coalesce(c.c, 0) + 1)::HUGEINT) // (g.n + l.nv) AS p,
                     1 + (1000000000 * (v.cl + 1)::HUGEINT) // (l.nl + l.nv) AS q
              FROM g JOIN l ON g.lang = l.lang JOIN v ON g.lang = v.lang
              LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
        x AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
              FROM m a JOIN m b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
              UNION ALL
              SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM m WHERE c > 0 AND p > q)
        SELECT lang, source, part, item, value, rank::INTEGER AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
        WHERE part = 'pair' OR rank <= 200""",
    "op13_vector_code": _codes_sql(),
}
