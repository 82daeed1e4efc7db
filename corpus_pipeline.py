"""From raw documents to packed training sequences: five stages over the operators of rowcloak.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowcloak.llm.common import quoted, write_table
from rowcloak.llm.langid import UNKNOWN, fit_language_model, predict_language, train_fold
from rowcloak.llm.line_dedup import line_dedup
from rowcloak.llm.near_dedup import near_dedup
from rowcloak.llm.packing import pack
from rowcloak.llm.queries import vocabulary
from rowcloak.llm.suffix_dedup import suffix_dedup


#: Which languages stay, and how sure the classifier has to be; with four languages a score of 0.25 says nothing.
LANGUAGES, LEAST_SCORE = None, 0.3


def _with_text(df: DataFrame, text, columns: list[str]) -> DataFrame:
    """The columns with another text, and its number of characters where there is such a column."""
    out = df.withColumn("text", text)
    return (out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else out).select(*quoted(columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str, languages: set[str] | None = LANGUAGES, least_score: float = LEAST_SCORE) -> DataFrame:
    """Documents of the wanted languages (None: of any that was learned) whose score is ``least_score`` at least.

    Texts that are null or without letters have no language and go. The model learns from the
    labelled documents of three folds in four; without any, texts with a letter stay.
    """
    labelled = docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))
    model = fit_language_model(labelled.select("doc_id", "text", "lang"), train_fold())
    out = predict_language(docs, model, pred="_pipeline_lang", score="_pipeline_score")
    known = (F.col("_pipeline_lang") != UNKNOWN) & (F.col("_pipeline_score") >= least_score)
    wanted = known & F.col("_pipeline_lang").isin(sorted(languages)) if languages is not None else known
    has_letter = F.col("text").rlike(r"\p{L}")  # without a model, what it would reject in any case
    return out.where(wanted if model else has_letter).select(*quoted(docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, later copies of runs of repeated lines cut from their texts (which may be empty then)."""
    return _with_text(line_dedup(docs), F.col("_kept_text"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a Jaccard similarity of 0.8 or more."""
    return near_dedup(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the byte strings that repeat; characters cut in two go with them."""
    return _with_text(suffix_dedup(docs), F.col("_kept_text"), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences, each source in proportion to its tokens, with their token ids."""
    if "source" not in docs.columns:
        docs = docs.withColumn("source", F.lit(""))
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("passages", passages), ("packing", packing)]

#: The stages' models, fingerprints and tokens have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
