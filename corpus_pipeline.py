"""A corpus pipeline over ``documents``: language ID, near-dedup, decontamination, PII, mixing.

Every stage takes the table that its predecessor kept, and all but the last return its columns, further ones included.  Columns may have any
names but those that begin with two underscores.  An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslens.llm import decontam, langid, mixing, neardup, pii
from saleslens.llm.common import discard, materialize, read
from saleslens.llm.queries import PII_KEY, qualities

#: Benchmark items of fewer tokens are no evidence of contamination: any text may hold a phrase of a few words.
MIN_ITEM_TOKENS = 5


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; rejected ones go.

    Null and empty texts and those without a letter are rejected; a tie between languages has no margin and is rejected too; repeated rows are
    judged alike; with no labelled document all are rejected.  Null ids are never in the training part's hash classes but 0, so they don't train.
    """
    train = docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5, F.lit(0)) != 0)
    model = langid.fit_dictionaries(train, order=F.xxhash64("doc_id"))
    got = langid.identify(docs, model, lang_col="__lang", score_col="__score", rejected_col="__rejected")
    return got.where("not __rejected").select(*_columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, Jaccard similarity 0.8 or more): that with the smallest doc_id.

    Null ids come after all others; of repeated rows one stays; texts without words (null, empty) are copies of each other.
    """
    return neardup.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a benchmark item, up to substitutions.

    Rows are judged by id and text, so a null or repeated id decides nothing for other rows, and equal rows go together; null and empty texts
    stay; items without tokens match nothing, those of fewer than ``MIN_ITEM_TOKENS`` aren't searched for.
    """
    row = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).cast("binary"))
    judged = docs.select(row.alias("__row"), F.col("text").alias("__text"))
    found = decontam.contamination(judged, read(spark, sf_dir, "benchmark"), id_col="__row", text="__text", min_tokens=MIN_ITEM_TOKENS)
    found = materialize(found.select("__row").distinct(), "contaminated")
    return docs.withColumn("__row", row).join(found, "__row", "left_anti").select(*_columns(docs))


def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data pseudonymized; n_chars is that of the new text (null for a null text).

    Rows are independent of each other: repeated ones change alike.
    """
    new = pii.pseudonymize(docs, PII_KEY, count="__n").withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return new.select(*_columns(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the words that the mix takes of each (size, source_size, target, taken); those it doesn't take go.

    Null texts and those without words have size 0 and go; a null source is a source; documents without label count as 1; of
    repeated labels the best counts; repeated rows share what is taken of them.
    """
    return mixing.mix_texts(docs, qualities(read(spark, sf_dir, "labels"))).where("taken > 0")


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pseudonymize", pseudonymize), ("mix", mix)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again; what a stage has read is deleted."""
    docs = before = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, before, sf_dir), f"pipeline-{name}")
        if hasattr(before, "staged_path"):
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
