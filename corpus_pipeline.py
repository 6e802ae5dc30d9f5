"""From raw documents to a training mix, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, langid, minhash, mixing, quality
from tidemark.llm.storage import materialize, scratch, spare

#: Language predictions under this score are rejected, with texts in no language.
LEAST_LANGUAGE_SCORE = 0.3
LEAST_QUALITY = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the languages learned from the documents' own labels.

    Null texts and texts without a letter go.  If no label could be learned from,
    all texts are ``und`` and all go.
    """
    lang, score = spare(docs.columns, "lang_pred", "score")
    found = langid.identify(docs, langid.fit_languages(docs), names=(lang, score))
    return found.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose quality score is 0.3 or more; learned from ``labels``."""
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = spare(docs.columns, "score")
    return quality.score_quality(docs, model, name=score).where(F.col(score) >= LEAST_QUALITY).select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest id, of each group of near duplicates."""
    return minhash.drop_near_duplicates(docs, shingle_words=5, percent=80).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no benchmark item."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, a row each, in order of the first training position.

    ``positions`` has those of all copies; ``mixing.training_order`` of the result gives
    a row for each of them.
    """
    return mixing.plan_mix(docs).where(F.col("taken") > 0).orderBy("position", "doc_id")


STAGES = [
    ("language_id", language_stage),
    ("quality_classifier", quality_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: Trained classifiers decide in the first stages, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written as Parquet in the shared folder and read by the next.

    The result's table goes with the session, what was written before it at the end.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark):
        for name, stage in STAGES[:-1]:
            docs = materialize(stage(spark, docs, sf_dir), name)
        name, stage = STAGES[-1]
        return materialize(stage(spark, docs, sf_dir), name, keep=True)
