"""The corpus pipeline: documents through five training-data operators, each stage written as Parquet and read again.

doc_id names a document: where several rows bear one doc_id, a stage that drops documents keeps or drops them together, and rows
without doc_id are never dropped for another document's sake. Extra columns pass through to the last stage, whatever their names.
Null and empty texts are scored as empty ones, have no near duplicates and hold no benchmark item; their last row has no ids. Of
equal texts the smallest doc_id stays. Empty tables give no rows, and without labels every document has the score 0.5 and stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corduroy.llm.common import materialize, scratch, table
from corduroy.llm.decontaminate import contaminated
from corduroy.llm.near import near_groups
from corduroy.llm.pieces import digest_pieces
from corduroy.llm.pii import KEY, pseudonymise
from corduroy.llm.quality import THRESHOLD, quality_model, score_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; learnt from the labels outside the held-out fifth."""
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    score = "_" * (1 + max(map(len, docs.columns))) + "score"  # longer than any column's name
    return score_quality(docs, model, keep=docs.columns, name=score).where(F.col(score) >= THRESHOLD).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of every group of near duplicates: five-word shingles alike by 80 % or more."""
    path = scratch(spark, "near")
    groups = near_groups(docs, path)
    gone = groups.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("NOT kept").select("doc_id")
    return docs.join(materialize(gone, f"{path}/gone"), "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, neither copied nor re-parameterised."""
    path = scratch(spark, "decontamination")
    found = contaminated(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"), path)
    return docs.join(materialize(found.select("doc_id").distinct(), f"{path}/gone"), "doc_id", "left_anti").select(*docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms for personal data; n_chars follows the text."""
    out = pseudonymise(docs, KEY, counts=False)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its number of pieces and the digests of ids and decoded text."""
    import public_tokenizers

    return digest_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", pii), ("sentencepiece", sentencepiece)]

#: The quality network, the near-duplicate components and the pseudonyms have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs, path = table(spark, sf_dir, "documents"), scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"{path}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
