"""A corpus from raw documents to packed sequences: five stages, each over all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.llm import exact_dedup, packing, quality_knn, secrets, similar, simhash
from fluxloom.llm.common import Workspace, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the raw documents' labels, scores as quality."""
    voter = quality_knn.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_knn.score(docs, voter, keep=True)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of documents whose fingerprints are linked, and of these one of each group of texts with a five-word
    similarity of 0.8 or more, which fingerprints within 2 bits do not tell (README)."""
    return similar.one_of_each(simhash.one_of_each(docs))


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts replaced; all documents stay."""
    masked = secrets.mask_secrets(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' token sequences, and where each lies."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("secrets", mask), ("packing", pack)]

#: No SQL expresses the classifier, the fingerprints or the packing; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written and read again.

    Null texts are empty texts to all stages and stay null; null ids come last where a smallest id stays and first where
    the largest does; repeated rows are copies; columns of documents and any further ones, whatever their names, stay until
    the last stage. An empty table gives no rows.
    """
    ws = Workspace(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name)
        if before:
            ws.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
