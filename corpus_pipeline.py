"""From raw documents to token ids in five stages.

Every stage works on all rows the stage before it kept, and all but the last return the
columns of documents. Null and empty texts go in the first stage, as they fail its base rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.llm import secrets
from tickframe.llm.bpe import digests, encode
from tickframe.llm.common import table
from tickframe.llm.neardup import drop_near_duplicates, written
from tickframe.llm.queries import TOKENIZER
from tickframe.llm.repetition import drop_repetitive
from tickframe.llm.tiling import drop_contaminated
from tickframe.session import configure


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose text is too short or mostly repeats itself."""
    return drop_repetitive(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each class of near-duplicates."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose tiles cover half of a benchmark item or more."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mask; n_chars follows."""
    masked = secrets.redact(docs, *secrets.fit(docs))
    if "n_chars" not in docs.columns:
        return masked
    size = F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)
    return masked.withColumn("n_chars", size)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the decoded text."""
    encoded = encode(docs.select("doc_id", "lang", "source", "text"), TOKENIZER, decoded_col="decoded")
    return encoded.select("doc_id", "lang", "source", "ids", *digests())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("bpe", bpe),
]

#: Candidate search, forest and merging are not SQL: a test runs brute-force stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    configure(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
