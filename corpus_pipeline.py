"""A training-corpus pipeline: each stage reads its predecessor's rows and returns those it keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrymill.llm import decontamination, langid, packing, simhash, toxicity
from quarrymill.plans.storage import stored


#: The languages that stay (None: all that are learned), and the least posterior of a text's language.
LANGUAGES, LEAST_SCORE = None, 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in one of LANGUAGES with a posterior of at least LEAST_SCORE.

    Null, empty and letterless texts go.  Repeated rows and null ids are judged
    by their texts; an empty table stays empty.  Where no language can be
    learned, texts with a letter stay.
    """
    return langid.with_language(docs, languages=LANGUAGES, least=LEAST_SCORE)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose toxicity score is under 0.5.

    Null and empty texts have the bias's score, so they stay unless most learned
    texts are toxic.  Repeated rows and null ids are judged by their texts.
    Without labels every score is 0.5 and nothing is known: all documents stay.
    """
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked fingerprints, the one of least id.

    Null, empty and blank texts are one group.  Rows are judged by their texts:
    unlinked texts under one id all stay, linked ones under a null id go.
    """
    return simhash.representatives(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the benchmark's windows don't contaminate.

    Null and empty texts and an empty benchmark contaminate nothing; repeated
    rows and null ids are judged by their texts.
    """
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' pieces, with a checksum of each piece's ids.

    Each row is a document of its own, also with a null or repeated id; a null
    or empty text is its end id alone; an empty table has no pieces.
    """
    packed = packing.pack_documents(docs)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language), ("toxicity", toxic), ("simhash_near_dedup", near_duplicates), ("benchmark_decontamination", benchmark), ("packing", pack)]

#: Models, hashes and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
