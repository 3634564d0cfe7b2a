"""Corpus pipeline: the stages that turn ``documents`` into packed training sequences, each a DataFrame job.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the columns
of ``docs``; extra columns pass through. Null and empty texts pass the middle stages unchanged. Repeated rows of one id are
one document: near-dedup keeps all of them or none, and packing packs each for itself; of ties between documents the
smallest id stays. Empty tables give empty results. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.llm import decontaminate, language_id, near_dedup, packing, secret_scan
from gritstone.llm.store import Scratch

#: Ids up to which the documents to drop are sent to every task; beyond, both sides are shuffled.
MAX_SENT_IDS = near_dedup.MAX_SENT_IDS


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without text or letters go."""
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    return language_id.predict(docs, model).where(F.col("lang_pred") != language_id.UNDETERMINED).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates; rows with a null id are in no group."""
    found = near_dedup.near_duplicates(docs.select("doc_id", "text"))
    gone = Scratch(spark, "dropped").keep(found.where("not kept and doc_id is not null").select("doc_id").distinct(), "ids")
    gone = F.broadcast(gone) if gone.count() <= MAX_SENT_IDS else gone
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark passages."""
    found = decontaminate.find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~decontaminate.is_contaminated()).select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with each secret in its text replaced by a mark and n_chars counted anew."""
    net = secret_scan.fit(docs.select("doc_id", "text"))
    clean = secret_scan.redact(docs, net)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences: place, token ids and their checksum."""
    pieces = packing.pack_documents(docs, packing.default_tokenizer())
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("packing", pack),
]
#: The stages train models and pack tokens, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each written to the shared scratch folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
