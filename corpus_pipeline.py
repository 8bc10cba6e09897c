"""A corpus from raw documents to token counts, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. ``run`` writes each stage's result as Parquet
to the shared folder and reads it again as the next one's input.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe, langid, minhash, mixing, pii
from tracewell.llm.common import cut, rank_within, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a language: those without text or letters go; a missing label is predicted.

    With no labelled rows to learn from, all documents with letters stay and labels stay as they are.
    """
    docs = docs.select(*COLUMNS)
    samples = langid.fit(docs, ~langid.held_out() & F.col("doc_id").isNotNull())
    if not samples:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.identify(docs, samples, keep=COLUMNS).where(F.col("lang_pred") != langid.UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def identified(docs: DataFrame) -> DataFrame:
    """The rows with an identity of their own, a whole number ``row_id``, in the order of doc_id, null last.

    It is doc_id where that tells all rows apart. Otherwise it is the row's place by doc_id and a
    hash of all columns; equal rows are numbered on.
    """
    docs = docs.select(*COLUMNS)
    if docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        return docs.withColumn("row_id", F.col("doc_id"))
    rows = docs.withColumns({"__all": F.lit(0), "__hash": F.xxhash64(*COLUMNS)})
    return rank_within(rows, "__all", ["doc_id", "__hash"], "row_id").select(*COLUMNS, "row_id")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id.

    Rows that share an id, or have none, are documents of their own, told apart by ``identified``.
    """
    docs = identified(docs)
    gone = cut(minhash.near_duplicates(docs, words=5, key="row_id").where("not kept").select(F.col("doc_id").alias("row_id")))
    small = gone.count() <= minhash.SMALL
    return docs.join(F.broadcast(gone) if small else gone, "row_id", "left_anti").select(*COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to pseudonyms."""
    done = pii.pseudonymise(docs.select(*COLUMNS), pii.secret(spark))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights; a document taken more than once stands there as often."""
    docs = identified(docs)
    taken = mixing.mix(docs, key="row_id").where("copies > 0").select(F.col("doc_id").alias("row_id"), "copies")
    both = docs.join(taken, "row_id")
    return both.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of their decoding."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(docs, path, public_tokenizers.PATTERN, limits=(250_000, 60_000))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("private", private), ("mix", mix), ("tokens", tokens)]
#: The stages are models, networks and transducers; they are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
