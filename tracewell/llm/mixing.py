"""Mixing sources to target weights by systematic sampling (operator 7).

A source of ``S`` words with target ``T`` gives each of its documents ``T / S``
expected copies. These are prefix-summed within the source, one random offset is
added, and a document is emitted once for each integer boundary that its part of
the sum crosses. Documents stand in order of size, so what is taken has the
source's mix of sizes and its words come within about one large document of the
target. The order is completed by a seeded hash and the key, so reruns agree.

Targets share the total by weight; a target stops at ``cap`` times its source's
words, and the excess is shared again by weight among the others. A round of that is
one aggregate over the table of sources, which stays distributed: tables of hosts may
have as many sources as rows.

Results for odd input: null or empty texts have size 0 and may be taken like
others; null sources form one source, last in order; a source without words has
target 0 and takes nothing; rows may share a key, a source's name and size (they tie,
and are interchangeable) or have no key; texts are counted whole; other columns
are left behind; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, hex_draw, rank_within, read, word_count

CAP = 3.0


def cycle_weights(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, repeating, by code point of ``source``, null last."""
    ranked = rank_within(sources.withColumn("__all", F.lit(0)), "__all", ["source"], "__nth").drop("__all")
    return ranked.withColumn("weight", (F.col("__nth") % 3 + 1).cast("double")).drop("__nth")


def targets(sources: DataFrame, cap: float = CAP) -> DataFrame:
    """``sources`` (source_size, weight) with ``target``, the words that each shall give."""
    sums = lambda on: sources.agg(F.sum(F.when(on, cap * F.col("source_size"))), F.sum(F.when(~on, F.col("weight"))), F.count(F.when(on, 1))).first()
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    left, weight, full = total, float(sources.agg(F.sum("weight")).first()[0] or 1), 0
    over = lambda: F.lit(left) * F.col("weight") / F.lit(weight) > cap * F.col("source_size")
    while True:  # the share of a weight only grows, so full sources stay full
        given, open_, count = sums(over())
        if count == full or not open_:
            break
        left, weight, full = total - float(given or 0), float(open_), count
    return sources.withColumn("target", F.when(over(), cap * F.col("source_size")).otherwise(F.lit(left) * F.col("weight") / F.lit(weight)))


def mix(docs: DataFrame, weights=cycle_weights, cap: float = CAP, seed: int = 7, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies.

    ``weights`` adds ``weight``, a positive double, to a table with one row for each ``source``.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(text).alias("size"))
    placed = rank_within(rows.withColumn("mix", hex_draw(str(seed), F.col("doc_id"), digits=15)), "source", ["size", "mix", "doc_id"], "nth")
    table = cut(weights(cut(placed.groupBy("source").agg(F.sum("size").alias("source_size")))))
    table = targets(table, cap).withColumnRenamed("source", "name")
    joined = placed.join(table, placed["source"].eqNullSafe(table["name"]))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = hex_draw(str(seed), "offset", F.col("source")) * F.lit(2.0**-52)
    crossed = F.floor((F.col("nth") + 1) * F.col("rate") + offset) - F.floor(F.col("nth") * F.col("rate") + offset)
    return joined.withColumn("rate", rate).select("doc_id", "source", "size", "source_size", "target", crossed.cast("long").alias("copies"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mix(read(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
