"""Follow transcript folders: new and grown files flow into the store.

A grown file is read again whole, as a line's meaning depends on the lines around
it; so a stream of files feeds the same build as a batch does, and replacing a
file's rows makes a repeated batch harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import PATTERNS, Engine
from ..sources.lines import local_path

FILE = "path string, modificationTime timestamp, length long, content binary"


def watch(engine: Engine, source: str, folder: str, checkpoint: str, every: str = "30 seconds", once: bool = False) -> StreamingQuery:
    """A query that builds each batch of files of ``source`` under ``folder``."""
    spark = engine.spark
    found = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", PATTERNS[source]).option("recursiveFileLookup", "true").load(folder).select("path")

    def build(batch: DataFrame, _: int) -> None:
        paths = sorted(r[0] for r in batch.select(local_path(F.col("path"))).distinct().collect())  # names of the batch's files
        if paths:
            engine.build({source: paths})

    writer = found.writeStream.foreachBatch(build).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def counts_by_window(spark: SparkSession, lines: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, type, n) of a stream of raw lines, by the time that a line states; lines later than ``late`` are dropped."""
    text = F.get_json_object("value", "$.timestamp")
    rows = lines.select(F.try_to_timestamp(text).alias("ts"), F.get_json_object("value", "$.type").alias("type")).where("ts is not null")
    return rows.withWatermark("ts", late).groupBy(F.window("ts", width), "type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "type", "n")
