"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.pandas.types import to_arrow_schema

#: About how much of an Arrow batch is held as Python objects at a time.
PART_BYTES = 6_000_000
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def map_rows(df: DataFrame, make: Callable[[], Callable[[list[list]], list[list]]], schema: str) -> DataFrame:
    """Run a column-wise Python function over Arrow batches.

    ``make()`` is called once per task on the worker and returns a function from
    a list of input columns (Python lists) to a list of output columns, so heavy
    tables are built on the executor and never travel with the closure.
    """
    target = StructType.fromDDL(schema)
    arrow = to_arrow_schema(target)
    owner = make.__module__
    batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(owner)
        fn = make()
        for batch in batches:
            rows = max(1, batch.num_rows * PART_BYTES // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, rows):
                columns = fn([c.to_pylist() for c in batch.slice(at, rows).columns])
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, target)


def batches(spark: SparkSession) -> None:
    """Rows may hold whole texts, so Arrow batches are kept to 1,000 of them, unless the session asks for another number than Spark's default."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, "1000")


_HELD: dict[str, Callable[[], None]] = {}


def hold(owner: str, drop: Callable[[], None] | None = None) -> None:
    """Tell that ``owner`` works in this process now; ``drop`` frees what it keeps between tasks.

    A worker process serves one operator after the other, so what the others keep goes.
    """
    others = [k for k in _HELD if k != owner]
    for k in others:
        _HELD.pop(k)()
    if drop is not None:
        _HELD[owner] = drop
    if others:
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)  # give free pages back, where the C library can


def shared_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints and for tables that stages write and read again.

    The cluster names it in ``spark.checkpoint.dir``. One is made here only where that is unset and
    Spark runs in this process alone (tests); on a cluster without it, this raises.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="tracewell-ckpt-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


@contextlib.contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is made and run inside go when the run ends.

    They would lie there until the driver happens to collect its garbage. Nothing that is read
    again may be made inside: a second run of it would have to make its shuffles anew.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through the reliable checkpoint folder; the shuffle files that led there go."""
    shared_folder(df.sparkSession)
    with freeing(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def local_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small DataFrame from rows at hand, by way of Arrow, which starts no Python workers."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    columns = list(zip(*rows)) if rows else [[] for _ in arrow]
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow), StructType.fromDDL(schema))


def word_count(text: str) -> F.Column:
    """Number of words of a text column (null: 0), without building the words."""
    gaps = F.regexp_replace(F.col(text), WORD, "\u0001")
    return F.coalesce(F.length(F.translate(gaps, " \t\n\u000b\f\r", "")).cast("long"), F.lit(0).cast("long"))


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def hex_draw(*parts: Column | str, digits: int = 13) -> Column:
    """A whole number below 16 ** digits, drawn by MD5 from the parts (null: empty) and a bar after each."""
    said = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat(*[x for p in said for x in (p, F.lit("|"))])), 1, digits), 16, 10).cast("long")


def rank_within(df: DataFrame, group: str, order: list[str], out: str, partitions: int | None = None) -> DataFrame:
    """Add ``out``: the 0-based position of each row among the rows of its group.

    A window over the group would put a hot group into one task. Here the rows
    are range-partitioned by (group, *order), numbered inside their partition,
    and shifted by what earlier partitions hold of the same group. Only counts
    for each (partition, group) meet, at most partitions + groups of them.
    ``order`` must make rows distinct for a repeatable numbering; rows that tie in
    every column are interchangeable. The rows are cut through the checkpoint folder
    before, as range bounds are sampled from them, and numbered, as bounds must not be redrawn.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_last() for c in (group, *order)]
    placed = cut(df).repartitionByRange(n, *by).sortWithinPartitions(*by)
    placed = cut(placed.withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumn("__pid", F.shiftright(F.col("__at"), 33))
    parts = placed.groupBy("__pid", F.col(group).alias("__group")).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy("__group").orderBy("__pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select(F.col("__pid").alias("__part"), "__group", "__first", before.alias("__before"))
    joined = placed.join(starts, (placed["__pid"] == starts["__part"]) & placed[group].eqNullSafe(starts["__group"]))
    return joined.select(*[placed[c] for c in df.columns], (placed["__at"] - F.col("__first") + F.col("__before")).alias(out))
