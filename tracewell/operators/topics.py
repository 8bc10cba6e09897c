"""Topic segments of sessions: exchanges, term vectors, and gaps where the talk turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import format_ts, strip
from .order import exchanges as number
from .order import first_of
from .text import compaction_summary, human_prose, spoken_rows, tokens


def exchanges(events: DataFrame, sessions: DataFrame, session: str | None = None) -> DataFrame:
    """(session_id, exchange, seq, first_ts, last_ts, human, text): what a person said and the answers to it.
    A record met again under its uuid counts once, where it came first."""
    rows = spoken_rows(events, sessions).where(~((F.col("role") == "user") & compaction_summary(F.col("raw"))))
    rows = rows.where(F.col("session_id") == session) if session else rows.where("session_id is not null")
    uuid = F.coalesce(F.nullif(F.get_json_object("raw", "$.uuid"), F.lit("")), F.col("event_id"))
    rows = first_of(rows.withColumn("uuid", uuid), ["session_id", "uuid"], ["file_path", "seq"])
    rows = rows.withColumn("said", F.when(F.col("role") == "user", human_prose(F.col("text"), F.col("src"))).otherwise(F.coalesce("text", F.lit("")))).where("said <> ''")
    human = F.col("role") == "user"
    at = number(rows, ["session_id"], ["file_path", "seq"], human, F.col("role") == "assistant")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("file_path", "seq", "said"))), lambda x: x["said"])
    own = at.groupBy("session_id", "exchange").agg(F.min(F.struct("file_path", "seq", "ts", "said")).alias("h"), F.array_join(parts, "\n").alias("text"))
    return own.select("session_id", "exchange", F.col("h.seq").alias("seq"), F.col("h.ts").alias("ts"), F.col("h.said").alias("human"), "text")


def vectors(exchanges_: DataFrame, idf: DataFrame) -> DataFrame:
    """(session_id, exchange, term, weight) with weight tf*idf, zero weights left out."""
    terms = exchanges_.select("session_id", "exchange", F.explode(tokens(F.col("text"))).alias("term")).groupBy("session_id", "exchange", "term").agg(F.count("*").alias("tf"))
    return terms.join(idf, "term").select("session_id", "exchange", "term", (F.col("tf") * F.col("idf")).alias("weight")).where("weight <> 0")


def similarities(exchanges_: DataFrame, vectors_: DataFrame, window: int = 3) -> DataFrame:
    """(session_id, gap, n, similarity): cosine of the ``window`` exchanges before and after each gap; gap g lies before exchange g."""
    n = exchanges_.groupBy("session_id").agg(F.count("*").alias("n"))
    gaps = n.where("n > 1").select("session_id", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") - 1)).alias("gap"))
    spread = vectors_.select("session_id", "exchange", "term", "weight", F.explode(F.sequence(F.col("exchange") - window + 1, F.col("exchange") + window)).alias("gap"))
    side = F.col("exchange") < F.col("gap")
    sums = spread.groupBy("session_id", "gap", "term").agg(F.coalesce(F.sum(F.when(side, F.col("weight"))), F.lit(0.0)).alias("b"), F.coalesce(F.sum(F.when(~side, F.col("weight"))), F.lit(0.0)).alias("a"))
    cos = sums.groupBy("session_id", "gap").agg(F.sum(F.col("a") * F.col("b")).alias("dot"), F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("na"), F.sqrt(F.sum(F.col("b") * F.col("b"))).alias("nb"))
    value = F.when((F.col("na") > 0) & (F.col("nb") > 0), F.col("dot") / (F.col("na") * F.col("nb")))
    return gaps.join(cos, ["session_id", "gap"], "left").select("session_id", "gap", "n", F.coalesce(value, F.lit(0.0)).alias("similarity"))


def boundaries(sims: DataFrame, window: int = 3) -> DataFrame:
    """Gaps that are local minima half a deviation under the mean, with a full window on both sides."""
    all_ = W.partitionBy("session_id")
    order = all_.orderBy("gap")
    s = F.col("similarity")
    w = sims.withColumns({"p": F.lag("similarity").over(order), "q": F.lead("similarity").over(order), "limit": F.avg("similarity").over(all_) - 0.5 * F.stddev_pop("similarity").over(all_)})
    full = (F.col("n") >= 2 * window) & (F.col("gap") >= window) & (F.col("gap") <= F.col("n") - window)
    return w.where(full & (s < F.col("p")) & (s < F.col("q")) & (s < F.col("limit"))).select("session_id", "gap")


def segments(exchanges_: DataFrame, vectors_: DataFrame, bounds: DataFrame, terms: int = 8, opening: int = 160) -> DataFrame:
    """(session_id, start, end, start_ts, end_ts, n_exchanges, terms, opening)."""
    starts = bounds.select("session_id", F.col("gap").alias("exchange"), F.lit(1).alias("cut"))
    w = W.partitionBy("session_id").orderBy("exchange").rowsBetween(W.unboundedPreceding, 0)
    placed = exchanges_.join(starts, ["session_id", "exchange"], "left").withColumn("segment", F.coalesce(F.sum("cut").over(w), F.lit(0)))
    first = F.min(F.struct("exchange", "ts", "human"))
    own = placed.groupBy("session_id", "segment").agg(first.alias("f"), F.max(F.struct("exchange", "ts")).alias("l"), F.count("*").alias("n_exchanges"))
    weights = vectors_.join(placed.select("session_id", "exchange", "segment"), ["session_id", "exchange"]).groupBy("session_id", "segment", "term").agg(F.sum("weight").alias("weight"))
    rank = F.row_number().over(W.partitionBy("session_id", "segment").orderBy(F.desc("weight"), "term"))
    best = weights.withColumn("n", rank).where(F.col("n") <= terms).groupBy("session_id", "segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "term"))), lambda x: x["term"]).alias("terms"))
    out = own.join(best, ["session_id", "segment"], "left")
    head = F.substring(strip(F.regexp_replace(F.col("f.human"), r"(?U)\s+", " ")), 1, opening)
    return out.select("session_id", F.col("f.exchange").alias("start"), F.col("l.exchange").alias("end"), format_ts(F.col("f.ts")).alias("start_ts"), format_ts(F.col("l.ts")).alias("end_ts"), "n_exchanges", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"), head.alias("opening"))


def titles(events: DataFrame) -> DataFrame:
    """(session_id, title, title_kind): the latest custom title, else the latest one made by a model."""
    pick = F.coalesce(*[F.nullif(strip(F.get_json_object("raw", f"$.{k}")), F.lit("")) for k in ("title", "aiTitle", "text")])
    rows = events.where(F.col("type").isin("custom-title", "ai-title")).withColumn("title", pick).where("title is not null")
    order = F.struct((F.col("type") == "custom-title").alias("c"), "file_path", "seq")
    return rows.groupBy("session_id").agg(F.max_by("title", order).alias("title"), F.max_by("type", order).alias("title_kind"))
