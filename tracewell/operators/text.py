"""Prose and terms of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import strip

# Blocks that tools put into prompts, and words too short to tell anything.
HARNESS = r"(?s)<(command-[a-z-]+|local-command-[a-z-]+|bash-[a-z-]+|system-reminder|task-notification)(?:\s[^>]*)?>.*?</\1>"
CURSOR_TAGS = ("user_info", "rules", "agent_skills", "agent_transcripts", "timestamp", "attached_files", "manually_attached_skills", "cursor_commands", "system_reminder")
CODEX_TAGS = ("environment_context", "recommended_plugins", "codex_internal_context")
SHORT = (
    "the and for not you are but was has had his her him she its our who why how can may did "
    "all any nor yet too via per etc one two now see say got own few yes ago don isn won"
).split()
QUERY = r"(?s)<user_query(?:\s[^>]*)?>((?:(?!<user_query(?:\s|>)).)*?)</user_query>"
TOKEN = r"(?<![A-Za-z0-9_.-])[A-Za-z]{2,3}(?![A-Za-z0-9_-]|\.[A-Za-z0-9])|[A-Za-z][A-Za-z0-9_\-]{3,}|[ァ-ヴー]{3,}|[一-龥々]{2,}"
#: Runs of the characters that terms are made of: a term lies in a text if and only if it lies in one of its runs.
RUN = r"[a-z0-9_\-]{2,}|[ァ-ヴー]{3,}|[一-龥々]{2,}"
PIECE, WINDOW = 1024, 48
KEYS = (2, 3, 4, 6, 8, 12, 16, 24, 32, WINDOW)
UUID = "(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def without_harness(text: Column) -> Column:
    return F.regexp_replace(text, HARNESS, "")


def _without_tags(text: Column, tags: tuple[str, ...]) -> Column:
    """Whole blocks go, the innermost of nested ones of a tag; unclosed ones stay."""
    for t in tags:
        text = F.regexp_replace(text, rf"(?s)<{t}(?:\s[^>]*)?>(?:(?!<{t}(?:\s|>)).)*?</{t}>", "")
    return text


def human_prose(text: Column, source: Column) -> Column:
    """What the person wrote."""
    bare = without_harness(F.coalesce(text, F.lit("")))
    asked = F.regexp_extract_all(bare, F.lit(QUERY), F.lit(1))
    queries = F.array_join(F.filter(F.transform(asked, lambda x: strip(without_harness(x))), lambda x: x != ""), "\n")
    cursor = F.when(F.size(asked) > 0, queries).otherwise(strip(_without_tags(bare, CURSOR_TAGS)))
    return F.when(source == "cursor", cursor).when(source == "codex", strip(_without_tags(bare, CODEX_TAGS))).otherwise(strip(bare))


def tokens(text: Column) -> Column:
    """Terms in order, lower-cased; ids, and short words that are common or not upper case, are left out."""
    found = F.regexp_extract_all(F.regexp_replace(text, UUID, " "), F.lit(TOKEN), F.lit(0))

    def keep(t: Column) -> Column:
        low, n = F.lower(t), F.length(t)
        latin = t.rlike("^[A-Za-z]+$")
        short = (latin & (n == 2) & (F.upper(t) != t)) | (latin & (n == 3) & low.isin(*SHORT))
        ids = low.contains("_") | low.rlike("^[0-9a-f]{7,}$|[0-9a-f]{8}-") | (low.rlike("^[a-z0-9]+$") & low.rlike("[0-9]"))
        return ~short & ~ids

    return F.transform(F.filter(found, keep), F.lower)


def compaction_summary(raw: Column) -> Column:
    """A record whose own ``isCompactSummary`` is the literal true."""
    at = F.variant_get(F.try_parse_json(raw), "$.isCompactSummary", "variant")
    yes = (F.schema_of_variant(at) == "BOOLEAN") & F.try_variant_get(F.try_parse_json(raw), "$.isCompactSummary", "boolean")
    return F.when(F.coalesce(raw.contains('"isCompactSummary"'), F.lit(False)), F.coalesce(yes, F.lit(False))).otherwise(False)


def headless(entrypoint: Column) -> Column:
    return F.coalesce(entrypoint.startswith("sdk"), F.lit(False))


def spoken_rows(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows of people and assistants with their session; by file, since a session id fans out over files."""
    s = sessions.select("file_path", F.col("session_id").alias("sid"), "started_at", "project_dir", "n_tool_calls", "entrypoint", F.col("source").alias("src"))
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    tool = (F.col("role") == "user") & F.coalesce(F.col("raw").contains('"tool_result"'), F.lit(False))
    rows = events.where(F.col("role").isin("user", "assistant") & no("is_meta") & no("is_sidechain") & ~tool)
    return rows.select("file_path", "session_id", "event_id", "seq", "ts", "role", "text", "raw").join(s, "file_path")


def session_prose(events: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions with prose, and their terms ``(file_path, term, tf)``."""
    rows = spoken_rows(events, sessions).where(~((F.col("role") == "user") & compaction_summary(F.col("raw"))))
    prose = F.when(F.col("role") == "user", human_prose(F.col("text"), F.col("src"))).otherwise(F.coalesce("text", F.lit("")))
    rows = rows.withColumn("prose", prose).where(strip(F.col("prose")) != "").withColumn("terms", tokens(F.col("prose")))
    said = F.when(F.col("role") == "user", F.struct("seq", F.substring(strip(F.regexp_replace("prose", r"(?U)\s+", " ")), 1, 160).alias("t")))
    own = rows.groupBy("file_path").agg(
        *[F.first(c).alias(c) for c in ("sid", "started_at", "project_dir", "n_tool_calls", "entrypoint", "src")],
        F.coalesce(F.sum(F.when(F.col("role") == "user", F.length("prose"))), F.lit(0)).alias("human_chars"),
        F.coalesce(F.min(said)["t"], F.lit("")).alias("first_utterance"),
        F.sum(F.size("terms")).alias("total_terms"),
    )
    terms = rows.select("file_path", F.explode("terms").alias("term")).groupBy("file_path", "term").agg(F.count("*").alias("tf"))
    return own.withColumnsRenamed({"sid": "session_id", "src": "source"}), terms


def document_frequency(terms: DataFrame) -> DataFrame:
    """In how many sessions a term occurs, over all of them."""
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def idf(sessions_with_prose: DataFrame, terms: DataFrame, most: float = 0.3) -> DataFrame:
    """``ln((N+1)/(df+1))``; terms in more than ``most`` of the sessions are left out. The count meets the terms as one row."""
    n = sessions_with_prose.agg(F.count("*").alias("n"))
    df = document_frequency(terms).crossJoin(F.broadcast(n))
    return df.where(F.col("df") <= F.col("n") * most).select("term", F.log((F.col("n") + 1) / (F.col("df") + 1)).alias("idf"))


def contained(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """The distinct terms (as ``tokens`` makes them) that some text contains, also inside a longer word.

    Terms and places of the texts meet on the first characters, as many as the
    longest of ``KEYS`` that a term has, so this is an equality join; what
    follows is compared after it. Runs are cut into pieces that overlap by a window,
    and terms longer than a window are looked for in the whole run.
    """
    runs = texts.select(F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run")).distinct().withColumn("of", F.xxhash64("run"))
    pieces = runs.withColumn("at", F.explode(F.sequence(F.lit(0), F.floor((F.length("run") - 1) / PIECE).cast("int"))))
    pieces = pieces.select("of", F.substring("run", F.col("at") * PIECE + 1, F.lit(PIECE + WINDOW - 1)).alias("piece"))
    places = pieces.select("of", "piece", F.explode(F.sequence(F.lit(1), F.least(F.lit(PIECE), F.length("piece")))).alias("at")).select("of", F.substring("piece", F.col("at"), F.lit(WINDOW)).alias("seen"))
    n = F.length("term")
    longest = F.array_max(F.filter(F.array(*map(F.lit, KEYS)), lambda k: k <= n))
    keyed = terms.withColumn("key", F.substring("term", F.lit(1), longest))
    short, long_ = keyed.where(n <= WINDOW), keyed.where(n > WINDOW)
    seen = places.select("seen").distinct()
    fits = F.filter(F.array(*map(F.lit, KEYS)), lambda k: k <= F.length("seen"))
    keys = seen.select("seen", F.explode(fits).alias("k")).select("seen", F.substring("seen", F.lit(1), F.col("k")).alias("key"))
    found = short.join(keys, (short["key"] == keys["key"]) & F.startswith("seen", "term"), "left_semi").select("term")
    begun = long_.join(places.distinct(), F.col("key") == F.col("seen")).select("term", "of").join(runs, "of")
    return found.union(begun.where(F.contains("run", "term")).select("term").distinct())


def orphans(events: DataFrame, sessions: DataFrame, sinks: DataFrame | None = None, since=None, until=None, min_tf: int = 3, min_human_chars: int = 800, min_orphans: int = 3, include_headless: bool = False, reviewed: list[str] | None = None, show_reviewed: bool = False, limit: int = 20, top: int = 10) -> DataFrame:
    """Sessions with terms that no other session and no sink text has, densest first.

    Document frequency covers everything; windows and reviews narrow nominations only.
    """
    from ..functions.columns import in_window

    own, terms = session_prose(events, sessions)
    unique = terms.join(document_frequency(terms).where("df = 1"), "term").where(F.col("tf") >= min_tf)
    if sinks is not None:
        held = contained(unique.select("term").distinct(), sinks).withColumn("held", F.lit(True))
        unique = unique.join(held, "term", "left").withColumn("orphan", F.col("held").isNull())
    else:
        unique = unique.withColumn("orphan", F.lit(True))
    w = W.partitionBy("file_path").orderBy(F.desc("orphan"), F.desc("tf"), "term")
    ranked = unique.withColumn("n", F.row_number().over(w))
    shown = F.collect_list(F.when(F.col("orphan") & (F.col("n") <= top), F.struct("n", "term")))
    stats = ranked.groupBy("file_path").agg(F.count("*").alias("n_unique"), F.sum(F.col("orphan").cast("long")).alias("n_orphan"), F.transform(F.array_sort(shown), lambda x: x["term"]).alias("orphan_terms"))
    keep = (F.col("human_chars") >= min_human_chars) & in_window(F.col("started_at"), since, until)
    if not include_headless:
        keep = keep & ~headless(F.col("entrypoint"))
    out = own.where(keep).join(stats.where((F.col("n_orphan") > 0) & (F.col("n_orphan") >= min_orphans)), "file_path")
    seen = F.coalesce(F.col("session_id").isin(*(reviewed or [])), F.lit(False)) if reviewed else F.lit(False)
    out = out.withColumns({"orphan_density": F.when(F.col("total_terms") == 0, 0.0).otherwise(F.col("n_orphan") / F.col("total_terms") * 1000), "reviewed": seen})
    out = out if show_reviewed else out.where("not reviewed")
    out = out.orderBy(F.desc("orphan_density"), F.desc("n_orphan"), F.desc("human_chars"), F.coalesce("session_id", F.lit("")), "file_path")
    out = out.select("session_id", "file_path", "started_at", "project_dir", "n_tool_calls", "human_chars", "n_unique", "n_orphan", "total_terms", "orphan_density", "orphan_terms", "first_utterance", "reviewed")
    return out.limit(limit) if limit else out
