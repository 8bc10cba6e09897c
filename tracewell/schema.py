"""The tables of a transcript store and their columns, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

#: Version of the meaning of rows; a store of another version is refused.
FORMAT_VERSION = 1

_KINDS = {"string": StringType(), "timestamp": TimestampType(), "long": LongType(), "int": IntegerType(), "boolean": BooleanType(), "double": DoubleType()}


def _table(columns: str) -> StructType:
    """A flat schema; made without a session, as Python workers import this module, too."""
    return StructType([StructField(n, _KINDS[k]) for n, k in (c.split() for c in columns.split(", "))])


SESSIONS = _table(
    "session_id string, file_path string, source string, project_dir string, cwd string, git_branch string, cc_version string, entrypoint string, "
    "started_at timestamp, ended_at timestamp, n_events long, n_tool_calls long, input_tokens long, output_tokens long, cache_read_tokens long, cache_creation_tokens long"
)
EVENTS = _table(
    "event_id string, session_id string, file_path string, source string, seq long, ts timestamp, type string, role string, parent_uuid string, depth int, "
    "is_sidechain boolean, is_meta boolean, permission_mode string, effort string, request_id string, message_id string, model string, cwd string, git_branch string, text string, raw string"
)
TOOL_CALLS = _table(
    "tool_use_id string, session_id string, file_path string, source string, seq long, ts timestamp, call_event_id string, result_event_id string, tool_name string, tool_kind string, "
    "mcp_server string, input string, input_summary string, outcome string, is_error boolean, result_text string, result_truncated boolean, duration_ms long, permission_mode string, "
    "denied_by string, denial_reason string, cwd string, is_sidechain boolean, parent_tool_use_id string"
)
RECALL_CALLS = _table(
    "recall_id string, session_id string, file_path string, source string, seq long, ts timestamp, call_id string, query string, output string, output_truncated boolean, "
    "followup_text string, followup_truncated boolean, overlap_tokens string, overlap_count long"
)
SOURCE_FILES = _table("file_path string, size_bytes long, mtime double, content_hash string, n_events long, n_tool_calls long, n_parse_errors long, built_at timestamp")

TABLES: dict[str, StructType] = {"sessions": SESSIONS, "events": EVENTS, "tool_calls": TOOL_CALLS, "recall_calls": RECALL_CALLS, "source_files": SOURCE_FILES}
SOURCES = ("claude_code", "opencode", "cursor", "codex", "claude_ai")


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns of ``schema`` in order; what ``df`` lacks is null."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])
