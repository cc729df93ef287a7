"""Write events: JSON payloads as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "session_id string, tool_name string, cwd string, "
    "tool_input struct<file_path: string, content: string, old_string: string, new_string: string, edits: array<struct<old_string: string, new_string: string>>>"
)
TOOLS = ["Edit", "MultiEdit", "Write"]


def payloads(events: DataFrame, value: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The payloads of the tools that write, with the events' columns to keep; what doesn't parse yields nothing."""
    own = events.select(*keep, F.from_json(F.col("value") if value is None else value, SCHEMA).alias("p")).select(*keep, "p.*")
    return own.filter(F.col("tool_name").isin(TOOLS))


def writes(payload: DataFrame) -> DataFrame:
    """A row for each payload: write (an id), session, cwd, path, whole (a Write is the whole file) and edits, an array of old and
    new, the one at the payload's top first. write is taken from the payload if it has such a column."""
    pair = lambda e: F.struct(F.coalesce(e["old_string"], F.lit("")).alias("old"), F.coalesce(e["new_string"], F.lit("")).alias("new"))
    more = F.coalesce("tool_input.edits", F.array().cast("array<struct<old_string: string, new_string: string>>"))
    own = F.concat(F.array(pair(F.col("tool_input"))), F.transform(more, pair))
    name = F.col("write") if "write" in payload.columns else F.monotonically_increasing_id().alias("write")
    cwd = F.coalesce("cwd", F.lit("")).alias("cwd")
    return payload.select(name, F.coalesce("session_id", F.lit("")).alias("session"), cwd, F.col("tool_input.file_path").alias("path"), (F.col("tool_name") == "Write").alias("whole"), own.alias("edits"))


def edits(payload: DataFrame) -> DataFrame:
    """One row for each edit of a payload, the one at its top first: at, old and new. Edits that write nothing go."""
    top = F.struct(F.col("tool_input.old_string").alias("old_string"), F.col("tool_input.new_string").alias("new_string"))
    all_ = F.concat(F.array(top), F.coalesce("tool_input.edits", F.array().cast("array<struct<old_string: string, new_string: string>>")))
    own = payload.select("session_id", F.col("tool_input.file_path").alias("path"), F.posexplode(all_).alias("at", "e"))
    return own.select("session_id", "path", "at", F.coalesce("e.old_string", F.lit("")).alias("old"), F.col("e.new_string").alias("new")).filter(F.coalesce("new", F.lit("")) != "")
