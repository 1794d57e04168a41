"""JSON-RPC message lines: parse, classify, dispatch, correlate; batch and streaming alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Methods of the agent and of its client.
AGENT_METHODS = ("initialize", "authenticate", "session/new", "session/load", "session/prompt", "session/cancel", "session/set_mode")
CLIENT_METHODS = ("session/update", "session/request_permission", "fs/read_text_file", "fs/write_text_file", "terminal/create", "terminal/output", "terminal/release", "terminal/wait_for_exit", "terminal/kill")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the lines of text files that arrive below ``path``."""
    return spark.readStream.text(path)


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """Messages with their kind; blank, broken and unknown lines are dropped, the stream goes on.

    A result or an error makes a response, an id and a method a request, a method alone a
    notification.  Ids are text, so 1 and "1" are one id.
    """
    field = lambda k: F.get_json_object(F.col(column), f"$.{k}").alias(k)
    valid = F.try_parse_json(F.col(column)).isNotNull() & F.ltrim(F.col(column)).startswith("{")
    rows = lines.where(valid).select("*", *map(field, ("id", "method", "params", "result", "error")))
    kind = F.when(F.col("result").isNotNull() | F.col("error").isNotNull(), "response").when(F.col("id").isNotNull() & F.col("method").isNotNull(), "request").when(F.col("method").isNotNull(), "notification")
    return rows.withColumn("kind", kind).where("kind is not null")


def dispatch(messages: DataFrame) -> DataFrame:
    """Which side handles each method."""
    side = F.when(F.col("method").isin(*AGENT_METHODS), "agent").when(F.col("method").isin(*CLIENT_METHODS), "client").otherwise("unknown")
    return messages.withColumn("side", F.when(F.col("method").isNotNull(), side))


def correlate(requests: DataFrame, responses: DataFrame, timeout: str = "5 minutes") -> DataFrame:
    """Requests(id, method, ts) with the responses(id, result, error, ts) that come within the timeout; others are dropped.

    With watermarks on both sides this is a stream-stream join whose state ends with the timeout.
    """
    left = requests.select("id", "method", F.col("ts").alias("sent")).withWatermark("sent", timeout)
    right = responses.select(F.col("id").alias("r_id"), "result", "error", F.col("ts").alias("answered")).withWatermark("answered", timeout)
    in_time = (left["id"] == right["r_id"]) & (F.col("answered") >= F.col("sent")) & (F.col("answered") <= F.col("sent") + F.expr(f"interval {timeout}"))
    return left.join(right, in_time).drop("r_id")


def to_lines(rows: DataFrame) -> DataFrame:
    """(value): a JSON line for each row, null fields left out."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "true"}).alias("value"))


#: The kinds of session updates.
UPDATES = ("user_message_chunk", "agent_message_chunk", "agent_thought_chunk", "tool_call", "tool_call_update", "plan", "available_commands_update", "current_mode_update")


def session_updates(messages: DataFrame) -> DataFrame:
    """The session updates among parsed messages: session_id, update, and what its kind carries (null otherwise).

    text of message and thought chunks; tool_call_id, title and status of tool calls and their
    updates; n_entries of a plan or of available commands; mode_id of a mode.  Other kinds are
    dropped.
    """
    at = lambda path: F.get_json_object("params", f"$.{path}")
    kind = at("update.sessionUpdate")
    tool = F.col("update").isin("tool_call", "tool_call_update")
    entries = F.coalesce(F.when(F.col("update") == "plan", at("update.entries")), F.when(F.col("update") == "available_commands_update", at("update.availableCommands")))
    rows = messages.where(F.col("method") == "session/update").withColumn("update", kind).where(F.col("update").isin(*UPDATES))
    return rows.select(
        "*", at("sessionId").alias("session_id"), F.when(F.col("update").endswith("_chunk"), at("update.content.text")).alias("text"), F.when(tool, at("update.toolCallId")).alias("tool_call_id"), F.when(tool, at("update.title")).alias("title"), F.when(tool, at("update.status")).alias("status"),
        F.json_array_length(entries).alias("n_entries"), F.when(F.col("update") == "current_mode_update", at("update.currentModeId")).alias("mode_id"),
    )
