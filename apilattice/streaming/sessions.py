"""The sample session: a state machine over a session's messages, for streams and for batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "state string, sdk_path string, output string, samples int"
OUTPUT = "session_id string, seq bigint, state string, reply string"
START = ("Initial", "", "", 0)


def step(now: tuple[str, str, str, int], text: str) -> tuple[tuple[str, str, str, int], str]:
    """The state after a message, and the reply.

    ``cancel`` ends a session; a bad path or count is asked for again; a blank count means 5.
    """
    state, sdk, out, n = now
    text = (text or "").strip()
    low = text.lower()
    if state == "Complete":
        return now, "done"
    if low == "cancel":
        return ("Complete", sdk, out, n), "cancelled"
    if state == "Initial":
        return ("AwaitingSdkPath", sdk, out, n), "Which SDK folder?"
    if state == "AwaitingSdkPath":
        return (("AwaitingOutputFolder", text, out, n), "Which output folder?") if text.startswith("/") else (now, "Not a folder. Which SDK folder?")
    if state == "AwaitingOutputFolder":
        return ("AwaitingSampleCount", sdk, text or f"{sdk}/examples", n), "How many samples?"
    if state == "AwaitingSampleCount":
        count = 5 if not text else int(text) if text.isdigit() else 0
        return (("AwaitingPromptConfirmation", sdk, out, count), "Generate?") if 1 <= count <= 20 else (now, "A number from 1 to 20?")
    if state == "AwaitingPromptConfirmation":
        return (("AwaitingSamples", sdk, out, n), "prompt") if low in ("", "generate", "yes", "y") else (now, "Generate?")
    return ("Complete", sdk, out, n), "saved"


def _run(session: str, rows: pd.DataFrame, now: tuple) -> tuple[pd.DataFrame, tuple]:
    out = []
    for seq, text in rows.sort_values("seq")[["seq", "text"]].itertuples(index=False):
        now, reply = step(now, text)
        out.append((session, seq, now[0], reply))
    return pd.DataFrame(out, columns=["session_id", "seq", "state", "reply"]), now


def sessions(messages: DataFrame) -> DataFrame:
    """(session_id, seq, state, reply) of messages(session_id, seq, text)."""
    return messages.groupBy("session_id").applyInPandas(lambda rows: _run(rows["session_id"].iloc[0], rows, START)[0], OUTPUT)


def stream_sessions(messages: DataFrame) -> DataFrame:
    """The same for a stream, its state kept between micro-batches."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        made, now = _run(key[0], pd.concat(list(batches)), tuple(state.get) if state.exists else START)
        state.update(now)
        yield made

    return messages.groupBy("session_id").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
