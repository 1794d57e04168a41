"""Objects out of text chunks that arrive in pieces: a brace scanner whose state lives across chunks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MOST = 1024 * 1024
STATE = "buffer string, depth int, in_string boolean, escaped boolean"
OUTPUT = "stream_id string, json string"


class Scanner:
    """Feeds on chunks, gives whole JSON objects; text outside objects (fences, commas) is dropped.

    A broken object is dropped; one that grows past MOST characters is an error.
    """

    def __init__(self, buffer: str = "", depth: int = 0, in_string: bool = False, escaped: bool = False) -> None:
        self.parts, self.size, self.depth, self.in_string, self.escaped = [buffer], len(buffer), depth, in_string, escaped

    def state(self) -> tuple[str, int, bool, bool]:
        return "".join(self.parts), self.depth, self.in_string, self.escaped

    def feed(self, chunk: str) -> Iterator[str]:
        start = 0
        for k, c in enumerate(chunk):
            if self.depth == 0:
                if c == "{":
                    self.parts, self.size, self.depth, start = [], 0, 1, k
                continue
            if self.in_string:
                if self.escaped:
                    self.escaped = False
                elif c == "\\":
                    self.escaped = True
                elif c == '"':
                    self.in_string = False
            elif c == '"':
                self.in_string = True
            elif c == "{":
                self.depth += 1
            elif c == "}":
                self.depth -= 1
                if self.depth == 0:
                    whole = "".join([*self.parts, chunk[start : k + 1]]).replace("\r", "")
                    self.parts, self.size = [], 0
                    try:
                        json.loads(whole)
                    except ValueError:
                        continue
                    yield whole
        if self.depth:
            self.parts.append(chunk[start:])
            self.size += len(chunk) - start
            if self.size > MOST:
                raise ValueError(f"an object of more than {MOST} characters")


def objects(chunks: DataFrame) -> DataFrame:
    """(stream_id, json) of a batch of chunks(stream_id, seq, chunk), each stream in the order of seq."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        scanner = Scanner()
        found = [j for c in rows.sort_values("seq")["chunk"] for j in scanner.feed(c or "")]
        return pd.DataFrame({"stream_id": [rows["stream_id"].iloc[0]] * len(found), "json": found})

    return chunks.groupBy("stream_id").applyInPandas(run, OUTPUT)


def stream_objects(chunks: DataFrame) -> DataFrame:
    """The same for a stream: the scanner's state is kept between micro-batches."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        scanner = Scanner(*state.get) if state.exists else Scanner()
        rows = pd.concat(list(batches)).sort_values("seq")
        found = [j for c in rows["chunk"] for j in scanner.feed(c or "")]
        state.update(scanner.state())
        yield pd.DataFrame({"stream_id": [key[0]] * len(found), "json": found})

    return chunks.groupBy("stream_id").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def array_samples(rows: DataFrame, column: str = "response") -> DataFrame:
    """Samples of a strict JSON array; a response that is none has ``needs_correction`` set and no samples."""
    text = F.regexp_replace(F.trim(column), r"(?s)^```[a-z]*\s*|\s*```$", "")
    made = F.from_json(text, "array<struct<name: string, description: string, code: string, filePath: string>>")
    ok = made.isNotNull() & text.startswith("[") & F.try_parse_json(text).isNotNull()
    return rows.withColumn("samples", F.when(ok, made)).withColumn("needs_correction", ~F.coalesce(ok, F.lit(False)))
