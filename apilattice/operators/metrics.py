"""What the steps of a run count while their rows pass, without a second pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Run:
    """Collects the metrics of watched steps; ``table`` shows them after the action that ran them.

    A step is counted by the first action on it, and must be part of one: ``table`` waits for it.
    Plans that use a watched table in two places may count it in both, and a stage that runs again
    because an executor was lost may count again, so the figures are for watching, not results.
    """

    def __init__(self) -> None:
        self.seen: dict[str, Observation] = {}

    def watch(self, step: str, rows: DataFrame, **metrics: Column) -> DataFrame:
        """The same rows, with their number (``rows``) and ``metrics``, aggregates that give whole numbers, observed as ``step``."""
        if step in self.seen:
            raise ValueError(f"step {step!r} is watched already")
        self.seen[step] = Observation(step)
        return rows.observe(self.seen[step], F.count(F.lit(1)).alias("rows"), *[c.cast("bigint").alias(name) for name, c in metrics.items()])

    def table(self, spark: SparkSession) -> DataFrame:
        """(step, metric, value): a few rows for each step; a null counts as 0."""
        rows = [(step, name, int(value or 0)) for step, seen in self.seen.items() for name, value in seen.get.items()]
        return spark.createDataFrame(rows, "step string, metric string, value bigint")
