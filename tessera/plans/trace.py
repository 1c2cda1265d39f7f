"""Watching a plan while it runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Trace:
    """Counts at steps of a plan, taken while its action runs; no extra job.

    ``watch`` marks a step and returns the frame to go on with; without a trace, plans are as they are.
    """

    def __init__(self):
        self._steps: dict[str, Observation] = {}

    def watch(self, df: DataFrame, step: str, **measures: Column) -> DataFrame:
        """Counts the rows (and measures more) that pass here; a step is named once."""
        if step in self._steps:
            raise ValueError(f"step {step} is watched already")
        self._steps[step] = Observation(step)
        return df.observe(self._steps[step], F.count(F.lit(1)).alias("rows"), *[c.alias(name) for name, c in measures.items()])

    def report(self, step: str) -> dict:
        """What was measured at a step; waits for the action that passes it."""
        return self._steps[step].get
