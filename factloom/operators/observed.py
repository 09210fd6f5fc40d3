"""Figures of a run, taken by the tasks that write its stages: no scan is made for them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation


class Watch:
    """Collects aggregates of rows on their way into a table.

    ``rows`` must be what is written, with nothing that shuffles between: then each
    task's part counts once, also where a task ran again after a lost executor.
    """

    def __init__(self):
        self._seen: dict[str, Observation] = {}

    def rows(self, name: str, rows: DataFrame, figures: dict[str, Column]) -> DataFrame:
        """The same rows, whose figures are known once they were written."""
        self._seen[name] = Observation(f"{name}-{uuid.uuid4().hex}")
        return rows.observe(self._seen[name], *[v.alias(n) for n, v in figures.items()])

    def figures(self) -> dict[str, dict]:
        """Figures by stage, all of which must have been written."""
        return {name: dict(seen.get) for name, seen in self._seen.items()}
