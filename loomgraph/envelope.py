"""What every answer carries besides its rows: scope, budget, conditions, blind spots, exit code."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = 5
#: Rows that a reader is shown if no limit is given.
HUMAN_LIMIT = 20


@dataclass
class Envelope:
    """An answer. ``result`` stays a DataFrame; small side channels are DataFrames too."""

    operation: str
    request: dict
    result: DataFrame | None = None
    conditions: DataFrame | None = None
    blind_spots: DataFrame | None = None
    excluded: DataFrame | None = None
    limit: int | None = None
    error: str | None = None
    #: Further tables of the answer, by name.
    parts: dict[str, DataFrame] = field(default_factory=dict)
    #: One row with the number of findings that a caller asked to fail on.
    failing: DataFrame | None = None
    notes: list[str] = field(default_factory=list)

    def budget(self) -> dict:
        available = self.result.count() if self.result is not None else 0
        returned = available if self.limit is None else min(available, self.limit)
        return {"returned": returned, "available": available, "truncated": returned < available}

    def rows(self) -> DataFrame:
        return self.result if self.limit is None else self.result.limit(self.limit)

    def exit_code(self) -> int:
        """0 answered, 1 a negative finding, 2 could not answer."""
        if self.error:
            return 2
        return int(self.failing is not None and (self.failing.first()[0] or 0) > 0)

    def to_text(self, limit: int = HUMAN_LIMIT) -> str:
        """The answer for a reader: rows up to a limit, and how many there are beyond it."""
        if self.error:
            return f"{self.operation}: {self.error}"
        cut = limit if self.limit is None else min(limit, self.limit)
        rows = self.result.limit(cut + 1).collect() if self.result is not None else []
        lines = ["\t".join("" if v is None else str(v) for v in r) for r in rows[:cut]]
        if len(rows) > cut:
            lines.append(f"and {self.result.count() - cut} more")
        return "\n".join(lines)

    def to_json(self) -> str:
        """The whole answer as text; only for results that a reader asked to have in one piece."""
        listed = lambda df: [json.loads(x) for x in df.toJSON().collect()] if df is not None else []
        body = {"operation": self.operation, "schemaVersion": VERSION, "request": self.request, "conditions": listed(self.conditions), "blindSpots": listed(self.blind_spots)}
        if self.error:
            return json.dumps(body | {"error": {"code": self.error}})
        excluded = self.excluded.first()[0] if self.excluded is not None else 0
        return json.dumps(body | {"budget": self.budget(), "excluded": excluded, "result": listed(self.rows())})


def missing(operation: str, request: dict, code: str) -> Envelope:
    return Envelope(operation, request, error=code)


def merge_conditions(parts: list[DataFrame]) -> DataFrame:
    """Conditions of several answers, one per project; the first one stands."""
    numbered = None
    for k, df in enumerate(parts):
        part = df.select("config_path", "cause", F.lit(k).alias("k"))
        numbered = part if numbered is None else numbered.unionByName(part)
    return numbered.groupBy("config_path").agg(F.min_by("cause", "k").alias("cause"))
