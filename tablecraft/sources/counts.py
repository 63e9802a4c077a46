"""Row counts of a load, measured while it runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def with_counts(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The same rows, counted as they pass; read ``observation.get['rows']`` after the action."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def load_delta(rows_in: Observation, rows_out: Observation) -> dict[str, int]:
    """Rows in, rows out and the difference, after the action has run."""
    before, after = rows_in.get["rows"], rows_out.get["rows"]
    return {"rows_in": before, "rows_out": after, "rows_changed": after - before}
