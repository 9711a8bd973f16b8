"""Cumulative counters turned into entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cumulative_delta(counts: DataFrame, classes: list[str], key: str = "file_path", order: str = "line_no") -> DataFrame:
    """counts with a column per class: its rise since the file's row before. If any class fell, the event's own last turn stands.
    counts: structs total and last with a field per class."""
    before = Window.partitionBy(key).orderBy(order)
    rise = {c: F.col(f"total.{c}") - F.coalesce(F.lag(F.col(f"total.{c}"), 1).over(before), F.lit(0)) for c in classes}
    rows = counts.withColumns({f"_{c}": x for c, x in rise.items()})
    fell = F.least(*[F.col(f"_{c}") for c in classes]) < 0 if len(classes) > 1 else F.col(f"_{classes[0]}") < 0
    return rows.withColumns({c: F.when(fell, F.coalesce(F.col(f"last.{c}"), F.lit(0))).otherwise(F.col(f"_{c}")).cast("long") for c in classes}).drop(*[f"_{c}" for c in classes])


def carry_forward(rows: DataFrame, columns: list[str], key: str = "file_path", order: str = "line_no") -> DataFrame:
    """Each column's last non-null value at or before the row."""
    sofar = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(sofar) for c in columns})


def final_value(rows: DataFrame, columns: list[str], key: str = "file_path", order: str = "line_no") -> DataFrame:
    """Each column's last non-null value in the file, on all its rows."""
    whole = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(whole) for c in columns})
