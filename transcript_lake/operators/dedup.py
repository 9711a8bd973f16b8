"""Replayed API responses taken out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transcript_lake.functions.usage import total_tokens


def dedup(entries: DataFrame, total=None) -> DataFrame:
    """One row a response. entries: message_id, request_id, is_sidechain, arrival (a number or a
    struct that orders rows as they were scanned) and the token classes.

    A message's rows with one request are one response. A row whose request's first row is on a sidechain, or is the
    message's first row off one, falls into the message's common slot; others have a slot by request. Of a slot's rows
    the one off the sidechain, then with most tokens, then first stays, and takes the slot's first arrival as `position`.
    Rows without message_id are never replays; they skip the shuffle, in which that one value would be the hot key."""
    total = total_tokens() if total is None else total
    plain = entries.where(F.coalesce("message_id", F.lit("")) == "").withColumn("position", F.col("arrival"))
    message = Window.partitionBy("message_id")
    request = Window.partitionBy("message_id", "request_id")
    rows = entries.where(F.coalesce("message_id", F.lit("")) != "").withColumn("_total", total)
    rows = rows.withColumns({
        "_open": F.min(F.when(~F.col("is_sidechain"), F.col("arrival"))).over(message),
        "_first": F.min(F.struct("arrival", "is_sidechain")).over(request),
    })
    common = F.col("_first.is_sidechain") | F.col("_first.arrival").eqNullSafe(F.col("_open"))
    rows = rows.withColumn("_slot", F.when(common, F.lit(None)).otherwise(F.coalesce("request_id", F.lit(""))))
    slot = Window.partitionBy("message_id", "_slot")
    rows = rows.withColumns({
        "_n": F.row_number().over(slot.orderBy("is_sidechain", F.desc("_total"), "arrival")),
        "position": F.min("arrival").over(slot),
    })
    return rows.where("_n = 1").drop("_total", "_open", "_first", "_slot", "_n").unionByName(plain)
