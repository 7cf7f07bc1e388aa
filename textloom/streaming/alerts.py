"""An extension: units that arrive as a stream, held against the units of the groups known so far."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_unit_alerts(stream: DataFrame, known: DataFrame, watermark: str = "7 days", time: str = "loaded_at") -> DataFrame:
    """(case_id, unit_id, group_name, other_group, normalized): arriving units whose form another group holds.

    A stream-static join on (case_id, normalized); a unit that arrives again within the watermark is taken once.
    """
    new = stream.filter("normalized <> '' and comparable").withWatermark(time, watermark).dropDuplicatesWithinWatermark(["case_id", "unit_id", "pos"])
    held = known.filter("normalized <> '' and comparable").select("case_id", "normalized", F.col("group_name").alias("other_group")).distinct()
    return new.join(held, ["case_id", "normalized"]).filter("group_name <> other_group").select("case_id", "unit_id", "group_name", "other_group", "normalized", time)


def late_units_by_window(stream: DataFrame, watermark: str = "10 days", width: str = "1 day") -> DataFrame:
    """Units and late units (loaded more than a day after they were parsed) by window of loading time."""
    late = F.col("loaded_at") > F.col("parsed_at") + F.expr("interval 1 day")
    return stream.withWatermark("loaded_at", watermark).groupBy(F.window("loaded_at", width).alias("w")).agg(F.count(F.lit(1)).alias("units"), F.count_if(late).alias("late")).select(F.col("w.start").alias("start"), "units", "late")
