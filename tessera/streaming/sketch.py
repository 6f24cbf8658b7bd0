"""Sketches over windows of a stream: running sums per window and frequency, by Spark's own stateful aggregation.

State is m rows per open window, whatever the rate. Late rows count until the watermark passes a window's end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.feature_map import FeatureMap
from tessera.operators.sketch import _clean, catalyst_rows, feature_sums


def _sketch_of(events: DataFrame, fmap: FeatureMap, cols: list[str] | None, vector: str | None, weight: str | None, time: str, window: Column, late: str | None, by: list[str]) -> DataFrame:
    cols = cols or []
    if bool(cols) == bool(vector):
        raise ValueError("give cols or vector")
    if events.isStreaming and late:
        events = events.withWatermark(time, late)
    rows = catalyst_rows(_clean(events, cols, vector, weight, "drop", fmap.d), fmap, cols, vector, weight, [time, *by])
    s = feature_sums(rows.groupBy(window.alias("window"), *by, "j"))
    over = F.lit(1.0) if weight else F.col("n")
    return s.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "j", (F.col("sre") / over).alias("re"), (F.col("sim") / over).alias("im"), "n", "w", F.lit(bool(weight)).alias("weighted"))


def windowed_sketch(events: DataFrame, fmap: FeatureMap, cols: list[str] | None, time: str, width: str, slide: str | None = None, late: str | None = None, by: list[str] | None = None, vector: str | None = None, weight: str | None = None) -> DataFrame:
    """start, end, by columns and the sketch of each window. The same call serves a batch and a stream (``late`` sets its watermark)."""
    return _sketch_of(events, fmap, cols, vector, weight, time, F.window(time, width, slide) if slide else F.window(time, width), late, by or [])


def session_sketch(events: DataFrame, fmap: FeatureMap, cols: list[str] | None, time: str, gap: str, by: list[str], late: str | None = None, vector: str | None = None, weight: str | None = None) -> DataFrame:
    """The same over sessions of the ``by`` keys: periods without a pause of ``gap``. Sessions are found once per event,
    before it meets the frequencies."""
    if events.isStreaming:
        return _sketch_of(events, fmap, cols, vector, weight, time, F.session_window(time, gap), late, by)
    w = Window.partitionBy(*by).orderBy(time)
    new = F.coalesce(F.col(time) > F.lag(F.col(time) + F.expr(f"INTERVAL {gap}")).over(w), F.lit(True))
    spans = events.withColumn("_new", F.when(new, F.col(time))).withColumn("_start", F.last("_new", True).over(w))
    last = Window.partitionBy(*by, "_start")
    spans = spans.withColumn("_window", F.struct(F.col("_start").alias("start"), (F.max(time).over(last) + F.expr(f"INTERVAL {gap}")).alias("end"))).drop("_new", "_start")
    return _sketch_of(spans, fmap, cols, vector, weight, "_window", F.col("_window"), None, by)
