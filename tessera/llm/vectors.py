"""Reading a vector column: which rows take part, and their numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, v (array<double>) and d (its length); both null if the vector is null, empty, or holds null or non-finite components."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    fine = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.select("vec_id", F.when(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.coalesce(fine, F.lit(True)), F.col("v")).alias("v"))
    return rows.withColumn("d", F.when(F.col("v").isNotNull(), F.size("v")))


def lengths(rows: DataFrame) -> list[int]:
    """The lengths of the vectors. Each is searched by itself: vectors of different lengths have no inner product."""
    return sorted(r["d"] for r in rows.filter("d is not null").select("d").distinct().collect())  # one for each model that made vectors
