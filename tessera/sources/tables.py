"""Reading feature columns from any format Spark reads, and keeping sketches with their maps as Parquet."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.waves import WAVES
from tessera.operators.feature_map import FeatureMap
from tessera.sources.frequencies import table


def read_features(spark: SparkSession, path: str, features: dict[str, str], keep: tuple[str, ...] = (), fmt: str = "parquet", **options) -> DataFrame:
    """Columns ``features`` (name -> SQL expression) and ``keep``. Only what the expressions name is scanned."""
    return spark.read.format(fmt).options(**options).load(path).select(*keep, *[F.expr(e).cast("double").alias(n) for n, e in features.items()])


def bounds(df: DataFrame, cols: list[str]) -> np.ndarray:
    """Least and greatest values of columns, (2, d); not for private sketches, as they come from the data."""
    r = df.agg(*[f(c) for f in (F.min, F.max) for c in cols]).first()
    return np.array(r, float).reshape(2, len(cols))


def write_sketch(s: DataFrame, fmap: FeatureMap, path: str, mode: str = "error") -> None:
    """A sketch (of any groups) with the map that made it."""
    if fmap.f.name not in WAVES:
        raise ValueError("only maps with a named wave at its usual period can be kept")
    kept = s.join(table(s.sparkSession, fmap.omega, fmap.xi), "j")
    kept.withColumns({"wave": F.lit(fmap.f.name), "c_norm": F.lit(fmap.c_norm)}).write.mode(mode).parquet(path)


def read_sketch(spark: SparkSession, path: str) -> tuple[DataFrame, FeatureMap]:
    """The sketch as it was, and its map."""
    kept = spark.read.parquet(path)
    freq = kept.select("j", "omega", "xi", "wave", "c_norm").dropDuplicates(["j"]).orderBy("j").collect()  # a row per frequency
    fmap = FeatureMap.of(freq[0]["wave"], np.array([r["omega"] for r in freq]).T, [r["xi"] for r in freq], freq[0]["c_norm"])
    return kept.drop("omega", "xi", "wave", "c_norm"), fmap
