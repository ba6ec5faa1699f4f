"""Writers of corpus tables, the noise model, events and frame series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def corpus_rows(objects: DataFrame, videos: DataFrame) -> DataFrame:
    """S17, U2. One row an object and one row an object-less video."""
    bare = videos.join(objects.select("video_id").distinct(), "video_id", "left_anti")
    return objects.unionByName(bare, allowMissingColumns=True)


def write_corpus(rows: DataFrame, path: str, by: str = "release") -> None:
    """S17. The corpus table, a folder a release."""
    rows.write.mode("overwrite").partitionBy(by).parquet(path)


def save_model(backgrounds: DataFrame, levels: DataFrame, fit: DataFrame, path: str) -> None:
    """S18. The noise model: usable backgrounds by frame rate, the strata's levels, the tail's fit."""
    backgrounds.write.mode("overwrite").partitionBy("rate").parquet(f"{path}/backgrounds")
    levels.write.mode("overwrite").parquet(f"{path}/levels")
    fit.write.mode("overwrite").parquet(f"{path}/tail")


def open_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S18."""
    return tuple(spark.read.parquet(f"{path}/{p}") for p in ("backgrounds", "levels", "tail"))


def as_camera_events(events: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """S19. Events of the chosen kinds as camera events."""
    return events.where(F.col("kind").isin(*kinds)).select("video_id", "frame", "kind", "what", "before", "after")


def write_events(events: DataFrame, path: str) -> None:
    """S19."""
    events.write.mode("overwrite").parquet(path)


def write_frame_series(series: DataFrame, path: str, keys: Sequence[str] = ("video_id",), frame: str = "frame", rows_per_file: int = 5_000_000) -> None:
    """S20. Per-frame tables, ranged by key and frame and sorted within a file, so that a window of frames is pruned."""
    series.repartitionByRange(*keys, frame).sortWithinPartitions(*keys, frame).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_controls(rows: DataFrame, path: str, columns: Sequence[str]) -> None:
    """S13. The columns a weigher needs, missing ones as null."""
    have = set(rows.columns)
    rows.select(*[F.col(c) if c in have else F.lit(None).cast("double").alias(c) for c in columns]).write.mode("overwrite").parquet(path)


def read_controls(spark: SparkSession, path: str) -> DataFrame:
    """S13."""
    return spark.read.parquet(path)


def units_chosen(units: DataFrame, only: DataFrame | None = None, leave: DataFrame | None = None) -> DataFrame:
    """U4. Units named in ``only`` less those in ``leave``."""
    u = units if only is None else units.join(only.select("unit_id"), "unit_id", "left_semi")
    return u if leave is None else u.join(leave.select("unit_id"), "unit_id", "left_anti")


def shared_frames(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("video_id", "frame")) -> tuple[DataFrame, DataFrame]:
    """U3. Frames both have; frames only the first has."""
    k = b.select(*keys).distinct()
    return a.join(k, list(keys), "left_semi"), a.join(k, list(keys), "left_anti")
