"""Edits of the model: conditional projections that leave every other row as it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import valid_duration, valid_name


class EditError(ValueError):
    """An edit that the model refuses."""


def set_where(rows: DataFrame, where: Column, column: str, value: Column) -> DataFrame:
    return rows.withColumn(column, F.when(where, value).otherwise(F.col(column)))


def rename_layer(layers: DataFrame, project_id: str, layer_id: str, name: str) -> DataFrame:
    """layers with one renamed. A blank name is refused first, then an unknown layer."""
    spark = layers.sparkSession
    if not spark.range(1).select(valid_name(F.lit(name))).head()[0]:
        raise EditError("a layer name must not be blank")
    it = (F.col("project_id") == project_id) & (F.col("layer_id") == layer_id)
    if not layers.where(it).head(1):
        raise EditError(f"no layer {layer_id}")
    return set_where(layers, it, "name", F.lit(name))


def update_duration(frames: DataFrame, project_id: str, frame_index: int, duration_ms: float) -> DataFrame:
    """frames with one duration set. A duration that isn't a whole number from 1 to 65535 is refused first, then an unknown frame."""
    if not frames.sparkSession.range(1).select(valid_duration(F.lit(float(duration_ms)))).head()[0]:
        raise EditError("a duration must be a whole number of milliseconds from 1 to 65535")
    it = (F.col("project_id") == project_id) & (F.col("frame_index") == frame_index)
    if not frames.where(it).head(1):
        raise EditError(f"no frame {frame_index}")
    return set_where(frames, it, "duration_ms", F.lit(int(duration_ms)))
