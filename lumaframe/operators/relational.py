"""The model's relational steps: reindexing, regrouping, coverage, offsets, limits, references. Each needs one shuffle on its key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def ordered(key: list[str], order: list[str]):
    return Window.partitionBy(*key).orderBy(*order)


def reindex(rows: DataFrame, key: list[str], order: list[str], keep: Column, name: str = "frame_index") -> DataFrame:
    """The rows that keep holds for, numbered from 0 within their key."""
    return rows.where(keep).withColumn(name, (F.row_number().over(ordered(key, order)) - 1).cast("int"))


def visible(frames: DataFrame, hidden: DataFrame, on: list[str]) -> DataFrame:
    """frames without those that hidden lists."""
    return frames.join(hidden, on, "left_anti")


def position(key: list[str], order: list[str]) -> Column:
    """A row's position from 0 within its key."""
    return (F.row_number().over(ordered(key, order)) - 1).cast("int")


def next_value(value: str, key: list[str], order: list[str], last) -> Column:
    return F.lead(value, 1, last).over(ordered(key, order))


def running_sum(value: str, key: list[str], order: list[str]) -> Column:
    return F.sum(value).over(ordered(key, order).rowsBetween(Window.unboundedPreceding, 0))


def first_breach(rows: DataFrame, value: str, key: list[str], order: str, cap: int) -> DataFrame:
    """For each key whose running sum exceeds cap, the first row where it does, and the sum there."""
    rows = rows.withColumn("running", running_sum(value, key, [order])).where(F.col("running") > cap)
    return rows.groupBy(*key).agg(F.min(order).alias(order), F.min_by("running", order).alias("running"))


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys of more than one row, and how many rows they have."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def regroup(rows: DataFrame, key: list[str], same: list[str]) -> DataFrame:
    """For each key its rows, and whether all agree in each of the columns."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *[F.min(c).eqNullSafe(F.max(c)).alias(f"same_{c}") for c in same])


def coverage(rows: DataFrame, key: list[str], index: str) -> DataFrame:
    """For each key whether its indexes are 0 to their maximum, without a gap."""
    return rows.groupBy(*key).agg(F.count_distinct(index).alias("covered"), (F.max(index) + 1).alias("needed")).withColumn("complete", F.col("covered") == F.col("needed"))


def equals_first(value: str, key: list[str], order: list[str]) -> Column:
    """Whether a row's value is that of the first row of its key."""
    return F.col(value).eqNullSafe(F.first(value).over(ordered(key, order)))


#: Layers that one document may have by its format: so many may be broadcast.
LAYERS = 65_536


def cells(frames: DataFrame, layers: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Every layer in every frame, of documents that on names the key of; without on, of the one document that all rows are of."""
    if on:
        return frames.join(layers, on)
    if layers.limit(LAYERS + 1).count() > LAYERS:
        raise ValueError(f"a document has {LAYERS} layers at most; name the key of several documents")
    return frames.crossJoin(F.broadcast(layers))


def references(rows: DataFrame, targets: DataFrame, on: list[str], missing: bool) -> DataFrame:
    """Rows that refer to a target, or to none if missing is true."""
    return rows.join(targets, on, "left_anti" if missing else "left_semi")


def in_ranges(frames: DataFrame, ranges: DataFrame, index: str, low: str, high: str, width: int) -> DataFrame:
    """Frames joined with the inclusive ranges that contain them.

    Ranges are dealt to each bin of `width` indexes that they touch, so that the join is by equality and splits."""
    bins = ranges.withColumn("bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return frames.withColumn("bin", F.floor(F.col(index) / width)).join(bins, "bin").where(F.col(index).between(F.col(low), F.col(high))).drop("bin")


def kind_counts(rows: DataFrame, key: list[str], column: str, kinds: list[str]) -> DataFrame:
    """For each key how many rows are of each kind."""
    return rows.groupBy(*key).agg(*[F.count_if(F.col(column) == k).alias(f"n_{k}") for k in kinds])
