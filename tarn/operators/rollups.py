"""Rollups: hourly cells of a declared aggregate, and the folds over them.

A rollup is a table (grp, hour, value) of partial results. Cells of one group and hour may lie in several rows (one for
each batch written); every fold combines them, so it needs no order and no locking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions import bucket, canonical, hour_of, week_of
from tarn.schema import COUNT, HISTOGRAM, MAX, MIN, Aggregate, Entity


def group_key(aggregate: Aggregate, entity: Entity) -> Column:
    """The group's canonical key; a missing value falls in the group of the empty string."""
    if aggregate.metric == HISTOGRAM:
        c = F.col(f"`{entity.field(aggregate.field).column}`").cast("double")
        return F.when(c.isNotNull(), F.concat(F.lit("i"), bucket(c, list(aggregate.bounds)).cast("string")))
    if aggregate.group is None:
        return F.lit("")
    f = entity.field(aggregate.group)
    return F.coalesce(canonical(F.col(f"`{f.column}`"), f.type), F.lit(""))


def cell_hour(aggregate: Aggregate, entity: Entity, written: Column) -> Column:
    """The hour of the date field, or that of writing where there is none."""
    if aggregate.date is None:
        return hour_of(written)
    held = [f for f in entity.active_fields() if f.name == aggregate.date]
    return hour_of(F.coalesce(F.col(f"`{held[0].column}`"), written)) if held else hour_of(written)


def measure(aggregate: Aggregate, entity: Entity) -> Column:
    if aggregate.metric in (COUNT, HISTOGRAM):
        return F.lit(1.0)
    return F.col(f"`{entity.field(aggregate.field).column}`").cast("double")


def combine(aggregate: Aggregate) -> Column:
    return {MIN: F.min, MAX: F.max}.get(aggregate.storage, F.sum)("value")


def contributions(df: DataFrame, aggregate: Aggregate, entity: Entity, written: Column) -> DataFrame:
    """(grp, hour, value) of each record that the aggregate sees; records without the measure have none."""
    return df.select(
        group_key(aggregate, entity).alias("grp"), cell_hour(aggregate, entity, written).alias("hour"), measure(aggregate, entity).alias("value")
    ).where("value is not null and grp is not null")


def build(df: DataFrame, aggregate: Aggregate, entity: Entity, written: Column) -> DataFrame:
    """The cells of a whole table, each once."""
    return contributions(df, aggregate, entity, written).groupBy("grp", "hour").agg(combine(aggregate).alias("value"))


def fold(cells: DataFrame, aggregate: Aggregate) -> DataFrame:
    """One row, one value over all groups. Null where there is no cell."""
    return cells.agg(combine(aggregate).alias("value"))


def totals(cells: DataFrame, aggregate: Aggregate) -> DataFrame:
    """(grp, value) for each group; counts of zero vanish, other zeros stay."""
    out = cells.groupBy("grp").agg(combine(aggregate).alias("value"))
    return out.where("value <> 0") if aggregate.metric == COUNT else out


def series(cells: DataFrame, aggregate: Aggregate, start, end) -> DataFrame:
    """(grp, hour, value) of the hours that begin in [start, end). Cells that know their week are narrowed by it first, so
    stored ones are read from the folders of the weeks in range."""
    if "week" in cells.columns:
        first, last = (F.to_date(week_of(F.lit(x).cast("timestamp"))) for x in (start, end))
        cells = cells.where(F.col("week").between(first, last))
    cells = cells.where((F.col("hour") >= F.lit(start).cast("timestamp")) & (F.col("hour") < F.lit(end).cast("timestamp")))
    out = cells.groupBy("grp", "hour").agg(combine(aggregate).alias("value"))
    return out.where("value <> 0") if aggregate.metric == COUNT else out


def ratio(sums: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Averages: groups without a count, or with one of zero, are left out."""
    joined = sums.withColumnRenamed("value", "total").join(counts.withColumnRenamed("value", "n").where("n <> 0"), keys)
    return joined.select(*keys, (F.col("total") / F.col("n")).alias("value"))


def percentile(cells: DataFrame, aggregate: Aggregate, rank: float) -> DataFrame:
    """One row, one value, read from the buckets (64 at most): within a bucket values are taken as evenly spread."""
    bounds = F.array(*[F.lit(float(b)) for b in aggregate.bounds])
    last = len(aggregate.bounds)
    buckets = cells.groupBy(F.substring("grp", 2, 9).cast("int").alias("bucket")).agg(F.sum("value").alias("n")).where("n > 0")
    up_to = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    walked = buckets.select("bucket", "n", F.sum("n").over(up_to).alias("cum"), (F.sum("n").over(whole) * float(rank)).alias("target"))
    hit = walked.where("cum >= target").agg(F.min(F.struct("bucket", "n", "cum", "target")).alias("hit")).select("hit.*")
    low, high = F.element_at(bounds, F.col("bucket")), F.element_at(bounds, F.col("bucket") + 1)
    inside = low + (F.col("target") - (F.col("cum") - F.col("n"))) / F.col("n") * (high - low)
    value = F.when(F.col("bucket") == 0, F.lit(float(aggregate.bounds[0]))).when(F.col("bucket") == last, F.lit(float(aggregate.bounds[-1]))).otherwise(inside)
    return hit.select(F.when(F.col("bucket").isNotNull(), value).alias("value"))
