"""Month-keyed cut-off series: movement, backlog, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["preference", "chargeability"]


def movement(series: DataFrame) -> DataFrame:
    """Days since the previous cut-off that isn't current. Current rows are passed over; an unavailable one resets."""
    before = F.lag("priority_date").over(Window.partitionBy(*KEY, "is_current").orderBy("bulletin_date"))
    return series.withColumn("movement_days", F.when(~F.col("is_current"), F.datediff("priority_date", before)))


def backlog(series: DataFrame, as_of, last: int = 13) -> DataFrame:
    """Days and years behind ``as_of``, mean advance over the last months, and the years it would take at that pace."""
    dated = series.where("priority_date IS NOT NULL")
    recent = Window.partitionBy(*KEY).orderBy(F.desc("bulletin_date"))
    rows = dated.withColumn("nth", F.row_number().over(recent)).withColumn("older", F.lead("priority_date").over(recent)).where(F.col("nth") <= last)
    step = F.when(F.col("nth") < last, F.datediff("priority_date", "older"))
    out = rows.groupBy(*KEY).agg(F.max_by("priority_date", "bulletin_date").alias("priority_date"), F.avg(step).alias("advance"))
    days = F.datediff(as_of, F.col("priority_date"))
    out = out.withColumn("days_behind", days).withColumn("years_behind", F.round(days / 365.25, 1)).withColumn("avg_advance", F.round("advance", 1))
    months = F.col("days_behind") / F.col("advance")
    return out.withColumn("est_years", F.when(F.col("advance") > 0, F.round(months / 12, 1))).drop("advance")


def forward_fill(df: DataFrame, key: list[str], order: list[str], column: str) -> DataFrame:
    """Nulls of a column take the last value before them within the key."""
    before = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(before))
