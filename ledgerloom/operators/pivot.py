"""Ad-hoc pivot and raw queries: filters, seven aggregates, a column pivot, grand totals."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .filters import apply_filters, require_columns

MAX_COLUMN_VALUES, DEFAULT_LIMIT, MAX_LIMIT = 50, 500, 5000
AGGREGATES = ("count", "pct_of_total", "count_distinct", "sum", "avg", "min", "max")


@dataclass(frozen=True)
class Metric:
    agg: str = "count"
    field: str | None = None
    label: str | None = None


@dataclass(frozen=True)
class PivotSpec:
    rows: tuple[str, ...] = ()
    metrics: tuple[Metric, ...] = (Metric("count", None, "Count"),)
    column: str | None = None
    filters: tuple[tuple, ...] = ()
    limit: int | None = None
    #: "key": by the first row field, as a table is read; "metric_desc": by the first metric, so that a limit gives a top list.
    order: str = "key"
    labels: tuple[str, ...] = field(init=False, default=())

    def __post_init__(self) -> None:
        object.__setattr__(self, "labels", tuple(m.label or f"Metric {i + 1}" for i, m in enumerate(self.metrics)))


def validate(df: DataFrame, spec: PivotSpec) -> None:
    if not spec.rows:
        raise ValueError("a pivot needs a row field")
    require_columns(df, [*spec.rows, *(m.field for m in spec.metrics if m.field), *([spec.column] if spec.column else [])])
    for m in spec.metrics:
        if m.agg not in AGGREGATES:
            raise ValueError(f"unknown aggregate: {m.agg}")
        if m.agg in ("sum", "avg") and (not m.field or not isinstance(df.schema[m.field].dataType, T.NumericType)):
            raise ValueError(f"{m.agg} needs a numeric field")
        if m.agg in ("min", "max") and not m.field:
            raise ValueError(f"{m.agg} needs a field")


def mean(value: Column | str) -> Column:
    """Average to two places as a decimal, so that a half goes away from zero whatever its binary fraction."""
    return F.round(F.avg(value).cast("decimal(38,10)"), 2).cast("double")


def _aggregate(m: Metric, when: Column | None = None) -> Column:
    """The aggregate, over the rows for which ``when`` holds. Shares are counts here, see ``pivot``."""
    value = F.col(m.field) if m.field else F.lit(1)
    value = value if when is None else F.when(when, value)
    if m.agg in ("count", "pct_of_total") or (m.agg == "count_distinct" and not m.field):
        return F.count(F.lit(1) if when is None else F.when(when, F.lit(1)))
    if m.agg == "count_distinct":
        return F.count_distinct(value)
    if m.agg == "avg":
        return mean(value)
    return {"sum": F.sum, "min": F.min, "max": F.max}[m.agg](value)


def _limit(spec: PivotSpec) -> int:
    return min(spec.limit or DEFAULT_LIMIT, MAX_LIMIT)


def column_values(df: DataFrame, column: str) -> list:
    """The first distinct values in order, null (named None) last; they become columns, so their number is bounded."""
    rows = df.select(column).distinct().orderBy(F.col(column).asc_nulls_last()).limit(MAX_COLUMN_VALUES).collect()
    return [r[0] for r in rows]


def pivot(df: DataFrame, spec: PivotSpec) -> DataFrame:
    """Row fields, then a column for each metric; with a column field one for each value and metric, and the row's total."""
    validate(df, spec)
    base, columns, shares = apply_filters(df, spec.filters), [], []
    if spec.column is None:
        for m, label in zip(spec.metrics, spec.labels, strict=True):
            columns.append(_aggregate(m).alias(label))
            if m.agg == "pct_of_total":
                shares.append((label, None))
    else:
        for value in column_values(base, spec.column):
            held = F.col(spec.column).isNull() if value is None else F.col(spec.column) == F.lit(value)
            for m, label in zip(spec.metrics, spec.labels, strict=True):
                columns.append(_aggregate(m, held).alias(f"{value}__{label}"))
                if m.agg == "pct_of_total":
                    shares.append((f"{value}__{label}", f"__row_total__{label}"))
        for m, label in zip(spec.metrics, spec.labels, strict=True):
            columns.append(_aggregate(m).alias(f"__row_total__{label}"))
            if m.agg == "pct_of_total":
                shares.append((f"__row_total__{label}", None))
    out = base.groupBy(*spec.rows).agg(*columns)
    # A cell is a share of its row, a row's total a share of all rows, counted apart: one row.
    if any(not of for _, of in shares):
        out = out.join(F.broadcast(base.agg(F.count("*").alias("__all_rows"))))
    for name, of in shares:
        total = F.col(of) if of else F.col("__all_rows")
        out = out.withColumn(name if of else f"{name}%", F.round(F.col(name) * 100.0 / F.nullif(total, F.lit(0)), 2))
    for name, of in shares:
        if not of:
            out = out.withColumn(name, F.col(f"{name}%")).drop(f"{name}%")
    out = out.drop("__all_rows")
    first = F.col(spec.rows[0]).asc_nulls_last()
    rest = [F.col(r).asc_nulls_last() for r in spec.rows]
    if spec.order == "metric_desc":
        lead = spec.labels[0] if spec.column is None else f"__row_total__{spec.labels[0]}"
        return out.orderBy(F.col(lead).desc_nulls_last(), *rest).limit(_limit(spec))
    return out.orderBy(first, *rest[1:]).limit(_limit(spec))


def grand_total(df: DataFrame, spec: PivotSpec) -> DataFrame:
    """One row: every metric over all filtered rows, the number of groups, and whether the limit cut any.

    With a column field also the rows of each of its values under each metric's label, and the metrics as the row totals: totals of
    cells count rows, whatever the metric.
    """
    validate(df, spec)
    base = apply_filters(df, spec.filters)
    groups = base.groupBy(*spec.rows).agg(F.count("*").alias("n")).agg(F.count("*").alias("n_groups"))
    metrics = [F.lit(100.0) if m.agg == "pct_of_total" else _aggregate(m) for m in spec.metrics]
    if spec.column is None:
        metrics = [m.alias(label) for m, label in zip(metrics, spec.labels, strict=True)]
    else:
        metrics = [m.alias(f"__row_total__{label}") for m, label in zip(metrics, spec.labels, strict=True)]
        for value in column_values(base, spec.column):
            held = F.col(spec.column).isNull() if value is None else F.col(spec.column) == F.lit(value)
            metrics += [F.count_if(held).alias(f"{value}__{label}") for label in spec.labels]
    total = base.agg(*metrics, F.count("*").alias("n_rows"))
    return total.join(F.broadcast(groups)).withColumn("limited", F.col("n_groups") > _limit(spec))  # one row each


def raw(df: DataFrame, spec: PivotSpec, key: str) -> DataFrame:
    """The first filtered rows by key."""
    return apply_filters(df, spec.filters).orderBy(key).limit(_limit(spec))


def raw_count(df: DataFrame, spec: PivotSpec) -> DataFrame:
    return apply_filters(df, spec.filters).agg(F.count("*").alias("total")).withColumn("limited", F.col("total") > _limit(spec))


def typeahead(df: DataFrame, column: str, text: str, limit: int = 50) -> DataFrame:
    """Distinct values that contain ``text``, in order."""
    require_columns(df, [column])
    return df.where(F.col(column).ilike(f"%{text}%")).select(F.col(column).alias("value")).distinct().orderBy("value").limit(min(limit, 50))
