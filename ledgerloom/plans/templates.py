"""Ready-made pivots over the disclosure programs, and their SQL."""

from __future__ import annotations

from ..operators.pivot import Metric, PivotSpec

COUNT, SHARE = Metric("count", None, "cases"), Metric("pct_of_total", None, "share")
_WAGES = (Metric("avg", "wage_from", "avg_wage"), Metric("min", "wage_from", "min_wage"), Metric("max", "wage_from", "max_wage"))

#: name: (program, spec)
TEMPLATES: dict[str, tuple[str, PivotSpec]] = {
    "perm_outcomes": ("perm", PivotSpec(("case_status",), (COUNT, SHARE))),
    "perm_outcomes_by_year": ("perm", PivotSpec(("fiscal_year", "case_status"), (COUNT,))),
    "perm_top_firms": ("perm", PivotSpec(("law_firm",), (COUNT,), limit=25, order="metric_desc")),
    "perm_top_employers": ("perm", PivotSpec(("employer_name",), (COUNT,), limit=25, order="metric_desc")),
    "perm_soc_outcomes": ("perm", PivotSpec(("soc_title", "case_status"), (COUNT, SHARE))),
    "perm_employer_detail": ("perm", PivotSpec(("employer_name", "case_status"), (COUNT, *_WAGES), limit=5000)),
    "perm_wage_by_soc": ("perm", PivotSpec(("soc_title",), (COUNT, *_WAGES))),
    "perm_occupation_type": ("perm", PivotSpec(("occupation_type",), (COUNT, Metric("count_distinct", "employer_name", "employers")))),
    "pw_soc_drift_detail": ("pw", PivotSpec(("suggested_soc_code", "pwd_soc_code"), (COUNT,))),
    "pw_wage_level_dist": ("pw", PivotSpec(("pw_wage_level",), (COUNT, SHARE))),
    "pw_wage_source": ("pw", PivotSpec(("wage_source",), (COUNT, SHARE))),
    "pw_alt_survey_detail": ("pw", PivotSpec(("wage_source", "pw_wage_level"), (COUNT,), filters=(("survey_name", "not_null"),))),
    "pw_firm_volume": ("pw", PivotSpec(("law_firm", "fiscal_year"), (COUNT,))),
    "lca_wage_source": ("lca", PivotSpec(("wage_source",), (COUNT, SHARE))),
    "lca_by_visa_class": ("lca", PivotSpec(("visa_class",), (COUNT, Metric("sum", "total_worker_positions", "positions")))),
    "lca_h1b_dependent": ("lca", PivotSpec(("h1b_dependent",), (COUNT, SHARE))),
    "lca_wage_gap": ("lca", PivotSpec(("soc_title",), (COUNT, Metric("avg", "wage_from", "avg_wage"), Metric("avg", "prevailing_wage", "avg_prevailing")))),
    "lca_top_employers": ("lca", PivotSpec(("employer_name",), (COUNT,), limit=25, order="metric_desc")),
    "lca_firm_by_year": ("lca", PivotSpec(("law_firm", "fiscal_year"), (COUNT,))),
}

_AGG = {"count": "count(*)", "sum": "sum({f})", "avg": "round(avg({f})::DECIMAL(38,10), 2)::DOUBLE", "min": "min({f})", "max": "max({f})", "count_distinct": "count(DISTINCT {f})", "pct_of_total": "round(count(*) * 100.0 / sum(count(*)) OVER (), 2)"}


def template_sql(program_sql: str, spec: PivotSpec) -> str:
    """Hand-made GROUP BY for templates without a column field; filters are IS NOT NULL only."""
    metrics = ", ".join(f"{_AGG[m.agg].format(f=m.field)} AS {label}" for m, label in zip(spec.metrics, spec.labels, strict=True))
    rows = ", ".join(spec.rows)
    where = " AND ".join(f"{f[0]} IS NOT NULL" for f in spec.filters)
    by = ", ".join(f"{r} NULLS LAST" for r in spec.rows)
    order = f"{spec.labels[0]} DESC NULLS LAST, {by}" if spec.order == "metric_desc" else by
    return f"SELECT {rows}, {metrics} FROM ({program_sql}) t {f'WHERE {where}' if where else ''} GROUP BY {rows} ORDER BY {order} LIMIT {min(spec.limit or 500, 5000)}"
