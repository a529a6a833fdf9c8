"""The full run: dates, roles, profile, cleaning, outliers, dashboard spec, checks, chart data, quality."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from limpid import vocab
from limpid.operators import outliers
from limpid.operators.clean import PARSE_SHARE, clean, normalize_dates
from limpid.operators.guard import validate_dashboard
from limpid.operators.profile import missing_by_column, profile, quality_summary
from limpid.plans.dashboard import dashboard_data, dashboard_kpis
from limpid.plans.roles import infer_types, profile_roles
from limpid.plans.spec import auto_spec, safe_spec
from limpid.sources.tables import write_charts, write_csv, write_profile, write_spec
from limpid.storage import materialize


@dataclass
class Run:
    """Results of one run. Tables are DataFrames; decisions and small summaries are plain values."""
    cleaned: DataFrame
    profile: DataFrame
    roles: dict[str, str]
    spec: dict
    health: dict
    kpis: DataFrame
    charts: DataFrame
    quality: DataFrame
    missing: DataFrame
    clean_summary: dict
    outlier_summary: dict

    def write(self, folder: str) -> None:
        """The artifacts of the run under one folder."""
        write_csv(self.cleaned, f"{folder}/cleaned")
        write_profile(self.profile, f"{folder}/profile")
        write_spec(self.cleaned.sparkSession, self.spec, f"{folder}/spec")
        write_charts(self.charts, f"{folder}/charts")
        self.kpis.coalesce(1).write.json(f"{folder}/kpis")
        self.quality.coalesce(1).write.json(f"{folder}/quality")


def run(df: DataFrame, rules: dict | None = None, source_name: str | None = None, order_by: str | None = None,
        contamination: float = vocab.CONTAMINATION, seed: int = vocab.SEED, strict: bool = False,
        min_success_ratio: float = PARSE_SHARE, min_non_null: float = 0.6, tol: float = 0.02) -> Run:
    """Everything from a raw table to checked chart data.

    ``order_by`` names the column that gives row order (``_pos`` of a scan, or a key). The table is written to the
    shared folder three times: with dates in place, cleaned, and flagged. Every step in between reads only the
    columns it needs from the last copy.
    """
    order_by = order_by or ("_pos" if "_pos" in df.columns else None)
    dated, date_columns = normalize_dates(df, min_success_ratio)
    dated = materialize(dated, "dated")  # raw text is parsed once, the dozen passes below read columns
    data_columns = [c for c in dated.columns if c != "_pos"]
    roles = {c: r for c, r in infer_types(dated, date_columns).items() if c in data_columns}
    table = profile(dated, profile_roles(dated.select(*data_columns), roles), order_by)

    tidy, summary = clean(dated, rules, order_by)
    tidy = materialize(tidy, "clean")
    rows_before, rows_after = dated.count(), tidy.count()
    summary["dropped_duplicates"] = rows_before - rows_after
    flagged, found = outliers.isolation_forest(tidy, contamination, seed, order_by)
    flagged = materialize(flagged.drop("_pos"), "flagged")
    counts = outliers.outlier_summary(flagged).first()
    found.update(outliers=counts["outliers"], ratio=counts["ratio"])

    drawn, spec = auto_spec(flagged, roles, source_name)
    health = validate_dashboard(drawn, spec, roles, min_non_null, tol)
    if strict and health["blocking"]:
        spec = safe_spec(flagged, roles, f"Dashboard seguro · {source_name or ''}")
    return Run(flagged, table, roles, spec, health, dashboard_kpis(drawn, spec), dashboard_data(drawn, spec),
               quality_summary(flagged, rows_before), missing_by_column(flagged), summary, found)
