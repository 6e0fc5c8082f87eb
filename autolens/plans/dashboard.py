"""The filtered dashboard: filters, KPIs, tables, charts and facts on one view."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ..functions import constants as K
from ..functions.names import col
from ..operators import schema as S
from ..operators.charts import ChartSpec, chart_data
from ..operators.filters import apply_filters
from ..operators.grouping import detail_table, grouped_table
from ..operators.kpis import Kpi, compute_kpis, default_kpis
from .analysis import insights

VIEW_INSIGHTS = 25


@dataclass(frozen=True)
class TableSpec:
    columns: tuple[str, ...] = ()
    group_by: str | None = None
    how: str | None = None
    limit: int | None = K.TABLE_ROWS


@dataclass
class Dashboard:
    """The datasets of a filtered view. `close()` releases what was kept for them."""

    view: DataFrame
    kpis: DataFrame
    charts: list[DataFrame | None]
    tables: list[DataFrame]
    rows: int
    original_rows: int
    types: dict[str, str] = field(default_factory=dict)
    kept: DataFrame | None = None

    def facts(self, limit: int = VIEW_INSIGHTS, model=None) -> DataFrame:
        """The facts of the view, computed from the view when asked for."""
        return insights(self.view, {c: t for c, t in self.types.items() if c in self.view.columns}, model=model, limit=limit)

    def close(self) -> None:
        if self.kept is not None:
            self.kept.unpersist()


def build_table(df: DataFrame, spec: TableSpec) -> DataFrame:
    columns = [c for c in spec.columns if c in df.columns] or df.columns[: K.TABLE_COLUMNS]
    if spec.group_by in df.columns and spec.how:
        return grouped_table(df, spec.group_by, columns, spec.how, spec.limit)
    return detail_table(df, columns, limit=spec.limit)


def _used_columns(df: DataFrame, kpis: Sequence[Kpi], charts: Sequence[ChartSpec], tables: Sequence[TableSpec]) -> list[str]:
    """What the datasets read, in table order."""
    used = {k.column for k in kpis}
    for c in charts:
        used |= {c.x, c.y, c.color, *c.columns, *c.key}
        if c.type.lower() == "heatmap" and not any(n in df.columns for n in c.columns):
            used |= set(S.columns_where(df, S.is_numeric))
    for t in tables:
        used |= {t.group_by, *([c for c in t.columns if c in df.columns] or df.columns[: K.TABLE_COLUMNS])}
    return [c for c in df.columns if c in used]


def dashboard(
    df: DataFrame, types: dict[str, str], filters: Mapping[str, Any] | None = None,
    kpis: Sequence[Kpi] | None = None, charts: Sequence[ChartSpec] = (),
    tables: Sequence[TableSpec] = (),
) -> Dashboard:
    """Everything a filtered view shows.

    The filter is part of every query's plan and reaches the scan. The columns that
    KPIs, charts and tables name are persisted, as each dataset reads some of them.
    """
    view = apply_filters(df, filters or {})
    wanted = kpis if kpis is not None else default_kpis(types)
    used = _used_columns(df, wanted, charts, tables)
    kept = view.select(*[col(c) for c in used]).persist(StorageLevel.MEMORY_AND_DISK)
    # A table without known columns shows the first ones of the whole view.
    tables = [t if any(c in used for c in t.columns) else replace(t, columns=tuple(df.columns[: K.TABLE_COLUMNS])) for t in tables]
    return Dashboard(
        view=view,
        kpis=compute_kpis(kept, wanted),
        charts=[chart_data(kept, c) for c in charts],
        tables=[build_table(kept, t) for t in tables],
        rows=kept.count(),
        original_rows=df.count(),
        types=types,
        kept=kept,
    )
