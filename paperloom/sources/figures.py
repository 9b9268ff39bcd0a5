"""Figures as JSON specs over result tables; drawing is left to whoever shows them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

KINDS = ("bar", "line", "network", "chord", "choropleth", "heatmap", "scatter")


def spec(rows: DataFrame, kind: str, title: str, x: str, y: str, group: str | None = None, most: int = 500) -> dict:
    """A spec with the table's rows (result tables are small by their limits; ``most`` rows at the utmost)."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}")
    columns = list(dict.fromkeys(c for c in (x, y, group) if c))
    return {"kind": kind, "title": title, "x": x, "y": y, "group": group, "rows": [r.asDict() for r in rows.select(*columns).limit(most).collect()]}


def dumps(figure: dict) -> str:
    return json.dumps(figure, default=str, ensure_ascii=False)
