"""Files for people: JSON reports, CSV tables, bar charts and plain-text summaries."""

from __future__ import annotations

import csv
import json
import os
from html import escape

from pyspark.sql import DataFrame


def write_json(path: str, value: object) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, sort_keys=True, default=str)
        f.write("\n")


def write_csv(path: str, df: DataFrame, most: int = 1_000_000) -> int:
    """A summary table as one file; a table of more rows belongs in Spark's own writer."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a summary; use df.write.csv")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        out.writerows([["" if v is None else f"{v:.6f}" if isinstance(v, float) else v for v in r] for r in rows])
    return len(rows)


def bar_chart(title: str, groups: list[tuple[str, list[float | None]]], series: list[str], unit: str = "") -> str | None:
    """An SVG of grouped bars; None unless some group has a value for every series."""
    if not any(all(v is not None for v in vs) for _, vs in groups):
        return None
    width, height, left, top, colours = 720, 320, 70, 50, ["#4269d0", "#efb118", "#3ca951"]
    most = max((v for _, vs in groups for v in vs if v is not None), default=0.0) or 1.0
    step = (width - left - 20) / max(len(groups), 1)
    bar = step * 0.8 / max(len(series), 1)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="11">', f'<text x="{left}" y="20" font-size="14">{escape(title)}</text>']
    for i, name in enumerate(series):
        out.append(f'<rect x="{left + i * 130}" y="28" width="10" height="10" fill="{colours[i % 3]}"/><text x="{left + 14 + i * 130}" y="37">{escape(name)}</text>')
    floor = height - 40
    out.append(f'<text x="5" y="{top + 5}">{most:.4g} {escape(unit)}</text><line x1="{left}" x2="{width - 20}" y1="{floor}" y2="{floor}" stroke="black"/>')
    for g, (label, vs) in enumerate(groups):
        for i, v in enumerate(vs):
            if v is not None:
                tall = (floor - top) * v / most
                out.append(f'<rect x="{left + g * step + i * bar:.1f}" y="{floor - tall:.1f}" width="{bar * 0.9:.1f}" height="{tall:.1f}" fill="{colours[i % 3]}"><title>{v:.6g}</title></rect>')
        out.append(f'<text x="{left + g * step:.1f}" y="{floor + 15}">{escape(label)}</text>')
    return "\n".join([*out, "</svg>"])


def summary_text(title: str, sections: dict[str, dict]) -> str:
    """A plain-text summary."""
    lines = [title, "=" * len(title)]
    for name, values in sections.items():
        lines += ["", name, "-" * len(name), *(f"{k}: {v}" for k, v in values.items())]
    return "\n".join(lines) + "\n"
