"""Plots of small results as SVG files: bars of marginals, and matrices as coloured cells."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

#: What a plot shows at most; it says so if there is more.
MAX_BARS, MAX_CELLS = 40, 60
_REAL, _SYNTHETIC = "#4878a8", "#d88040"


def _document(width: float, height: float, parts: Iterable[str]) -> str:
    body = "\n".join(parts)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:.0f}" height="{height:.0f}" font-family="sans-serif" font-size="11">\n{body}\n</svg>\n'


def _text(x: float, y: float, text: str, **style) -> str:
    more = "".join(f' {k.replace("_", "-")}="{v}"' for k, v in style.items())
    return f'<text x="{x:.1f}" y="{y:.1f}"{more}>{escape(text)}</text>'


def _bar(x: float, y: float, width: float, height: float, fill: str) -> str:
    return f'<rect x="{x:.1f}" y="{y:.1f}" width="{width:.1f}" height="{height:.1f}" fill="{fill}"/>'


def _write(path: str | Path, text: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")


def marginal_bars(marginals: DataFrame, path: str | Path) -> None:
    """A panel per column_name of marginals(column_name, value, real_share, synthetic_share): both shares of the most frequent values."""
    names = [r["column_name"] for r in marginals.select("column_name").distinct().orderBy("column_name").collect()]
    parts, top = [], 10.0
    for name in names:
        mine = marginals.where(marginals["column_name"] == name)
        found = mine.orderBy((mine["real_share"] + mine["synthetic_share"]).desc(), "value").limit(MAX_BARS + 1).collect()
        rows = found[:MAX_BARS]
        parts.append(_text(10, top + 12, name + (" (most frequent values)" if len(found) > MAX_BARS else ""), font_weight="bold"))
        top += 20
        for r in rows:
            parts.append(_text(150, top + 11, str(r["value"])[:24], text_anchor="end"))
            parts.append(_bar(155, top + 1, 300 * r["real_share"], 6, _REAL))
            parts.append(_bar(155, top + 7, 300 * r["synthetic_share"], 6, _SYNTHETIC))
            top += 16
        top += 12
    parts += [
        _bar(155, top, 10, 10, _REAL), _text(169, top + 9, "real"), _bar(215, top, 10, 10, _SYNTHETIC),
        _text(229, top + 9, "synthetic")
    ]
    _write(path, _document(480, top + 24, parts))


def matrix_cells(cells: DataFrame, value: str, path: str | Path) -> None:
    """cells(a, b, value) as a matrix, darker for larger values; cells without a value are left white."""
    rows = cells.orderBy("a", "b").limit(MAX_CELLS * MAX_CELLS).collect()
    names = sorted({r["a"] for r in rows} | {r["b"] for r in rows})[:MAX_CELLS]
    place = {n: i for i, n in enumerate(names)}
    most = max((abs(r[value]) for r in rows if r[value] is not None), default=0.0) or 1.0
    parts = []
    for n, i in place.items():
        parts.append(_text(150, 45 + 20 * i, n[:24], text_anchor="end"))
        parts.append(_text(165 + 20 * i, 25, str(i + 1), text_anchor="middle"))
    for r in rows:
        if r["a"] in place and r["b"] in place and r[value] is not None:
            shade = round(255 * (1 - abs(r[value]) / most))
            parts.append(_bar(155 + 20 * place[r["b"]], 31 + 20 * place[r["a"]], 19, 19, f"rgb({shade},{shade},255)"))
    parts.append(_text(155, 50 + 20 * len(names), f"darkest: {most:.4g}"))
    _write(path, _document(180 + 20 * len(names), 70 + 20 * len(names), parts))
