"""Grid cells for a Chebyshev band join.

A train value falls in one cell. A test value, padded by the radius, touches at most
two. The cell is four radii wide, so the padded interval is shorter than a cell and
every train value within the radius lies in a touched cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def cell_width(radius: float, largest: float) -> float:
    """Four radii, but never below the precision of the largest value in the column."""
    return max(4.0 * radius, largest * 2.0**-40) or 1.0


def padding(radius: float | Column, largest: float) -> float | Column:
    """The radius plus room for rounding; twice this stays below ``cell_width``."""
    return radius + largest * 2.0**-45


def home_cell(value: Column, width: float) -> Column:
    return F.floor(value / F.lit(width))


def touched_cells(value: Column, width: float, pad: float | Column) -> Column:
    return F.explode(
        F.array_distinct(F.array(home_cell(value - F.lit(pad), width), home_cell(value + F.lit(pad), width)))
    )


def touched_count(value: Column, width: float, pad: float) -> Column:
    return home_cell(value + F.lit(pad), width) - home_cell(value - F.lit(pad), width) + 1


def within(left: Sequence[str], right: Sequence[str], radius: float | str) -> Column:
    """Every difference is inside the radius, a number or the name of a column; the first one outside ends the comparison."""
    bound = radius if isinstance(radius, str) else f"{radius!r}D"
    return F.expr(" AND ".join(f"abs({a} - {b}) <= {bound}" for a, b in zip(left, right, strict=True)))


def chebyshev(left: Sequence[str], right: Sequence[str]) -> Column:
    gaps = [f"abs({a} - {b})" for a, b in zip(left, right, strict=True)]
    return F.expr(gaps[0] if len(gaps) == 1 else f"greatest({', '.join(gaps)})")
