"""Spatial joins within pages over a grid of square cells.

What lies on a page is dealt to the cells it touches, so a page with very many boxes
is spread over its cells and no page is a key by itself. Large regions are dealt only
to cells that hold something, however far they reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Side of a cell in pixels.
CELL = 128
#: Columns of the cell.
X, Y = "_cell_x", "_cell_y"


def _cell(place: Column) -> Column:
    return F.floor(place / CELL)


def points(rows: DataFrame, x: Column, y: Column) -> DataFrame:
    """Rows with the cell that holds (x, y)."""
    return rows.withColumns({X: _cell(x), Y: _cell(y)})


def boxes(rows: DataFrame, left: Column, top: Column, right: Column, bottom: Column) -> DataFrame:
    """Rows once per cell that the half-open box of positive area touches."""
    last = lambda end: F.ceil(end / CELL) - 1
    across = rows.withColumn(X, F.explode(F.sequence(_cell(left), last(right))))
    return across.withColumn(Y, F.explode(F.sequence(_cell(top), last(bottom))))


def meet(dealt: DataFrame, regions: DataFrame, page: str) -> DataFrame:
    """Every row of ``dealt`` with every region of its page that touches its cell.

    regions: page, x1, y1, x2, y2 and others. Pages and regions meet over the distinct
    cells in use only, which are far fewer than the rows."""
    cells = dealt.select(page, X, Y).distinct()
    touching = cells.join(regions, page).where(
        (F.col("x1") < (F.col(X) + 1) * CELL) & (F.col("x2") > F.col(X) * CELL) & (F.col("y1") < (F.col(Y) + 1) * CELL) & (F.col("y2") > F.col(Y) * CELL))
    return dealt.join(touching, [page, X, Y])
