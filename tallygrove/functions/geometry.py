"""Places on a hexagonal grid."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_center(row: Column, column: Column, size: float = 1.0, pointy: bool = True) -> tuple[Column, Column]:
    """Odd rows (or, flat-topped, odd columns) are shifted by half a cell."""
    wide = math.sqrt(3) * size
    if pointy:
        return wide * (column + 0.5 * (row % 2)), 1.5 * size * row
    return 1.5 * size * column, wide * (row + 0.5 * (column % 2))


def hex_polygon(x: Column, y: Column, size: float = 1.0, pointy: bool = True) -> Column:
    """Seven corners; the last closes the first."""
    start = 90 if pointy else 0
    turn = [math.radians(start + 60 * k) for k in range(6)] + [math.radians(start)]
    return F.array(*[F.struct((x + size * math.cos(a)).alias("x"), (y + size * math.sin(a)).alias("y")) for a in turn])
