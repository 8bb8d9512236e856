"""Directions in degrees: classes and the circular mean."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotcast import fixed


def direction_class(degrees: Column) -> Column:
    """North, East, South or West over half-open quarters; the last quarter wraps to North."""
    edges = fixed.DIRECTION_EDGES
    wrapped = F.when(degrees >= edges[-1], F.lit(0)).otherwise(degrees)
    picked = None
    for name, low, high in zip(fixed.DIRECTIONS, edges, edges[1:]):
        inside = (wrapped >= low) & (wrapped < high)
        picked = F.when(inside, name) if picked is None else picked.when(inside, name)
    return picked


def normalise_degrees(degrees: Column) -> Column:
    return F.pmod(degrees, F.lit(360.0))


def circular_mean(degrees: Column, digits: int = 9) -> Column:
    """Aggregate: mean direction in [0, 360). Rounded, as sines of whole turns are not exactly 0.

    NULL when there is no value."""
    angle = F.radians(degrees)
    mean = F.degrees(F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle))))
    return normalise_degrees(F.round(normalise_degrees(mean), digits))
