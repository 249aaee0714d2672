"""Order of positions along a space-filling curve, so that near ones are stored together."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 16


def _step(value: Column, low: float, high: float) -> Column:
    """Number of the step of [low, high] that a value is in; values outside are in the first or last one."""
    steps = 1 << BITS
    share = (value - low) / (high - low)
    return F.greatest(F.lit(0), F.least(F.lit(steps - 1), F.floor(share * steps))).cast("long")


def _spread(number: Column) -> Column:
    """The bits of a 16-bit number with a zero before each."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        number = number.bitwiseOR(F.shiftleft(number, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return number


def place_on_curve(lon: Column, lat: Column) -> Column:
    """Z-order of a position (Morton, 1966): steps of longitude and latitude with their bits in turn.

    Steps are 0.0055 and 0.0027 degrees. A position that is null or no number has no place.
    """
    known = lon.isNotNull() & lat.isNotNull() & ~F.isnan(lon) & ~F.isnan(lat)
    place = _spread(_step(lon, -180.0, 180.0)).bitwiseOR(F.shiftleft(_spread(_step(lat, -90.0, 90.0)), 1))
    return F.when(known, place)
