"""Column functions of sea water, grids and the calendar."""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of 1, T, S, T², S T, T³, S T² in the potential density polynomial (kg/m³ - 1000, 2000 dbar).
SIGMA2 = (9.77093e00, -2.26493e-02, 7.89879e-01, -6.43205e-03, -2.62983e-03, 2.75835e-05, 3.15235e-05)
#: Earth's radius in km, and the length of a degree in km by which areas and wavelengths are reckoned.
RADIUS_KM, KM_A_DEGREE = 6371.0, 111.32
#: Fixed values of the sun's path: W/m² at the mean distance, the axis's tilt in degrees, days from the March equinox
#: to the turn of the year, the share by which the distance changes the radiation, days of its round.
SOLAR, OBLIQUITY, FROM_EQUINOX, SWING, ROUND = 1361.0, 23.44, 284, 0.033, 365


class Box(NamedTuple):
    """A part of the map between meridians and parallels, in degrees."""

    west: float = -math.inf
    south: float = -math.inf
    east: float = math.inf
    north: float = math.inf

    def holds(self, lon: Column, lat: Column, edges: bool) -> Column:
        """Whether a place lies in the box, its edges included or not."""
        bounds = [(lon, self.west, 1), (lat, self.south, 1), (lon, self.east, -1), (lat, self.north, -1)]
        sides = [(c - F.lit(bound)) * sign for c, bound, sign in bounds if math.isfinite(bound)]
        return reduce(Column.__and__, [side >= 0 if edges else side > 0 for side in sides], F.lit(True))


class Region(NamedTuple):
    """What lies in one of ``parts`` and in none of ``holes``. Edges belong to the region only if ``closed``."""

    parts: tuple[Box, ...] = (Box(),)
    holes: tuple[Box, ...] = ()
    closed: bool = True

    def holds(self, lon: Column, lat: Column) -> Column:
        inside = reduce(Column.__or__, [box.holds(lon, lat, self.closed) for box in self.parts])
        return reduce(lambda rest, box: rest & ~box.holds(lon, lat, not self.closed), self.holes, inside)


#: The cuts of each region.
REGIONS = {
    "west of the straits": Region(parts=(Box(south=21.5, east=-81.0),)),
    "basin": Region(holes=(Box(west=-87.5, north=21.5), Box(west=-84.0, north=22.75), Box(west=-81.0))),
    "eddies": Region(parts=(Box(south=24.0), Box(east=-87.0)), closed=False),
}


def sigma2(t: Column, s: Column) -> Column:
    """Potential density anomaly, by Horner's rule."""
    c1, c2, c3, c4, c5, c6, c7 = SIGMA2
    return c1 + c3 * s + t * (c2 + c5 * s + t * (c4 + c7 * s + c6 * t))


def cell_km(lat: Column, degrees: float = 0.04) -> Column:
    """Side of a Mercator cell."""
    return RADIUS_KM * math.radians(degrees) * F.cos(F.radians(lat))


def phase(day: Column) -> Column:
    """The middle of the day as an angle of its year, whose length is the number of its last day."""
    last = F.make_date(F.year(day), F.lit(12), F.lit(31))
    return F.radians((F.dayofyear(day) - 0.5) * 360 / F.dayofyear(last))


def solar_position(day: Column) -> tuple[Column, Column]:
    """Sine of the sun's declination, and the square of the mean distance over the day's; leap years don't lengthen the round."""
    turn = 2 * math.pi / ROUND
    declination = math.radians(OBLIQUITY) * F.sin((F.dayofyear(day) + FROM_EQUINOX) * turn)
    return F.sin(declination), F.cos(F.dayofyear(day) * turn) * SWING + 1


def insolation(day: Column, lat: Column) -> Column:
    """Mean over the day of the radiation on a level plane above the air.

    The sun's height has the sine ``mid + swing * cos(hour)``; its mean is taken over the hours in which that is positive.
    """
    sine, closeness = solar_position(day)
    mid, swing = F.sin(F.radians(lat)) * sine, F.cos(F.radians(lat)) * F.sqrt(1 - sine * sine)
    sunset = F.when(mid >= swing, -1.0).when(-mid >= swing, 1.0).otherwise(-mid / swing)  # cosine of the hour
    lit = mid * F.acos(sunset) + swing * F.sqrt(1 - sunset * sunset)
    return lit * closeness * (SOLAR / math.pi)


def in_region(name: str, lon: Column, lat: Column) -> Column:
    return REGIONS[name].holds(lon, lat)


def band_mask(rate: Column, invalid: float = 1e29, days: float = 10.0) -> Column:
    """Whether a relaxation rate exceeds one in so many days; fills count as 0."""
    return F.when(F.abs(rate) < invalid, rate).otherwise(0.0) > 1 / (86400 * days)


def valid(value: Column, fill: float = 1e29) -> Column:
    """The value, or null where it is not finite or a fill."""
    return F.when(~F.isnan(value) & (F.abs(value) < fill), value)
