"""Map projection as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ConformalConic:
    """Lambert conformal conic with two standard parallels; angles in degrees."""

    parallel_1: float
    parallel_2: float
    lat_origin: float
    lon_origin: float
    false_easting: float
    false_northing: float
    semi_major: float
    inv_flattening: float

    @property
    def eccentricity(self) -> float:
        f = 1.0 / self.inv_flattening
        return math.sqrt(2.0 * f - f * f)

    def _isometric(self, phi: float) -> float:
        es = self.eccentricity * math.sin(phi)
        return math.tan(math.pi / 4 - phi / 2) / ((1 - es) / (1 + es)) ** (self.eccentricity / 2)

    def _scale(self, phi: float) -> float:
        return math.cos(phi) / math.sqrt(1 - (self.eccentricity * math.sin(phi)) ** 2)

    @property
    def constants(self) -> tuple[float, float, float]:
        """Cone constant n, a*F and the origin radius."""
        p1, p2, p0 = (math.radians(v) for v in (self.parallel_1, self.parallel_2, self.lat_origin))
        n = (math.log(self._scale(p1)) - math.log(self._scale(p2))) / (
            math.log(self._isometric(p1)) - math.log(self._isometric(p2))
        )
        af = self.semi_major * self._scale(p1) / (n * self._isometric(p1) ** n)
        return n, af, af * self._isometric(p0) ** n


# EPSG registry entry 3347 (Statistics Canada Lambert) on the GRS80 ellipsoid.
EPSG_3347 = ConformalConic(
    parallel_1=49.0,
    parallel_2=77.0,
    lat_origin=63.390675,
    lon_origin=-91.8666666666667,
    false_easting=6200000.0,
    false_northing=3000000.0,
    semi_major=6378137.0,
    inv_flattening=298.257222101,
)


def project_lcc(lon: Column, lat: Column, crs: ConformalConic = EPSG_3347) -> tuple[Column, Column]:
    """Projected (x, y) in metres of geographic coordinates in degrees."""
    n, af, rho0 = crs.constants
    e = crs.eccentricity
    phi = F.radians(lat)
    es = F.lit(e) * F.sin(phi)
    iso = F.tan(F.lit(math.pi / 4) - phi / F.lit(2.0)) / F.pow(
        (F.lit(1.0) - es) / (F.lit(1.0) + es), F.lit(e / 2)
    )
    rho = F.lit(af) * F.pow(iso, F.lit(n))
    theta = F.lit(n) * (F.radians(lon) - F.lit(math.radians(crs.lon_origin)))
    x = F.lit(crs.false_easting) + rho * F.sin(theta)
    y = F.lit(crs.false_northing + rho0) - rho * F.cos(theta)
    return x, y
