"""Explicit schemas of the survey inputs; nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T

from .vocabulary import TAXONOMY_RANKS

_S, _D = T.StringType(), T.DoubleType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, t, True) for name, t in fields.items()])


LONG_ABUNDANCE = T.StructType([
    T.StructField("lake_id", _S), T.StructField("Survey", _S),
    T.StructField("Target_taxon", _S), T.StructField("classic.group", _S),
    T.StructField("biovol", _D), T.StructField("total.biov", _D),
])
DATED_ABUNDANCE = struct(
    monitoring_location_name=_S, date_collected=_S, species_code=_S, density=_D, volume_cell=_D
)
SPECIES_CODES = struct(species_code=_S, genus=_S)
TROPHIC_TYPES = struct(species_code=_S, trophic_type=_S)
CHEMISTRY = struct(
    monitoring_location_name=_S, activity_start_date=_S, characteristic_name=_S,
    result_value=_D, result_unit=_S,
)
PHYSICAL = struct(
    monitoring_location_name=_S, longitude=_D, latitude=_D, area_surface=_D, depth_max=_D,
    order_lake=_S, mixing_status=_S,
)
TRAITS = T.StructType([T.StructField(r, _S) for r in [*TAXONOMY_RANKS, "strat"]])


def wide(key: str, taxa: list[str], dtype: T.DataType = _D) -> T.StructType:
    """A wide abundance matrix: a key column and one column per taxon."""
    return T.StructType([T.StructField(key, _S), *(T.StructField(t, dtype) for t in taxa)])
