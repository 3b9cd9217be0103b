"""Schemas of the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

# The eleven columns of a query log, in file order.
QUERY_LOG = T.StructType(
    [
        T.StructField("full_query", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("user_inputs", T.StringType()),
        T.StructField("attack_stage", T.StringType()),
        T.StructField("tamper_method", T.StringType()),
        T.StructField("attack_status", T.StringType()),
        T.StructField("statement_type", T.StringType()),
        T.StructField("query_template_id", T.StringType()),
        T.StructField("attack_id", T.StringType()),
        T.StructField("attack_technique", T.StringType()),
        T.StructField("split", T.StringType()),
    ]
)

TEMPLATE_FILE = T.StructType(
    [
        T.StructField("template", T.StringType()),
        T.StructField("ID", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("payload_type", T.StringType()),
    ]
)

# Statement types and their share of the benign mix.
STATEMENT_SHARES = {"select": 0.7, "delete": 0.09, "update": 0.1, "insert": 0.1, "admin": 0.01}

# Attack techniques in campaign order.
TECHNIQUES = ("boolean", "error", "union", "stacked", "time", "inline")


def _decimal(p: int, s: int) -> T.DecimalType:
    return T.DecimalType(p, s)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()
_DEG = _decimal(10, 6)

# Base relations the airport statement templates talk about (constraints are checked
# by operators.workload.key_violations, not enforced by storage).
AIRPORT_TABLES = {
    "airport": _table(
        id=_I, ident=_S, type=_S, name=_S, latitude_deg=_DEG, longitude_deg=_DEG, elevation_ft=_I,
        continent=_S, iso_country=_S, iso_region=_S, municipality=_S, scheduled_service=_S,
        gps_code=_S, icao_code=_S, iata_code=_S, local_code=_S, home_link=_S, wikipedia_link=_S,
        keywords=_S,
    ),
    "airport_frequencies": _table(
        id=_I, airport_ref=_I, airport_ident=_S, type=_S, description=_S, frequency_mhz=_decimal(6, 3)
    ),
    "runways": _table(
        id=_I, airport_ref=_I, airport_ident=_S, length_ft=_I, width_ft=_I, surface=_S, lighted=_B,
        closed=_B, le_ident=_S, le_latitude_deg=_DEG, le_longitude_deg=_DEG, le_elevation_ft=_I,
        le_heading_degT=_decimal(5, 1), le_displaced_threshold_ft=_I, he_ident=_S,
        he_latitude_deg=_DEG, he_longitude_deg=_DEG, he_elevation_ft=_I,
        he_heading_degT=_decimal(5, 1), he_displaced_threshold_ft=_I,
    ),
    "navaids": _table(
        id=_I, filename=_S, ident=_S, name=_S, type=_S, frequency_khz=_I, latitude_deg=_DEG,
        longitude_deg=_DEG, elevation_ft=_I, iso_country=_S, dme_frequency_khz=_I, dme_channel=_S,
        dme_latitude_deg=_DEG, dme_longitude_deg=_DEG, dme_elevation_ft=_I,
        slaved_variation_deg=_decimal(7, 3), magnetic_variation_deg=_decimal(7, 3), usageType=_S,
        power=_S, associated_airport=_S,
    ),
    "countries": _table(id=_I, code=_S, name=_S, continent=_S, wikipedia_link=_S, keywords=_S),
    "regions": _table(
        id=_I, code=_S, local_code=_S, name=_S, continent=_S, iso_country=_S, wikipedia_link=_S,
        keywords=_S,
    ),
}
