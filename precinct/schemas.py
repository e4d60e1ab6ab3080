"""Column sets of the three record kinds and the text that counts as missing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Cell texts read as missing in CSV input.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Texts of a flag column, after lower-casing.
TRUE_TEXTS = ["true", "1", "yes", "y"]
FALSE_TEXTS = ["false", "0", "no", "n"]

CREATED_AT = "created_at"

_TYPES = {
    "string": T.StringType(),
    "double": T.DoubleType(),
    "int": T.IntegerType(),
    "timestamp": T.TimestampNTZType(),
    "boolean": T.BooleanType(),
}


@dataclass(frozen=True)
class Entity:
    """One record kind: typed columns, what must be present, where its points are."""

    name: str
    table: str
    key: str
    columns: dict[str, str]
    required: tuple[str, ...]
    # (latitude, longitude) pairs; the first one is the record's own location
    points: tuple[tuple[str, str], ...]
    # numeric columns whose bad cells reject the row, in checking order
    strict_numbers: tuple[str, ...] = ()
    flags: tuple[str, ...] = ()
    # stored text column per point pair
    wkt: tuple[str, ...] = ()

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, _TYPES[t]) for c, t in self.columns.items()])

    @property
    def stored_schema(self) -> T.StructType:
        extra = [T.StructField(c, T.StringType()) for c in self.wkt]
        created = T.StructField(CREATED_AT, T.TimestampNTZType())
        return T.StructType(list(self.schema) + extra + [created])

    @property
    def lat(self) -> str:
        return self.points[0][0]

    @property
    def lon(self) -> str:
        return self.points[0][1]


# The columns of the three record kinds.
THEFT = Entity(
    name="theft",
    table="theft_incidents",
    key="incident_id",
    columns={
        "incident_id": "string",
        "incident_date": "timestamp",
        "incident_lat": "double",
        "incident_lon": "double",
        "vehicle_make": "string",
        "vehicle_model": "string",
        "vehicle_year": "int",
        "vehicle_type": "string",
        "vehicle_value": "double",
        "vehicle_color": "string",
        "vehicle_vin": "string",
        "owner_name": "string",
        "owner_address": "string",
        "owner_lat": "double",
        "owner_lon": "double",
        "owner_income": "double",
        "owner_phone": "string",
        "owner_email": "string",
        "recovery_status": "string",
        "insurance_claim": "double",
        "police_report_id": "string",
        "theft_method": "string",
        "location_type": "string",
    },
    required=(
        "incident_lat", "incident_lon", "vehicle_make", "vehicle_model", "vehicle_year",
        "vehicle_type", "vehicle_value", "owner_name", "owner_address", "owner_lat",
        "owner_lon", "owner_income",
    ),
    points=(("incident_lat", "incident_lon"), ("owner_lat", "owner_lon")),
    strict_numbers=("vehicle_year", "vehicle_value", "owner_income"),
    wkt=("geometry_wkt", "owner_lat_owner_lon_geometry"),
)

SUSPECT = Entity(
    name="suspect",
    table="suspects",
    key="suspect_id",
    columns={
        "suspect_id": "string",
        "suspect_name": "string",
        "suspect_age": "int",
        "suspect_gender": "string",
        "suspect_address": "string",
        "address_lat": "double",
        "address_lon": "double",
        "suspect_phone": "string",
        "suspect_email": "string",
        "last_arrest_date": "timestamp",
        "arrest_location": "string",
        "arrest_lat": "double",
        "arrest_lon": "double",
        "arrest_charges": "string",
        "arrest_officer": "string",
        "case_number": "string",
        "bail_amount": "double",
        "court_date": "timestamp",
        "conviction_status": "string",
        "parole_status": "string",
        "risk_level": "string",
        "known_associates": "int",
        "criminal_history": "string",
        "gang_affiliation": "string",
    },
    required=(
        "suspect_name", "suspect_address", "address_lat", "address_lon",
        "last_arrest_date", "arrest_location", "arrest_lat", "arrest_lon",
    ),
    points=(("address_lat", "address_lon"), ("arrest_lat", "arrest_lon")),
    wkt=("address_geometry_wkt", "arrest_geometry_wkt"),
)

RECOVERY = Entity(
    name="recovery",
    table="recovery_incidents",
    key="recovery_id",
    columns={
        "recovery_id": "string",
        "recovery_date": "timestamp",
        "recovery_lat": "double",
        "recovery_lon": "double",
        "recovery_location_name": "string",
        "vehicle_condition": "string",
        "incident_id": "string",
        "suspect_id": "string",
        "recovery_agency": "string",
        "recovery_officer": "string",
        "vehicle_damage_assessment": "string",
        "parts_missing": "string",
        "recovery_method": "string",
        "recovery_time": "timestamp",
        "towed_to_location": "string",
        "insurance_notified": "boolean",
        "owner_notified": "boolean",
        "case_status": "string",
        "evidence_collected": "boolean",
        "notes": "string",
        "is_criminal_location": "boolean",
        "criminal_location_type": "string",
    },
    required=(
        "recovery_date", "recovery_lat", "recovery_lon", "recovery_location_name",
        "vehicle_condition",
    ),
    points=(("recovery_lat", "recovery_lon"),),
    flags=("is_criminal_location", "insurance_notified", "owner_notified"),
    wkt=("geometry_wkt",),
)

ENTITIES = {e.name: e for e in (THEFT, SUSPECT, RECOVERY)}
