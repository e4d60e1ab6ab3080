"""The three record views over the benchmark tables, in SQL text both engines accept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

THEFT = """
SELECT
  concat('INC', lpad(CAST(o.o_orderkey AS STRING), 8, '0')) AS incident_id,
  o.o_orderdate AS incident_date,
  CASE WHEN o.o_orderkey % 3 = 0
    THEN 40.655e0 + CAST(o.o_orderkey % 30 AS DOUBLE) / 30e0 * 0.09e0
         + CAST((o.o_orderkey * 7919) % 10007 AS DOUBLE) / 10007e0 * 0.002e0
    ELSE 40.65e0 + CAST((o.o_orderkey * 7919) % 10007 AS DOUBLE) / 10007e0 * 0.10e0 END AS incident_lat,
  CASE WHEN o.o_orderkey % 3 = 0
    THEN -74.275e0 + CAST((o.o_orderkey * 7) % 30 AS DOUBLE) / 30e0 * 0.12e0
         + CAST((o.o_orderkey * 104729) % 10009 AS DOUBLE) / 10009e0 * 0.002e0
    ELSE -74.28e0 + CAST((o.o_orderkey * 104729) % 10009 AS DOUBLE) / 10009e0 * 0.13e0 END AS incident_lon,
  p.p_brand AS vehicle_make,
  p.p_name AS vehicle_model,
  2000 + p.p_size % 25 AS vehicle_year,
  lower(p.p_type) AS vehicle_type,
  o.o_totalprice AS vehicle_value,
  c.c_name AS owner_name,
  c.c_mktsegment AS owner_address,
  40.55e0 + CAST((c.c_custkey * 7919) % 10007 AS DOUBLE) / 10007e0 * 0.30e0 AS owner_lat,
  -74.38e0 + CAST((c.c_custkey * 104729) % 10009 AS DOUBLE) / 10009e0 * 0.33e0 AS owner_lon,
  c.c_acctbal * 10e0 AS owner_income,
  CASE o.o_orderstatus WHEN 'F' THEN 'Recovered' WHEN 'O' THEN 'Not Recovered' ELSE 'Partial' END
    AS recovery_status,
  CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'Carjacking'
       WHEN o.o_orderpriority = '2-HIGH' THEN 'Breaking'
       WHEN o.o_orderpriority = '3-MEDIUM' THEN 'Key Theft'
       ELSE 'Unknown' END AS theft_method
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN part p ON p.p_partkey = o.o_orderkey % (SELECT count(*) FROM part)
"""

SUSPECT = """
SELECT
  concat('SUS', lpad(CAST(c.c_custkey AS STRING), 8, '0')) AS suspect_id,
  concat('Suspect ', CAST(c.c_custkey % 500 AS STRING)) AS suspect_name,
  CAST(18 + c.c_custkey % 47 AS INT) AS suspect_age,
  CASE WHEN c.c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS suspect_gender,
  CASE WHEN c.c_custkey % 3 = 0
    THEN 40.61e0 + CAST(c.c_custkey % 30 AS DOUBLE) / 30e0 * 0.18e0
         + CAST((c.c_custkey * 7919) % 10007 AS DOUBLE) / 10007e0 * 0.004e0
    ELSE 40.60e0 + CAST((c.c_custkey * 7919) % 10007 AS DOUBLE) / 10007e0 * 0.20e0 END AS address_lat,
  CASE WHEN c.c_custkey % 3 = 0
    THEN -74.34e0 + CAST((c.c_custkey * 7) % 30 AS DOUBLE) / 30e0 * 0.23e0
         + CAST((c.c_custkey * 104729) % 10009 AS DOUBLE) / 10009e0 * 0.004e0
    ELSE -74.35e0 + CAST((c.c_custkey * 104729) % 10009 AS DOUBLE) / 10009e0 * 0.25e0 END AS address_lon,
  40.55e0 + CAST((c.c_custkey * 6101) % 10007 AS DOUBLE) / 10007e0 * 0.30e0 AS arrest_lat,
  -74.40e0 + CAST((c.c_custkey * 15485863) % 10009 AS DOUBLE) / 10009e0 * 0.35e0 AS arrest_lon,
  a.last_arrest_date AS last_arrest_date,
  concat('Station ', CAST(c.c_nationkey % 4 AS STRING)) AS arrest_location,
  c.c_mktsegment AS arrest_charges,
  CASE WHEN c.c_acctbal < 0 THEN 'Critical' WHEN c.c_acctbal < 3000 THEN 'High'
       WHEN c.c_acctbal < 6000 THEN 'Medium' ELSE 'Low' END AS risk_level,
  CASE c.c_custkey % 6 WHEN 0 THEN 0e0 WHEN 1 THEN 5000e0 WHEN 2 THEN 10000e0 WHEN 3 THEN 25000e0
       WHEN 4 THEN 50000e0 ELSE 100000e0 END AS bail_amount,
  CASE c.c_custkey % 4 WHEN 0 THEN 'First Offense' WHEN 1 THEN 'Repeat Offender'
       WHEN 2 THEN 'Career Criminal' ELSE 'Juvenile Record' END AS criminal_history,
  CASE c.c_custkey % 5 WHEN 0 THEN 'Active' WHEN 1 THEN 'Paroled' WHEN 2 THEN 'Incarcerated'
       WHEN 3 THEN 'Released' ELSE 'Pending Trial' END AS conviction_status,
  CASE WHEN c.c_custkey % 11 <> 0 THEN CAST(c.c_custkey % 8 AS INT) END AS previous_arrests,
  CASE WHEN c.c_custkey % 13 <> 0 THEN concat('Job ', CAST(c.c_nationkey AS STRING)) END AS occupation
FROM customer c
LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_arrest_date FROM orders GROUP BY o_custkey) a
  ON a.o_custkey = c.c_custkey
"""

RECOVERY = """
SELECT
  concat('REC', lpad(CAST(e.event_id AS STRING), 8, '0')) AS recovery_id,
  e.ts AS recovery_date,
  40.60e0 + CAST((e.event_id * 7919) % 10007 AS DOUBLE) / 10007e0 * 0.20e0 AS recovery_lat,
  -74.35e0 + CAST((e.event_id * 104729) % 10009 AS DOUBLE) / 10009e0 * 0.25e0 AS recovery_lon,
  concat('Recovery Site ', CAST(e.event_id % 100 AS STRING)) AS recovery_location_name,
  CASE e.event_type WHEN 'signup' THEN 'Good' WHEN 'error' THEN 'Stripped' WHEN 'click' THEN 'Fair'
       WHEN 'view' THEN 'Poor' ELSE 'Burned' END AS vehicle_condition,
  CASE WHEN e.event_id % 10 < 7
    THEN concat('INC', lpad(CAST((e.event_id * 31) % (SELECT count(*) FROM orders) AS STRING), 8, '0')) END
    AS incident_id,
  CASE WHEN e.event_id % 5 < 2 THEN concat('SUS', lpad(CAST(e.user_id AS STRING), 8, '0')) END AS suspect_id,
  (e.event_id % 10 >= 7) AS is_criminal_location,
  CASE WHEN e.event_id % 10 >= 7 THEN CASE e.event_id % 3 WHEN 0 THEN 'Chop Shop'
       WHEN 1 THEN 'Abandoned Lot' ELSE 'Warehouse' END END AS criminal_location_type,
  concat('Agency ', CAST(e.user_id % 4 AS STRING)) AS recovery_agency,
  CASE e.event_id % 4 WHEN 0 THEN 'Open' WHEN 1 THEN 'Closed' WHEN 2 THEN 'Pending'
       ELSE 'Under Investigation' END AS case_status,
  CASE e.event_id % 5 WHEN 0 THEN 'Patrol' WHEN 1 THEN 'Tip' WHEN 2 THEN 'Investigation'
       WHEN 3 THEN 'Surveillance' ELSE 'Traffic Stop' END AS recovery_method
FROM events e
"""

_THEFT_KEY = "CAST(substr(t.incident_id, 4) AS INT)"

THEFT_RAW = f"""
SELECT
  t.incident_id AS incident_id,
  CASE WHEN {_THEFT_KEY} % 101 = 0 THEN '200' WHEN {_THEFT_KEY} % 103 = 0 THEN 'N/A'
       ELSE CAST(round(t.incident_lat, 6) AS STRING) END AS incident_lat,
  CAST(round(t.incident_lon, 6) AS STRING) AS incident_lon,
  CASE WHEN {_THEFT_KEY} % 107 = 0 THEN '-91' ELSE CAST(round(t.owner_lat, 6) AS STRING) END AS owner_lat,
  CAST(round(t.owner_lon, 6) AS STRING) AS owner_lon,
  CASE WHEN {_THEFT_KEY} % 109 = 0 THEN 'None' ELSE t.vehicle_make END AS vehicle_make,
  t.vehicle_model AS vehicle_model,
  t.vehicle_type AS vehicle_type,
  t.owner_name AS owner_name,
  t.owner_address AS owner_address,
  CASE WHEN {_THEFT_KEY} % 113 = 0 THEN 'unknown' ELSE CAST(t.vehicle_year AS STRING) END AS vehicle_year,
  CASE WHEN {_THEFT_KEY} % 127 = 0 THEN '12k' ELSE CAST(t.vehicle_value AS STRING) END AS vehicle_value,
  CASE WHEN {_THEFT_KEY} % 131 = 0 THEN 'low' ELSE CAST(t.owner_income AS STRING) END AS owner_income,
  CASE WHEN {_THEFT_KEY} % 137 = 0 THEN 'invalid-date' ELSE CAST(t.incident_date AS STRING) END
    AS incident_date
FROM theft t
"""

_SUSPECT_KEY = "CAST(substr(t.suspect_id, 4) AS INT)"

SUSPECT_RAW = f"""
SELECT
  t.suspect_id AS suspect_id,
  t.suspect_name AS suspect_name,
  CASE WHEN {_SUSPECT_KEY} % 17 = 0 THEN 'invalid' ELSE CAST(t.suspect_age AS STRING) END AS suspect_age,
  'somewhere' AS suspect_address,
  CASE WHEN {_SUSPECT_KEY} % 101 = 0 THEN '91' ELSE CAST(round(t.address_lat, 6) AS STRING) END
    AS address_lat,
  CAST(round(t.address_lon, 6) AS STRING) AS address_lon,
  CAST(round(t.arrest_lat, 6) AS STRING) AS arrest_lat,
  CASE WHEN {_SUSPECT_KEY} % 103 = 0 THEN '-200' ELSE CAST(round(t.arrest_lon, 6) AS STRING) END
    AS arrest_lon,
  t.arrest_location AS arrest_location,
  CASE WHEN {_SUSPECT_KEY} % 19 = 0 THEN 'invalid-date' ELSE CAST(t.last_arrest_date AS STRING) END
    AS last_arrest_date,
  CASE WHEN {_SUSPECT_KEY} % 23 = 0 THEN 'not-a-number' ELSE CAST(t.bail_amount AS STRING) END AS bail_amount
FROM suspect t
"""

_RECOVERY_KEY = "CAST(substr(t.recovery_id, 4) AS INT)"

RECOVERY_RAW = f"""
SELECT
  t.recovery_id AS recovery_id,
  CASE WHEN {_RECOVERY_KEY} % 29 = 0 THEN 'invalid-date' ELSE CAST(t.recovery_date AS STRING) END
    AS recovery_date,
  CASE WHEN {_RECOVERY_KEY} % 101 = 0 THEN '-90.5' ELSE CAST(round(t.recovery_lat, 6) AS STRING) END
    AS recovery_lat,
  CASE WHEN {_RECOVERY_KEY} % 103 = 0 THEN '180.5' ELSE CAST(round(t.recovery_lon, 6) AS STRING) END
    AS recovery_lon,
  t.recovery_location_name AS recovery_location_name,
  CASE WHEN {_RECOVERY_KEY} % 107 = 0 THEN 'NaN' ELSE t.vehicle_condition END AS vehicle_condition,
  CASE {_RECOVERY_KEY} % 7 WHEN 0 THEN 'true' WHEN 1 THEN '1' WHEN 2 THEN 'YES' WHEN 3 THEN 'y'
       WHEN 4 THEN 'No' WHEN 5 THEN 'maybe' ELSE 'FALSE' END AS is_criminal_location
FROM recovery t
"""

# Each view with the tables and views it reads.
SOURCES = {
    "theft": (THEFT, ["orders", "customer", "part"]),
    "suspect": (SUSPECT, ["customer", "orders"]),
    "recovery": (RECOVERY, ["events", "orders"]),
    "theft_raw": (THEFT_RAW, ["theft"]),
    "suspect_raw": (SUSPECT_RAW, ["suspect"]),
    "recovery_raw": (RECOVERY_RAW, ["recovery"]),
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A benchmark table, or one of the views above it."""
    if name not in SOURCES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text, tables = SOURCES[name]
    for table in tables:
        # bind each input by its own frame, so no session-wide view is left behind
        text = text.replace(f"FROM {table}", f"FROM {{{table}}}").replace(f"JOIN {table}", f"JOIN {{{table}}}")
    return spark.sql(text, **{t: load(spark, sf_dir, t) for t in tables})


def with_views(*names: str) -> str:
    """WITH clause defining the named views, in dependency order."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in SOURCES and name not in order:
            for needed in SOURCES[name][1]:
                add(needed)
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({SOURCES[n][0]})" for n in order)
