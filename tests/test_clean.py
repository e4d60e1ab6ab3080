import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from precinct.functions import parse
from precinct.operators import clean
from precinct.schemas import NULL_TOKENS, RECOVERY, SUSPECT, THEFT
from precinct.sources.csv import export_csv, import_csv

THEFT_HEAD = (
    "incident_lat,incident_lon,vehicle_make,vehicle_model,vehicle_year,vehicle_type,vehicle_value,"
    "owner_name,owner_address,owner_lat,owner_lon,owner_income"
)
GOOD = "40.7282,-74.2090,Honda,Civic,2020,sedan,25000,Ann,1 Main St,40.73,-74.21,50000"


def _csv(tmp_path, head, *rows):
    path = tmp_path / "in.csv"
    path.write_text("\n".join([head, *rows]) + "\n")
    return str(path)


def test_theft_workflow(spark, tmp_path):
    from precinct.operators import filters, stats

    path = _csv(
        tmp_path, THEFT_HEAD, GOOD,
        "40.7300,-74.2100,Toyota,Camry,2019,sedan,28000,Bob,2 Main St,40.73,-74.21,60000",
        "40.7320,-74.2120,Ford,F-150,2021,truck,45000,Cat,3 Main St,40.73,-74.21,70000",
    )
    rows = import_csv(spark, path, THEFT)
    assert rows.count() == 3
    assert [r.vehicle_make for r in filters.thefts(rows, min_value=40000).collect()] == ["Ford"]
    summary = stats.theft_summary(rows).first()
    assert summary.total_value_stolen == 98000 and summary.income_median == 60000
    assert summary.most_stolen_make == "Ford"  # a tie, so the smallest
    assert filters.near_thefts(rows, (40.7282, -74.2090), 1).count() == 3
    assert rows.first().geometry.x == -74.2090


def test_each_reject_rule_alone(spark, tmp_path):
    def changed(**cells):
        return ",".join(cells.get(n, v) for n, v in zip(THEFT_HEAD.split(","), GOOD.split(",")))

    path = _csv(
        tmp_path, THEFT_HEAD, GOOD,
        changed(vehicle_make="N/A"), changed(owner_lat="north"), changed(incident_lat="200", incident_lon="-400"),
        changed(owner_lon="180.1"), changed(vehicle_year="unknown"), changed(vehicle_value="12k"),
        changed(owner_income="5d"), changed(incident_lat="90", incident_lon="-180"),
    )
    raw = spark.read.option("header", True).csv(path)
    counts = {r.reject_reason: r.n for r in clean.reject_counts(clean.classify(raw, THEFT)).collect()}
    assert counts == {
        "accepted": 2, "missing_required": 2, "invalid_coordinates": 2, "invalid_vehicle_year": 1,
        "invalid_vehicle_value": 1, "invalid_owner_income": 1,
    }
    seen = Observation()
    assert import_csv(spark, path, THEFT, observation=seen).count() == 2
    assert seen.get["rows_read"] == 9 and seen.get["invalid_coordinates"] == 2
    assert import_csv(spark, path, THEFT, validate_coordinates=False).count() == 4


def test_bad_coordinates_leave_nothing_without_error(spark, tmp_path):
    bad = GOOD.replace("40.7282,-74.2090", "200,-400")
    assert import_csv(spark, _csv(tmp_path, THEFT_HEAD, bad), THEFT).count() == 0


def test_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        import_csv(spark, str(tmp_path / "none.csv"), THEFT)
    with pytest.raises(ValueError, match="Missing required columns"):
        import_csv(spark, _csv(tmp_path, "incident_lat,incident_lon,vehicle_make", "1,2,Honda"), THEFT)
    with pytest.raises(ValueError, match="No valid data rows"):
        import_csv(spark, _csv(tmp_path, THEFT_HEAD, GOOD.replace("Honda", "None")), THEFT)


def test_suspect_bad_values_stay_as_nulls(spark, tmp_path):
    head = "suspect_name,suspect_age,suspect_address,address_lat,address_lon,last_arrest_date,arrest_location,arrest_lat,arrest_lon,bail_amount"
    path = _csv(
        tmp_path, head,
        "A,invalid,1 St,40.7,-74.2,invalid-date,Here,40.7,-74.2,not-a-number",
        '"B, Jr",35,2 St,40.7,-74.2,2024-01-15,Here,40.7,-74.2,5000',
        "C,30,3 St,91,-74.2,2024-01-15,Here,40.7,-74.2,1",
        "D,30,4 St,40.7,-74.2,01/15/2024 10:30,Here,40.7,-200,1",
    )
    rows = {r.suspect_name: r for r in import_csv(spark, path, SUSPECT).collect()}
    assert set(rows) == {"A", "B, Jr"}
    assert rows["A"].suspect_age is None and rows["A"].last_arrest_date is None and rows["A"].bail_amount is None
    assert rows["B, Jr"].suspect_age == 35


def test_recovery_flags_and_round_trip(spark, tmp_path):
    head = "recovery_date,recovery_lat,recovery_lon,recovery_location_name,vehicle_condition,incident_id,suspect_id,is_criminal_location,parts_missing"
    path = _csv(
        tmp_path, head,
        "2024-01-15,40.72,-74.20,Lot,Good,INC001,SUS001,True,None",
        "2024-01-16 10:00:00.5,40.72,-74.20,Lot,Poor,INC002,,no,doors",
        "2024-01-17,40.72,-74.20,Lot,Poor,,SUS003,Y,doors",
        ",40.72,-74.20,Lot,Poor,,SUS003,Y,doors",
    )
    rows = import_csv(spark, path, RECOVERY)
    assert [r.is_criminal_location for r in rows.orderBy("recovery_date").collect()] == [True, False, True]
    assert rows.orderBy("recovery_date").first().parts_missing is None
    export_csv(rows, str(tmp_path / "out"))
    again = import_csv(spark, str(tmp_path / "out"), RECOVERY)
    assert again.exceptAll(rows).isEmpty() and again.count() == 3


def test_null_tokens_numbers_and_flags(spark):
    texts = spark.createDataFrame([(t,) for t in NULL_TOKENS] + [("x",)], "t string")
    assert texts.where(parse.blank_to_null("t").isNotNull()).count() == 1
    cases = {"1": 1.0, " 2.5 ": 2.5, "1e3": 1000.0, ".5": 0.5, "1d": None, "0x10": None, "": None, "-3.": -3.0}
    numbers = spark.createDataFrame([(c,) for c in cases], "t string").select("t", parse.number("t").alias("n"))
    assert {r.t: r.n for r in numbers.collect()} == cases
    flags = {"TRUE": True, "y": True, "0": False, "No": False, "maybe": None, "t": None}
    got = spark.createDataFrame([(c,) for c in flags], "t string").select("t", parse.flag("t").alias("f"))
    assert {r.t: r.f for r in got.collect()} == flags
    assert spark.range(1).select(parse.whole(F.lit("2.6"))).first()[0] == 3
