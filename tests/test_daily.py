from pyspark.sql import functions as F

from paths import SF_SMALL
from tidecast.functions.scalars import canonical_id, clean_string, minutes_of_day
from tidecast.operators import daily as D
from tidecast.plans import daily_jobs as DJ


def test_canonical_id_forms(spark):
    df = spark.createDataFrame([("31000",), ("31000.0",), (" 31000 ",), ("\t31000",), ("A-7",), (None,)], "x string")
    got = [r[0] for r in df.select(canonical_id("x")).collect()]
    assert got == ["31000", "31000", "31000", "31000", "A-7", None]


def test_clean_string_strips_tabs_and_newlines(spark):
    df = spark.createDataFrame([("\t a b \n",)], "x string")
    assert df.select(clean_string("x")).first()[0] == "a b"


def test_minutes_of_day(spark):
    df = spark.createDataFrame([("2020-01-01 18:05:00",), ("06:30:00",), ("bad",)], "x string")
    assert [r[0] for r in df.select(minutes_of_day("x")).collect()] == [1085, 390, None]


def _events(spark, rows):
    return spark.createDataFrame(rows, "started_at string, start_station_id string, start_station_name string, rideable_type string, member_casual string")


def test_top_n_ties_and_name_rule(spark):
    rows = [
        ("2024-01-01", "2", "B old", "classic bike", "member"),
        ("2024-01-02", "2", "B new", "classic bike", "member"),
        ("2024-01-01", "1", None, "classic bike", "member"),
        ("2024-01-01", "1", "A", "classic bike", "member"),
        ("2024-01-01", "3", "C", "classic bike", "member"),
    ]
    top = D.top_n_entities(D.clean_events(_events(spark, rows)), 2).orderBy("rank").collect()
    assert [(r["rank"], r["start_station_id"], r["total_rentals"], r["start_station_name"]) for r in top] == [
        (1, "1", 2, "A"), (2, "2", 2, "B new")]


def test_null_name_counted_in_top_n_but_absent_from_daily(spark):
    rows = [("2024-01-01", "9", None, "classic bike", "member"), ("2024-01-01", "9", "N", "classic bike", "member"),
            ("bad", "9", "N", "classic bike", "member")]
    ev = _events(spark, rows)
    top = D.top_n_entities(D.clean_events(ev), 5).collect()
    assert top[0]["total_rentals"] == 3
    daily = D.daily_entity_table(D.prepare_events(ev, None), ["classic bike"], ["member"]).collect()
    assert len(daily) == 1 and daily[0]["total_rentals"] == 1


def test_fused_daily_equals_five_step_form(spark):
    ev = DJ.prepared_events(spark, SF_SMALL)
    fused = DJ.daily_table(spark, SF_SMALL)
    long = D.long_counts(ev)
    keys = ["date", D.ID, D.NAME]
    joined = (D.daily_totals(long).join(D.pivot_combo_from_long(long, DJ.COMBOS), keys, "left")
              .join(D.pivot_from_long(long, D.TYPE, DJ.TYPE_VALUES), keys, "left")
              .join(D.pivot_from_long(long, D.USER, DJ.USER_VALUES), keys, "left"))
    cols = fused.columns
    assert sorted(fused.collect()) == sorted(joined.select(*cols).fillna(0).collect())


def test_dimension_dedupe_keeps_join_n_to_1(spark):
    daily = spark.createDataFrame([("2024-01-01", "1", "A", 3)], "date string, start_station_id string, start_station_name string, total_rentals long") \
        .withColumn("date", F.to_date("date"))
    stations = spark.createDataFrame([("1", "Zed"), ("1", "Alpha"), ("2", None)], "station_id string, station_name string")
    weather = spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-01", 2.0)], "datetime string, tempmax double")
    out = D.attach_dimensions(daily, D.clean_station_list(stations), D.clean_weather(weather)).collect()
    assert len(out) == 1
    assert out[0]["station_name_final"] == "Alpha" and out[0]["tempmax"] == 1.0
    assert (out[0]["weekday"], out[0]["is_weekend"]) == (0, 0)


def test_daily_plan_has_one_aggregate_shuffle_after_top_n(spark):
    plan = DJ.daily_table(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


def test_ids_that_only_parse_as_numbers_stay_apart(spark):
    forms = ["31000D", "31000f", "1E003", "0x1p3", "007", "7", "31000.00", "-5.0"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in forms], "x string").select(canonical_id("x")).collect()]
    assert got == ["31000D", "31000f", "1E003", "0x1p3", "007", "7", "31000", "-5.0"]


def test_pivots_hold_every_value_of_the_data(spark):
    rows = [("2024-01-01", "9", "N", "scooter", "member"), ("2024-01-01", "9", "N", "classic bike", "guest"), ("2024-01-01", "9", "N", None, "member")]
    ev = _events(spark, rows)
    types, users, pairs = D.pivot_values(ev, DJ.TYPE_VALUES, DJ.USER_VALUES)
    assert set(types) == {*DJ.TYPE_VALUES, "scooter"} and set(users) == {*DJ.USER_VALUES, "guest"} and ("scooter", "member") in pairs
    row = D.daily_entity_table(D.prepare_events(ev, None), types, users, pairs).first()
    assert row["total_rentals"] == 2 == sum(row[f"{t.replace(' ', '_')}_count"] for t in types) == sum(row[f"{u}_count"] for u in users)
    assert row["scooter_member_count"] == 1 and row["classic_bike_guest_count"] == 1
