from pyspark.sql import functions as F

from paths import SF_SMALL
from tidecast.operators import daily as D
from tidecast.plans import daily_jobs as DJ
from tidecast.plans.registry import queries
from tidecast.sources import fixtures as X
from tidecast.sources.tables import MissingSourceError, optional_csv, required_csv


def test_streaming_counts_equal_batch(spark):
    streamed = queries()["streaming_daily_counts"](spark, SF_SMALL)
    batch = D.daily_entity_table(D.prepare_events(X.trips(spark, SF_SMALL), None), DJ.TYPE_VALUES, DJ.USER_VALUES)
    assert sorted(streamed.collect()) == sorted(batch.select(*streamed.columns).collect())


def test_optional_and_required_sources(spark, tmp_path):
    missing = str(tmp_path / "nope.csv")
    assert optional_csv(spark, missing, X.STATION_SCHEMA).count() == 0
    try:
        required_csv(spark, missing, X.STATION_SCHEMA)
        raised = False
    except MissingSourceError as e:
        raised = "nope.csv" in str(e)
    assert raised


def test_roundtrips_preserve_rows(spark):
    qs = queries()
    daily = DJ.daily_table(spark, SF_SMALL)
    for name in ("csv_gz_roundtrip", "json_roundtrip"):
        back = qs[name](spark, SF_SMALL)
        assert back.count() == daily.count()


def test_scan_prunes_columns(spark):
    plan = queries()["scan_project"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_shipdate:timestamp_ntz>" in plan


def test_partials_of_replayed_and_interrupted_batches(spark, tmp_path):
    from tidecast.streaming import incremental as S

    trips = X.trips(spark, SF_SMALL)
    batches = [trips.where(F.pmod(F.xxhash64(*trips.columns), F.lit(3)) == k) for k in range(3)]
    out = str(tmp_path / "partials")
    write = lambda k, df: S.write_partial(df, k, out, DJ.TYPE_VALUES, DJ.USER_VALUES)
    schema = S.running_daily_counts(trips, DJ.TYPE_VALUES, DJ.USER_VALUES).schema
    merged = lambda: sorted(S.merged_partials(spark, out, schema, ["date", D.ID, D.NAME]).collect())
    assert merged() == []
    for k, df in enumerate(batches):
        write(k, df)
    write(1, batches[1])  # replayed: its partial is replaced
    whole = sorted(D.daily_entity_table(D.prepare_events(trips, None), DJ.TYPE_VALUES, DJ.USER_VALUES).collect())
    assert merged() == whole
    write(3, batches[0])  # a fourth batch that is cut off before its end mark is written
    (tmp_path / "partials" / "batch=3" / "_SUCCESS").unlink()
    assert merged() == whole


def test_stream_restarts_without_double_counts(spark, tmp_path):
    from tidecast.streaming import incremental as S

    rows = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    whole = lambda: S.merged_partials(spark, out, S.running_daily_counts(X.trips_from_lineitem(rows), DJ.TYPE_VALUES, DJ.USER_VALUES).schema, ["date", D.ID, D.NAME])
    for part in range(2):  # the second run sees the files of the first again
        rows.where(F.col("l_orderkey") % 2 == part).repartition(2).write.mode("append").parquet(source)
        S.run_to_partials(X.trips_from_lineitem(S.event_stream(spark, source, rows.schema, "*.parquet")), out, mark, DJ.TYPE_VALUES, DJ.USER_VALUES)
    batch = D.daily_entity_table(D.prepare_events(X.trips_from_lineitem(rows), None), DJ.TYPE_VALUES, DJ.USER_VALUES)
    assert sorted(whole().collect()) == sorted(batch.collect())
    assert len(S.finished_partials(spark, out)) == 4


def test_the_sorted_sink_rises_over_all_files(spark, tmp_path):
    from tidecast.sources.sinks import write_sorted_csv

    rows = spark.range(500).select(F.pmod(F.xxhash64("id"), F.lit(40)).cast("int").alias("station"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(90)).cast("int").alias("day"), "id").repartition(6)
    write_sorted_csv(rows, str(tmp_path / "out"), ["station", "day"])
    read = []
    for part in sorted((tmp_path / "out").glob("part-*.csv")):  # file after file, line after line
        read += [tuple(map(int, line.split(",")[:2])) for line in part.read_text().splitlines()[1:]]
    assert len(read) == 500 and read == sorted(read)
