import pytest
from pyspark.sql import functions as F

from tidecast.operators.features import reduced_dataset


def test_reduced_table_names_the_columns_it_lacks(spark):
    df = spark.range(3).select(F.current_date().alias("date"), F.lit("1").alias("start_station_id"))
    with pytest.raises(ValueError, match="total_rentals"):
        reduced_dataset(df, ["start_station_id"], "total_rentals")


def test_first_rows_by_a_grouped_least(spark):
    from tidecast.operators.daily import first_row

    rows = [(1, None, 5), (1, "b", None), (1, "b", 4), (2, None, 9), (None, "x", 1), (None, "a", 2)]
    df = spark.createDataFrame(rows, "k int, name string, n int").repartition(3)
    assert sorted(map(tuple, first_row(df, ["k"], ["name"], ["n"]).collect()), key=str) == sorted([(1, "b", None), (2, None, 9), (None, "a", 2)], key=str)
    assert sorted(map(tuple, first_row(df, ["k"], ["name", "n"]).collect()), key=str) == sorted([(1, "b", 4), (2, None, 9), (None, "a", 2)], key=str)
