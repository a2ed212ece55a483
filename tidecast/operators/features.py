"""Feature engineering and table reduction: time features, fixed projections, entity map."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.functions.scalars import minutes_of_day, tolerant_double
from tidecast.operators.daily import first_row


def add_time_features(df: DataFrame) -> DataFrame:
    """sunrise/sunset text -> minutes of day; daylight = sunset - sunrise when both exist."""
    out = df
    if "sunrise" in df.columns:
        out = out.withColumn("sunrise_minutes", minutes_of_day("sunrise"))
    if "sunset" in df.columns:
        out = out.withColumn("sunset_minutes", minutes_of_day("sunset"))
    if "sunrise_minutes" in out.columns and "sunset_minutes" in out.columns:
        out = out.withColumn("daylight_minutes", F.col("sunset_minutes") - F.col("sunrise_minutes"))
    return out


def add_time_index(df: DataFrame, date_col: str = "date", name: str = "time_idx") -> DataFrame:
    """Days since the table's first date, as double.

    The global minimum is a one-row aggregate joined back by broadcast (a
    one-row side, so no size check is needed); the fact table is not shuffled.
    """
    first = df.agg(F.min(date_col).alias("_min_date"))
    return (
        df.crossJoin(F.broadcast(first))
        .withColumn(name, F.datediff(F.col(date_col), F.col("_min_date")).cast("double"))
        .drop("_min_date")
    )


class MissingColumnsError(ValueError):
    pass


def require_columns(df: DataFrame, cols: Sequence[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"the table lacks {missing}")


def reduced_dataset(df: DataFrame, features: Sequence[str], target: str, id_col: str = "start_station_id") -> DataFrame:
    """Fixed feature list + target, id made numeric, numeric columns only, rows without id/target dropped."""
    if "sunset" in df.columns and "sunset_minutes" not in df.columns:
        df = df.withColumn("sunset_minutes", minutes_of_day("sunset"))
    df = add_time_index(df)
    require_columns(df, list(features) + [target])
    red = df.select(*features, target).withColumn(id_col, tolerant_double(id_col))
    numeric = {f.name for f in red.schema.fields if isinstance(f.dataType, T.NumericType)}
    final = [c for c in features if c in numeric] + [target]
    return red.select(*final).dropna(subset=[id_col, target])


def entity_map(df: DataFrame, id_col: str = "start_station_id", name_cols: Sequence[str] = ("start_station_name", "station_name_final"),
               order_cols: Sequence[str] = ("date",)) -> DataFrame:
    """First row per id (declared order: ``order_cols`` then names), id as number."""
    names = [c for c in name_cols if c in df.columns]
    order = [c for c in dict.fromkeys([*order_cols, *names]) if c in df.columns]
    first = first_row(df.select(id_col, *order), [id_col], order)
    return first.select(tolerant_double(id_col).alias(id_col), *names)


def reduced_summary(reduced: DataFrame, original_columns: Sequence[str], reduced_columns: Sequence[str]) -> DataFrame:
    """n_rows (counted by Spark) and the three column counts as (metric, value) rows."""
    n_removed = len([c for c in original_columns if c not in set(reduced_columns)])
    counts = reduced.agg(F.count(F.lit(1)).cast("long").alias("n_rows"))
    return counts.select(
        F.inline(
            F.array(
                F.struct(F.lit("n_rows").alias("metric"), F.col("n_rows").alias("value")),
                F.struct(F.lit("n_original_columns").alias("metric"), F.lit(len(original_columns)).cast("long").alias("value")),
                F.struct(F.lit("n_reduced_columns").alias("metric"), F.lit(len(reduced_columns)).cast("long").alias("value")),
                F.struct(F.lit("n_removed_columns").alias("metric"), F.lit(n_removed).cast("long").alias("value")),
            )
        )
    )
