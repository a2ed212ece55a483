"""Event rows -> daily table per entity (top-N, cleaning, counts, pivots, joins, calendar).

Plan shape at scale: one pruned scan for the top-N count (partial/final hash
aggregate, then TakeOrdered), a broadcast semi-join on the N ids (size bound N),
and ONE grouped aggregate with conditional counts that yields the total and
all pivot columns together. Hot entities are harmless here: the partial
aggregate collapses them map-side before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions.scalars import (
    calendar_columns,
    canonical_id,
    clean_string,
    count_column_name,
    tolerant_timestamp,
    underscore,
)
from tidecast.operators.joins import sized_broadcast

ID = "start_station_id"
NAME = "start_station_name"
TYPE = "rideable_type"
USER = "member_casual"
TS = "started_at"


def clean_events(df: DataFrame, id_col: str = ID, name_col: str = NAME) -> DataFrame:
    """Canonical id and trimmed name; rows without an id are dropped."""
    return (
        df.filter(F.col(id_col).isNotNull())
        .withColumn(id_col, canonical_id(id_col))
        .withColumn(name_col, clean_string(name_col))
    )


def entity_counts(df: DataFrame, id_col: str = ID) -> DataFrame:
    """Count of rows per entity id (all rows with an id, name not needed)."""
    return df.groupBy(id_col).agg(F.count(F.lit(1)).alias("total_rentals"))


def name_lookup(df: DataFrame, id_col: str = ID, name_col: str = NAME, ts_col: str = TS) -> DataFrame:
    """One representative name per id: the name of the latest event, ties by the larger name."""
    ts = tolerant_timestamp(ts_col)
    order = F.when(F.col(name_col).isNotNull(), F.struct(ts.alias("t"), F.col(name_col).alias("n")))
    return (
        df.filter(F.col(name_col).isNotNull())
        .groupBy(id_col)
        .agg(F.max_by(F.col(name_col), order).alias(name_col))
    )


def top_n_entities(
    df: DataFrame, n: int = 20, id_col: str = ID, name_col: str = NAME, ts_col: str = TS
) -> DataFrame:
    """Top-N ids by event count (ties: smaller id first) with rank 1..N and a representative name.

    ``df`` must already be cleaned (``clean_events``). Count and name come from
    ONE grouped aggregate (both combine map-side), then TakeOrdered keeps N rows.
    """
    ts = tolerant_timestamp(ts_col)
    order = F.when(F.col(name_col).isNotNull(), F.struct(ts.alias("t"), F.col(name_col).alias("n")))
    per_id = df.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("total_rentals"),
        F.max_by(F.col(name_col), order).alias(name_col),
    )
    top = per_id.orderBy(F.desc("total_rentals"), F.asc(id_col)).limit(n)
    ranked = top.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc("total_rentals"), F.asc(id_col))).cast("int")
    )
    return ranked.select("rank", id_col, "total_rentals", name_col)


def prepare_events(df: DataFrame, top_ids: DataFrame | None, id_col: str = ID, name_col: str = NAME) -> DataFrame:
    """Cleaning for the daily table: required fields, trimmed text, membership, parsed day.

    Rows with a null group key (id, name, type, user or bad time) are dropped,
    as grouped counting in the reference drops null keys.
    """
    d = df.dropna(subset=[TS, id_col, TYPE, USER])
    d = d.select(
        canonical_id(id_col).alias(id_col),
        clean_string(name_col).alias(name_col),
        clean_string(TYPE).alias(TYPE),
        clean_string(USER).alias(USER),
        F.to_date(tolerant_timestamp(TS)).alias("date"),
    )
    if top_ids is not None:
        d = d.join(F.broadcast(top_ids.select(id_col)), id_col, "left_semi")
    return d.filter(F.col("date").isNotNull() & F.col(name_col).isNotNull())


def long_counts(events: DataFrame, id_col: str = ID, name_col: str = NAME) -> DataFrame:
    """Count per (date, id, name, type, user)."""
    return events.groupBy("date", id_col, name_col, TYPE, USER).agg(F.count(F.lit(1)).alias("rentals_count"))


def daily_totals(long_df: DataFrame, id_col: str = ID, name_col: str = NAME) -> DataFrame:
    """Roll-up of the 5-key counts to (date, id, name)."""
    return long_df.groupBy("date", id_col, name_col).agg(F.sum("rentals_count").cast("long").alias("total_rentals"))


def _cond_count(pred: Column, weight: Column | None) -> Column:
    w = F.lit(1) if weight is None else weight
    return F.coalesce(F.sum(F.when(pred, w)), F.lit(0)).cast("long")


MAX_PIVOT_VALUES = 500


def pivot_values(events: DataFrame, types: Sequence[str] = (), users: Sequence[str] = ()) -> tuple[list[str], list[str], list[tuple[str, str]]]:
    """Types, users and their pairs that pivots need: those found in the events and the given ones.

    One small grouped aggregate over two columns; raises if the columns hold more
    than ``MAX_PIVOT_VALUES`` pairs, since each becomes a column.
    """
    found = events.select(clean_string(TYPE).alias(TYPE), clean_string(USER).alias(USER)).dropna().distinct().limit(MAX_PIVOT_VALUES + 1).collect()
    if len(found) > MAX_PIVOT_VALUES:
        raise ValueError(f"{TYPE} and {USER} have more than {MAX_PIVOT_VALUES} pairs of values to pivot on")
    all_types, all_users = sorted({*types, *(r[0] for r in found)}), sorted({*users, *(r[1] for r in found)})
    pairs = {(t, u) for t in types for u in users} | {(r[0], r[1]) for r in found}
    return all_types, all_users, sorted(pairs)


def pivot_columns(
    type_values: Sequence[str],
    user_values: Sequence[str],
    combos: Sequence[tuple[str, str]] | None = None,
    weight: Column | None = None,
) -> list[Column]:
    """Conditional-count columns for the three pivots, in the reference's column order.

    Combination columns come first (sorted by name), then the type columns
    (sorted by value), then the user columns (sorted by value). The lists come
    from ``pivot_values`` so that no value of the data is left out.
    """
    if combos is None:
        combos = [(t, u) for t in type_values for u in user_values]
    tcol, ucol = F.col(TYPE), F.col(USER)
    combo_cols = sorted(
        (count_column_name(t, u), (tcol == t) & (ucol == u)) for t, u in combos
    )
    cols = [_cond_count(p, weight).alias(n) for n, p in combo_cols]
    cols += [_cond_count(tcol == t, weight).alias(count_column_name(t)) for t in sorted(type_values)]
    cols += [_cond_count(ucol == u, weight).alias(count_column_name(u)) for u in sorted(user_values)]
    return cols


def daily_entity_table(
    events: DataFrame,
    type_values: Sequence[str],
    user_values: Sequence[str],
    combos: Sequence[tuple[str, str]] | None = None,
    id_col: str = ID,
    name_col: str = NAME,
) -> DataFrame:
    """Station-day table: total plus the three pivots in ONE grouped aggregate.

    Equal to: count per 5 keys -> total per 3 keys -> three pivots -> three
    left joins on the 3 keys -> fill 0, but with one shuffle instead of five.
    """
    return events.groupBy("date", id_col, name_col).agg(
        F.count(F.lit(1)).alias("total_rentals"), *pivot_columns(type_values, user_values, combos)
    )


def pivot_from_long(long_df: DataFrame, key: str, values: Sequence[str], id_col: str = ID, name_col: str = NAME) -> DataFrame:
    """A single pivot (sum of counts, fill 0) over the 5-key count table."""
    cols = [
        F.coalesce(F.sum(F.when(F.col(key) == v, F.col("rentals_count"))), F.lit(0)).cast("long").alias(count_column_name(v))
        for v in sorted(values)
    ]
    return long_df.groupBy("date", id_col, name_col).agg(*cols)


def pivot_combo_from_long(long_df: DataFrame, combos: Sequence[tuple[str, str]], id_col: str = ID, name_col: str = NAME) -> DataFrame:
    combo_cols = sorted((count_column_name(t, u), (F.col(TYPE) == t) & (F.col(USER) == u)) for t, u in combos)
    cols = [F.coalesce(F.sum(F.when(p, F.col("rentals_count"))), F.lit(0)).cast("long").alias(n) for n, p in combo_cols]
    return long_df.groupBy("date", id_col, name_col).agg(*cols)


def first_row(df: DataFrame, keys: Sequence[str], nulls_last: Sequence[str], nulls_first: Sequence[str] = ()) -> DataFrame:
    """The first row of each key by rising ``nulls_last`` columns, then ``nulls_first`` ones: a grouped least, combined before the shuffle, nothing is sorted."""
    parts = [x for c in nulls_last for x in (F.col(c).isNull(), F.col(c))] + [F.col(c) for c in nulls_first]
    order = F.struct(*[p.alias(f"o{i}") for i, p in enumerate(parts)])
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_first"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])


def clean_station_list(stations: DataFrame, id_col: str = "station_id", name_col: str = "station_name") -> DataFrame:
    """Trimmed id and name, one row per id (first by name, then by all columns as declared order)."""
    s = stations.withColumn(id_col, canonical_id(id_col)).withColumn(name_col, clean_string(name_col))
    return first_row(s, [id_col], [name_col], [c for c in s.columns if c not in (id_col, name_col)])


def clean_weather(weather: DataFrame, text_col: str = "datetime") -> DataFrame:
    """Parse the day, drop the text column, first row per day (declared order: the row's values)."""
    w = weather.withColumn("date", F.to_date(tolerant_timestamp(text_col))).drop(text_col)
    return first_row(w, ["date"], [c for c in w.columns if c != "date"])


def attach_dimensions(
    daily: DataFrame,
    stations: DataFrame | None,
    weather: DataFrame | None,
    id_col: str = ID,
    name_col: str = NAME,
) -> DataFrame:
    """Left joins to the station list (name fallback) and to daily weather, then calendar columns.

    Both dimensions are deduplicated first, so the joins stay n:1 and never
    multiply rows. Each is broadcast only after its size is checked.
    """
    out = daily
    if stations is not None:
        st = sized_broadcast(stations)
        out = out.join(st, out[id_col] == st["station_id"], "left").drop("station_id")
        out = out.withColumn("station_name_final", F.coalesce(F.col("station_name"), F.col(name_col))).drop("station_name")
    else:
        out = out.withColumn("station_name_final", F.col(name_col))
    if weather is not None:
        wb = sized_broadcast(weather)
        out = out.join(wb, out["date"] == wb["date"], "left").drop(wb["date"])
    return out.withColumns(calendar_columns("date"))


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key under a declared order (the order must make the choice unique)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
