"""DuckDB text of the domain views, used to build oracle SQL.

Each constant is one CTE body; ``with_views`` prefixes a query with the views it names.
The definitions mirror ``tidecast.sources.fixtures`` column for column.
"""

from __future__ import annotations

WS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def canon(x: str) -> str:
    return rf"regexp_replace({strip(x)}, '^([0-9]+)\.0+$', '\1')"


def to_day(x: str) -> str:
    return f"CAST(try_cast({strip(x)} AS TIMESTAMP) AS DATE)"


VIEWS: dict[str, str] = {
    "trips": """
SELECT CASE WHEN l_partkey % 97 = 0 THEN 'bad' ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS started_at,
       ' ' || CAST(l_suppkey AS VARCHAR) || ' ' AS start_station_id,
       CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE 'Station ' || CAST(l_suppkey AS VARCHAR) END AS start_station_name,
       CASE l_returnflag WHEN 'A' THEN 'classic bike' WHEN 'N' THEN 'electric_bike' ELSE 'docked_bike' END AS rideable_type,
       CASE WHEN l_linestatus = 'F' THEN 'member' ELSE 'casual' END AS member_casual
FROM lineitem""",
    "station_list": """
SELECT CAST(s_suppkey AS VARCHAR) AS station_id,
       CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS station_name,
       s_nationkey AS station_region
FROM supplier""",
    "weather": """
SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS datetime,
       max(o_totalprice) / 10000 AS tempmax, min(o_totalprice) / 10000 AS tempmin,
       avg(CAST(o_custkey % 10 AS DOUBLE)) AS precip,
       avg(CAST(o_custkey % 10 AS DOUBLE)) * 2 + 1 AS precipcover,
       CAST(count(*) AS DOUBLE) AS windspeed, CAST(0 AS DOUBLE) AS snow,
       '2020-01-01 06:' || lpad(CAST(min(o_custkey) % 60 AS VARCHAR), 2, '0') || ':00' AS sunrise,
       '2020-01-01 18:' || lpad(CAST(count(*) % 60 AS VARCHAR), 2, '0') || ':00' AS sunset
FROM orders GROUP BY CAST(o_orderdate AS DATE)""",
    "train_table": """
SELECT o_orderkey AS id, CAST(o_custkey % 20 AS DOUBLE) AS start_station_id,
       CAST(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS time_idx,
       CAST(month(o_orderdate) AS INTEGER) AS month, CAST(year(o_orderdate) AS INTEGER) AS year,
       o_totalprice / 100000 AS x1, CAST(o_custkey % 50 AS DOUBLE) / 10 AS x2,
       CAST(CASE WHEN o_orderkey % 101 = 0 THEN CAST(0 AS DOUBLE)
            ELSE floor(20 + 5 * month(o_orderdate) + 6 * (CAST(o_custkey % 50 AS DOUBLE) / 10) + 10 * (o_totalprice / 100000))
                 + CAST((o_orderkey * 7919) % 13 AS DOUBLE) END AS DOUBLE) AS total_rentals
FROM orders""",
    "predictions": """
SELECT id, time_idx, start_station_id, total_rentals,
       30 + 5 * month + 5 * x2 AS prediction,
       total_rentals - (30 + 5 * month + 5 * x2) AS residual
FROM train_table""",
    "knn_points": """
SELECT vec_id, CAST(embedding AS DOUBLE[]) AS features,
       CAST(label AS DOUBLE) AS label,
       CASE WHEN vec_id % 5 = 0 THEN 'query' ELSE 'train' END AS role
FROM embeddings""",
}

# Views that other views read.
DEPENDS = {"predictions": ["train_table"]}


def with_views(names: list[str], body: str, extra: list[tuple[str, str]] | None = None, recursive: bool = False) -> str:
    """``WITH`` clause holding the named views (dependencies first), extra CTEs, then ``body``."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({VIEWS[n]}\n)" for n in order]
    ctes += [f"{n} AS ({q}\n)" for n, q in (extra or [])]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(ctes) + "\n" if ctes else "") + body
