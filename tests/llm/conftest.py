import duckdb
import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def make_docs(spark):
    """Rows (doc_id, text) as a documents table."""
    return lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], DOCS)


@pytest.fixture
def oracle():
    """Rows of DuckDB SQL over named pandas or Arrow tables or a folder of parquet files."""

    def run(sql, sf_dir=None, **tables):
        con = duckdb.connect()
        for name in ("documents", "benchmark", "pages", "conversations", "labels"):
            if name in tables:
                con.register(name, tables[name])
            elif sf_dir:
                con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
        return con.execute(sql).df()

    return run
