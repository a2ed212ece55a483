import pytest
from pyspark.sql import types as T

from tidecast import session
from tidecast.operators.joins import sized_broadcast
from tidecast.sources.tables import MissingSourceError, optional_csv, required_csv


class _Cluster:
    """Enough of a session to ask for a shared folder."""

    class conf:  # noqa: N801
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:  # noqa: N801
        master = "spark://somewhere:7077"


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(_Cluster)


def test_broadcast_only_up_to_a_size(spark):
    facts, side = spark.range(50), spark.range(20)
    small = facts.join(sized_broadcast(side), "id")
    large = facts.join(sized_broadcast(side, max_bytes=10), "id")
    assert small.count() == large.count() == 20
    hints = [j._jdf.queryExecution().analyzed().toString() for j in (small, large)]
    assert "broadcast" in hints[0].lower() and "broadcast" not in hints[1].lower()


def test_sources_are_asked_for_by_sparks_file_system(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a\n1\n")
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    for path in (f"{tmp_path}/x.csv", f"file://{tmp_path}/x.csv"):
        assert optional_csv(spark, path, schema).count() == 1
    assert optional_csv(spark, f"{tmp_path}/none.csv", schema).count() == 0
    with pytest.raises(MissingSourceError, match="none.csv"):
        required_csv(spark, f"{tmp_path}/none.csv", schema)
