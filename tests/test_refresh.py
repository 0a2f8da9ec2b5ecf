"""Replacing a derived table whole."""

import pytest
from pyspark.sql import functions as F

from mailgrain.operators import tables


def test_refresh_may_read_what_it_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.refresh(spark.range(5), path)
    again = tables.refresh(spark.read.parquet(path).withColumn("id", F.col("id") + 10), path)
    assert sorted(r["id"] for r in again.collect()) == [10, 11, 12, 13, 14]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["t"]
    parts = tables.refresh(spark.range(4).withColumn("p", F.col("id") % 2), path, ["p"])
    assert parts.count() == 4 and (tmp_path / "t" / "p=1").exists()


def test_a_stop_at_any_point_leaves_a_whole_table(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.refresh(spark.range(5), path)

    def broken(batches):
        yield from batches
        raise ValueError("stop")

    with pytest.raises(Exception, match="stop"):
        tables.refresh(spark.range(9).mapInPandas(broken, "id long"), path)
    assert tables.recover(spark, path) and spark.read.parquet(path).count() == 5
    # stopped after the old table was deleted
    spark.range(9).write.mode("overwrite").parquet(path + tables.STAGED)
    files, folder = tables._filesystem(spark, path)
    files.delete(folder, True)
    assert tables.recover(spark, path) and spark.read.parquet(path).count() == 9
    assert not tables.recover(spark, str(tmp_path / "none"))
