"""Writers that replace a table, and needles that read like patterns."""

from pyspark.sql import functions as F

from lexispark.operators import highlight as H
from lexispark.sources import writers


def test_replace_a_table_read_from_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    writers.replace_parquet(spark.read.parquet(path).where("id > 2"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [3, 4]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_needles_that_read_like_patterns(spark):
    d = spark.createDataFrame([("a \\E( b \\E( c", "\\E(", 2), ("x.y x.y", "X.Y", 2), ("abc", "\\Q", 1)], "t string, n string, k int")
    got = d.select(H.locate_occurrence(F.col("t"), F.col("n"), F.col("k")).alias("at")).collect()
    assert [r.at for r in got] == [8, 4, None]
