from pyspark.sql import functions as F

from cairn.llm.components import _mark


def test_mark_of_many_edges(spark):
    """More edges than a sum of 40-bit numbers fits in a long (about 2^24)."""
    edges = spark.range(1 << 25).select((F.col("id") + 1).alias("a"), F.lit(0).cast("long").alias("b"))
    mark = _mark(edges)
    assert mark[0] == 1 << 25
    assert mark != _mark(edges.withColumn("b", F.when(F.col("a") == 7, 1).otherwise(0).cast("long")))


def test_forks_are_not_taken_for_stars(spark):
    """Edges that the first step leaves as they are, though two roots meet in one node."""
    from cairn.llm.components import connected_components

    got = connected_components(spark.createDataFrame([(3, 1), (3, 2), (9, 8)], "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}
