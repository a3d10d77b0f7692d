from pyspark.sql import functions as F

from strandwise.runtime import MOST_BYTES, checkpointed


def test_estimates_of_checkpoints_in_a_loop_are_bounded(spark):
    """A join of a checkpoint with itself squares its estimated size."""
    now = checkpointed(spark.range(4).select("id", ((F.col("id") + 1) % 4).alias("c")))
    for _ in range(7):
        other = now.select(F.col("id").alias("k"), F.col("c").alias("d"))
        now = checkpointed(now.join(other, F.col("c") == F.col("k")).select("id", F.col("d").alias("c")))
        assert now._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= MOST_BYTES
    assert sorted(map(tuple, now.collect())) == [(i, i) for i in range(4)]
