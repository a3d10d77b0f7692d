"""Session helpers: session defaults for local use, cutting lineage, size-checked broadcast."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast once it has been counted.
BROADCAST_ROWS = 200_000
#: Bytes of text up to which it may be, as its rows can be of any length.
BROADCAST_BYTES = 64 << 20
#: Bytes up to which the estimate of a checkpoint's size is kept.
MOST_BYTES = (1 << 63) - 1


def local_session(cores: str = "8", app: str = "strandwise", **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
    )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """Writes `df` to the shared checkpoint folder and reads it from there.

    The folder is the session's `spark.checkpoint.dir`. Only where none is set
    and the master is local, as in tests, a temporary one of this machine is
    used; on a cluster, whose executors would not see it, that is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="strandwise-", dir=os.environ.get("TMPDIR")))
    return bounded_estimate(df.checkpoint(eager=True))


def bounded_estimate(df: DataFrame) -> DataFrame:
    """`df`, a checkpoint, without Spark's estimate of its size if that is no long.

    A checkpoint keeps the estimate of what it was made of. For a join that is
    the product of both sides, so in a loop its digits double each round, or worse,
    until the driver has no memory for the number. Sizes beyond a long become
    the session's default; neither is ever broadcast, so plans stay the same.
    """
    plan = df._jdf.queryExecution().analyzed()
    try:
        if plan.stats().sizeInBytes() <= MOST_BYTES:
            return df
    except ValueError:  # more digits than Python reads as an int
        pass
    session, jvm = df.sparkSession._jsparkSession, df.sparkSession.sparkContext._jvm
    fresh = plan.copy(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), session, jvm.scala.Option.empty(), jvm.scala.Option.apply(plan.constraints()))
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, fresh), df.sparkSession)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`df`, which must be materialised, with a broadcast hint if it has at most `limit` rows, written as text in at most `most_bytes`."""
    n, size = df.limit(limit + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return F.broadcast(df) if n <= limit and size <= most_bytes else df
