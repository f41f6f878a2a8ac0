"""WITH RECURSIVE by rounds of DataFrames."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Rounds after which a query is taken to be endless.
MOST_ROUNDS = 10_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, as spark.checkpoint.dir names it; one of our own only where none is set and driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder or tempfile.mkdtemp(prefix="palimpsest")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def fixpoint(spark: SparkSession, base: DataFrame, step: Callable[[DataFrame], DataFrame], every: bool) -> DataFrame:
    """``base`` and what ``step`` makes of the last round's rows, until a round is empty.

    With ``every`` rows repeat (UNION ALL); else each round keeps only rows not seen before (UNION), so cycles end. Rounds
    are checkpointed, and the rows so far too every few rounds, so plans stay short and lost executors cost no restart.
    """
    rows = checkpointed(base if every else base.distinct())
    found, parts = rows, 0
    for _ in range(MOST_ROUNDS):
        if rows.isEmpty():
            return found
        new = step(rows)
        if not every:
            new = new.distinct().subtract(found)
        rows = checkpointed(new)
        found = found.unionAll(rows)
        parts += 1
        if parts % 16 == 0:
            found = checkpointed(found.coalesce(max(1, min(found.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism))))
    raise RuntimeError(f"recursion has not ended after {MOST_ROUNDS} rounds")
