"""What the operators share: shared-folder checkpoints, bucketed running sums, word boundaries."""

from __future__ import annotations

import math
import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, which ends words in most operators here.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, as spark.checkpoint.dir names it; one of our own only where none is set and driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder or tempfile.mkdtemp(prefix="shared")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def partitions_of(df: DataFrame) -> int:
    """How many partitions a shuffle of ``df`` should have at least: as many as the session sets, and as many as its input, which grows with its bytes."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df._jdf.queryExecution().toRdd().getNumPartitions())


def fresh(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread(rows: int) -> int:
    """Buckets for so many rows: about as many as a bucket has rows, so neither a group nor a list of groups gets large."""
    return max(16, math.isqrt(max(0, rows)))


def running_sum(df: DataFrame, group: list[str], bucket: str, order: list[Column], amount: Column, out: str) -> DataFrame:
    """``out`` is the sum of ``amount`` over the rows before, within ``group`` by ``bucket`` and then ``order``.

    Two levels: sums per (group, bucket) first, so that no task sorts a whole hot group.
    ``df`` is read twice and must be cheap (checkpointed). The group columns must not be null.
    """
    keys = [*group, bucket]
    sums = df.groupBy(*keys).agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(base, keys).withColumn(out, F.col("_base") + F.coalesce(F.sum(amount).over(inner), F.lit(0))).drop("_base")


def global_index(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Number the rows from 0 in ``order`` after a distributed sort; only one count per partition reaches the driver."""
    spark = df.sparkSession
    rows = checkpoint(df.orderBy(*order)).withColumn("_at", F.monotonically_increasing_id())
    rows = rows.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = sorted(tuple(r) for r in rows.groupBy("_part").count().collect())
    starts, n = [], 0
    for part, count in counts:
        starts.append((part, n))
        n += count
    first = spark.createDataFrame(starts, "_part long, _first long")
    return rows.join(F.broadcast(first), "_part").withColumn(out, F.col("_first") + F.col("_at")).drop("_part", "_at", "_first")


def slices(batch, column: str = "text", most: int = 1 << 22):
    """Consecutive parts of an Arrow batch with at most ``most`` bytes of text each, but one row at least; this bounds a worker's memory."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def text_bytes(column) -> list[bytes]:
    """UTF-8 of an Arrow string column; null counts as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def texts(column) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def crc_fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null where the id is."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds
