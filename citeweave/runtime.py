"""Session helpers: where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset on one machine (tests) a temporary folder is
    used. A cluster without the setting is an error: a folder of one machine would not be there for the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = os.environ.get("CITEWEAVE_CHECKPOINT_DIR") or os.path.join(tempfile.gettempdir(), "citeweave-checkpoints")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return folder


_SCRATCH: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder for a table that is written and read back; ``clear_scratch`` deletes all of them."""
    folder = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(folder)
    return folder


def clear_scratch(spark: SparkSession) -> None:
    """Delete the tables of ``scratch``, once their readers are done. Checkpoints themselves go with
    ``spark.cleaner.referenceTracking.cleanCheckpoints``, which only the start of a session can set."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        path.getFileSystem(conf).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder; survives the loss of any executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def input_tasks(df: DataFrame) -> int:
    """In how many tasks ``df`` is computed. Behind a shuffle that is the setting: asking would run the stages before it."""
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return shuffle_partitions(df.sparkSession)
    return df.rdd.getNumPartitions()


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files give fewer tasks than there are cores, as one small file does; a table of many
    files stays as it is. For steps that compute much per row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if input_tasks(df) < cores else df


def sound_unions(spark: SparkSession) -> None:
    """Keep the planner from taking a union of equally partitioned inputs for partitioned.

    Spark 4.1 then leaves out the shuffle of a following aggregation, and where an exchange of one input is reused the
    groups come out twice.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sound_unions(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
