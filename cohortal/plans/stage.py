"""Stage boundaries inside a plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only where that is unset on a local master, as in tests, a folder of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = sc.getConf().get("spark.checkpoint.dir", None)
        if given is None and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def materialised(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, its lineage cut: for tables that many branches read."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """What ``materialised`` gives, as files of columns: for large tables of which a branch reads some columns or rows. A checkpoint gives every reader whole rows."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_entity(df: DataFrame) -> DataFrame:
    """``df`` dealt by entity."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "entity")


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt by entity and written: joins, windows and groups by entity read it without another exchange.

    An adaptive plan does not tell how its rows are dealt, so what it writes is shuffled again by every reader. This one step is planned without.
    Lists are gathered from sorted rows in it: a task has more groups than a hash map of lists may hold, which would sort all of them anew at each grouping,
    although the windows before have sorted them by entity and item.
    """
    conf, off = df.sparkSession.conf, ("spark.sql.adaptive.enabled", "spark.sql.execution.useObjectHashAggregateExec")
    was = {key: conf.get(key) for key in off}
    for key in off:
        conf.set(key, "false")
    try:
        return materialised(by_entity(df))
    finally:
        for key in off:
            conf.set(key, was[key])
