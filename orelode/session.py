"""Session factory and shared-storage helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings that the library relies on for right results.
REQUIRED = {"spark.sql.session.timeZone": "UTC"}
#: Settings that the library proposes where it makes the session itself.
PROPOSED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.ui.enabled": "false",
}


def make_session(master: str = "local[8]", shuffle_partitions: int = 8, **more: str) -> SparkSession:
    """A session for tests and benches; on a cluster pass the cluster's own session to the operators."""
    b = SparkSession.builder.master(master).appName("orelode")
    for k, v in {**REQUIRED, **PROPOSED, "spark.sql.shuffle.partitions": str(shuffle_partitions), **more}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: the one the cluster names in spark.checkpoint.dir.

    Only on a local master, as in tests, a temporary folder of this machine stands in for it; a cluster without the setting is an error.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="orelode-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, written to the shared folder so that a lost executor loses nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its scan gives fewer tasks than there are cores, as a small table of one file does; otherwise as it is.

    Only for passes that cost far more than a shuffle of their rows. A large table has tasks enough and is never shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
