"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"

#: settings the library relies on; a cluster's own values win when present
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    STATE_STORE:
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
    # no call-site capture per Column call: plans build faster
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int = 8, memory: str = "16g", **conf: str) -> SparkSession:
    """A local session for tests and the bench; a job on a cluster brings its own."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName("changeloom")
               .config("spark.driver.memory", memory)
               .config("spark.sql.shuffle.partitions", str(cores)))
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def need_state_store(spark: SparkSession) -> None:
    """User-defined state runs on the RocksDB store only; choose it unless it is chosen."""
    if spark.conf.get(STATE_STORE, "") != DEFAULTS[STATE_STORE]:
        spark.conf.set(STATE_STORE, DEFAULTS[STATE_STORE])


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    The folder named in ``spark.checkpoint.dir`` is used as it is.  Only in local
    mode, where every task runs on this machine, is a temporary one made.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="changeloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df):
    """Write the frame to the shared folder and read it back.

    For a frame that several branches or jobs consume: a lost executor then costs
    a re-read, not a re-run, and indeterminate inputs are frozen.
    """
    spark = df.sparkSession
    path = shared_dir(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
