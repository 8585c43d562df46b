"""Session helpers.

On a cluster the session is created by the platform; ``get_session`` only
fills in settings that are *unset*, so cluster-wide values (shuffle
partitions, checkpoint directory, AQE) always win.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, app: str = "ledgerlens", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    for k, v in _DEFAULTS.items():
        if spark.conf.get(k, None) in (None, ""):
            spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset, a scratch folder is used if everything runs in this one
    process (master ``local[...]``, as in tests).  On a cluster that would put
    each executor's part on its own disk, so there it is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the checkpoint folder for a materialised table."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/ledgerlens/{name}-{os.getpid()}-{os.urandom(4).hex()}"


def stored(df):
    """``df`` as a columnar table under the shared ``spark.checkpoint.dir`` (runs a job now).

    Used where a step reads its input more than once: what the input is made of
    (joins, shuffles) runs once, and each reading takes only the columns it
    needs.  The columns are named by their place in the files, so any name will do.
    """
    path = scratch_path(df.sparkSession, "stored")
    kinds = [f.dataType.simpleString() for f in df.schema.fields]
    if any(word in kind for kind in kinds for word in ("void", "interval", "variant")):  # not for files
        return cut_lineage(df)
    names = [f"c{i}" for i in range(len(kinds))]
    plain = df.toDF(*names)
    plain.write.parquet(path)
    return df.sparkSession.read.schema(plain.schema).parquet(path).toDF(*df.columns)


def cut_lineage(df):
    """Reliable checkpoint into the shared ``spark.checkpoint.dir`` (runs a job now).

    Used for aggregated tables that later plans read several times (range
    sampling plus shuffle), so the raw data is aggregated once and a lost
    executor re-reads the checkpoint instead of recomputing from the source.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
