"""Session factory and settings shared by every plan."""

from __future__ import annotations

import dataclasses
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings every plan relies on. Results never depend on the partition counts.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

_scratch: set[str] = set()


@dataclasses.dataclass(frozen=True)
class Settings:
    """What a deployment sets: by environment (CAPSTRATA_<NAME>), else a file of NAME=value lines, else these."""

    top_k: int = 5
    model_pages: int = 30
    max_upload_bytes: int = 40_000_000
    max_pages: int = 300

    @classmethod
    def read(cls, path: str | None = None) -> Settings:
        lines = []
        if path and os.path.exists(path):
            with open(path) as f:
                lines = [x.strip().split("=", 1) for x in f if "=" in x and not x.lstrip().startswith("#")]
        given = {k.strip().upper(): v.strip().strip("\"'") for k, v in lines} | {k: v for k, v in os.environ.items() if k.startswith("CAPSTRATA_")}
        names = {f.name: given.get(f"CAPSTRATA_{f.name.upper()}") for f in dataclasses.fields(cls)}
        return cls(**{k: int(v) for k, v in names.items() if v not in (None, "")})


def new_job() -> str:
    """A job id of twelve hexadecimal digits."""
    return uuid.uuid4().hex[:12]


def get_session(master: str | None = None, app: str = "capstrata", **conf: str) -> SparkSession:
    """A session with CONF applied; on a cluster the launcher's own settings for memory and cores hold."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Only a session on one machine may name none; there, a folder of
    its own is used. On a cluster that is an error, since executors could not read each other's local folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        folder = tempfile.mkdtemp(prefix="capstrata-ckpt-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application below ``checkpoint_dir``, removed when the driver ends."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/capstrata-{spark.sparkContext.applicationId}"
    if base not in _scratch:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _scratch.add(base)
    return base


def cut_lineage(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back, so it survives the loss of any executor. Unlike a checkpoint, what is
    read back can be pruned by column and brings no inherited constraints, which are dear to the planner."""
    path = f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``table`` for work that is heavy per row: a file read in fewer parts than there are cores is dealt out evenly.

    Only for plain scans, whose number of parts is known without running anything; large tables stay as they are.
    """
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
