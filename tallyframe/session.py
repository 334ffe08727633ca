"""Session helpers: a default local session and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", app: str = "tallyframe",
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    On a cluster pass nothing but ``conf`` overrides: AQE sizes the shuffles.
    """
    builder = (SparkSession.builder.master(master).appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    ``spark.checkpoint.dir`` decides; only a local session without it (tests)
    gets a temporary folder, one per application.
    """
    configured = (spark.conf.get("spark.checkpoint.dir", None)
                  or spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        configured = _LOCAL_DIRS.setdefault(app, "") or tempfile.mkdtemp(prefix="tallyframe-")
        _LOCAL_DIRS[app] = configured
    return configured.rstrip("/")


def materialize(df: DataFrame, label: str = "stage", compression: str | None = None) -> DataFrame:
    """Write a small intermediate to the shared folder and read it back.

    Cuts the lineage for results that several later steps use; the files
    outlive any executor. ``compression`` is Parquet's, by default the session's.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
