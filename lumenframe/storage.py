"""Tables that several steps share, kept under ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: Folders of local applications that name none, by application id.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor see, named in ``spark.checkpoint.dir``.

    Only a session on a local master, as in tests, gets a fresh temporary folder where the setting is
    missing; on a cluster that is an error, since executors don't see one another's folders.
    """
    path = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set {SETTING} to a folder that the driver and all executors of {master} share")
        app = spark.sparkContext.applicationId
        path = _LOCAL.get(app) or _LOCAL.setdefault(app, f"file://{tempfile.mkdtemp(prefix='lumenframe-')}")
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own for one run of one step."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    The lineage ends here: a lost executor costs only the tasks that read these files again.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """Reducers that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
