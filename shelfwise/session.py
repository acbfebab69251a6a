"""Session building and the shared working folder."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app="shelfwise", master=None, **conf):
    """A session with adaptive execution, skew joins and a pinned UTC clock.

    ``spark.sql.shuffle.partitions`` stays at the cluster's own value unless it
    is passed in ``conf``; adaptive execution coalesces what is too fine.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


_LOCAL_DIRS = {}


def shared_dir(spark, *parts):
    """A fresh path under the folder named by ``spark.checkpoint.dir``.

    Only a ``local`` master may fall back to its own temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_DIRS:
            _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="shelfwise-")
        root = _LOCAL_DIRS[app]
    return os.path.join(root, *parts, uuid.uuid4().hex)


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder once and read it back.

    Used where one frame feeds several jobs (model fits, ladders): the copy
    survives the loss of executors, and later jobs do not repeat the upstream.
    """
    path = shared_dir(df.sparkSession, "tables")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def even_parts(table: DataFrame, rows=500_000) -> int:
    """How many parts of about ``rows`` rows a stored table makes, counted from its file footers.

    Joins of whole tables are dealt to so many parts, so that a task holds as much whatever the size of the tables.
    """
    return max(1, -(-table.count() // rows))
