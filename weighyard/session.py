"""Session defaults and the shared working folder."""

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app="weighyard", master=None, shuffle_partitions=None, extra=None):
    """A session with adaptive execution on and UTC wall clock.

    `spark.sql.shuffle.partitions` is only an upper start value: adaptive execution
    merges small shuffle blocks and splits skewed ones at run time.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.parquet.filterPushdown", "true")
        .config("spark.ui.enabled", "false")
        # Checkpoint files go away with the tables that used them.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # Recording the Python line of every column call takes longer than planning.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark):
    """The folder named by spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder of its own; a cluster
    session fails, because executors cannot share a machine-local folder.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="weighyard-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(configured)
    return configured


def scratch_path(spark, name):
    """A fresh path under the shared folder for a table a job writes and reads back."""
    return f"{shared_dir(spark).rstrip('/')}/weighyard/{name}-{uuid.uuid4().hex}"


def path_exists(spark, path):
    """Whether a file or folder is there, in whatever store the path names."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
