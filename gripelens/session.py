"""Session set-up and the shared scratch folder that cuts long lineages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def build_session(
    app_name: str = "gripelens",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **conf: str,
) -> SparkSession:
    """A session with adaptive execution on and the clock pinned to UTC.

    ``master`` and ``shuffle_partitions`` stay unset on a cluster, where
    spark-submit and the cluster defaults decide.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A private folder is made only in local mode; on a cluster an unset folder
    is an error, since a machine-local one would not survive a lost executor.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="gripelens-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/gripelens-{uuid.uuid4().hex}/{name}"


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet in the scratch folder and read it back.

    Unlike a cached or locally checkpointed frame the result outlives its
    executors, keeps column pruning, and has file sizes Catalyst can use when it
    chooses join strategies.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    done = spark.read.schema(df.schema).parquet(path)
    done._scratch = path
    return done


def materialise_with(df: DataFrame, name: str, **facts: Column) -> tuple[DataFrame, dict]:
    """``materialise`` that also takes aggregates of the rows as it writes them."""
    seen = Observation()
    done = materialise(df.observe(seen, *[c.alias(k) for k, c in facts.items()]), name)
    return done, seen.get


def release(*frames: DataFrame | None) -> None:
    """Delete the files of materialised frames that no later job reads.

    Frames that were not materialised, and those released before, are left alone.
    Whoever made a table in the scratch folder owns it; results that are handed out are
    the caller's.
    """
    for frame in frames:
        path = vars(frame).pop("_scratch", None) if frame is not None else None
        if path:
            spark = frame.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def free_finished_shuffles(spark: SparkSession) -> None:
    """Delete shuffle files when the query that wrote them has ended.

    For jobs that write each intermediate table once and read it from there, so that no
    finished query's shuffle is needed again.
    """
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on whichever Hadoop file system it names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
