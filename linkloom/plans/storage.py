"""Where plans keep their state, and small file-system chores."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"

#: temporary folders of local applications that name none
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only in local mode."""
    named = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getConf().get(CHECKPOINT_SETTING)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder all executors can reach")
    application = spark.sparkContext.applicationId
    if application not in _local:
        _local[application] = tempfile.mkdtemp(prefix="linkloom-")
    return _local[application]


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def _hadoop_path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    filesystem, target = _hadoop_path(spark, path)
    return filesystem.exists(target)


def remove_tree(spark: SparkSession, path: str) -> None:
    filesystem, target = _hadoop_path(spark, path)
    filesystem.delete(target, True)


def is_complete(spark: SparkSession, path: str) -> bool:
    """True if a Spark write to ``path`` was committed."""
    return exists(spark, f"{path}/_SUCCESS")


def byte_size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below ``path``."""
    filesystem, target = _hadoop_path(spark, path)
    return filesystem.getContentSummary(target).getLength()


def children(spark: SparkSession, path: str) -> list[str]:
    """Names directly below ``path``; none if it does not exist."""
    filesystem, target = _hadoop_path(spark, path)
    return sorted(s.getPath().getName() for s in filesystem.listStatus(target)) if filesystem.exists(target) else []


def row_groups(spark: SparkSession, files: list[str]) -> int:
    """Row groups of Parquet files (as ``inputFiles`` names them), from their footers."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.parquet.hadoop
    groups = 0
    for name in files:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        reader = hadoop.ParquetFileReader.open(hadoop.util.HadoopInputFile.fromPath(path, conf))
        try:
            groups += reader.getFooter().getBlocks().size()
        finally:
            reader.close()
    return groups
