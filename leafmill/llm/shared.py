"""The shared folder for checkpoints and tables between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster names; only where none is named (local tests), a new temporary one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="leafmill-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


_written: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and is computed once. It stays until ``forget`` or ``forget_written``."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.parquet(path)


_tables: dict[str, str] = {}


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """As ``written``, dealt by ``key`` into as many buckets as the session has shuffle partitions: joins and aggregations by ``key`` read it as it stands, so wide rows travel once, however often they are joined."""
    spark = df.sparkSession
    path, table = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}", f"leafmill_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).saveAsTable(table)
    _written.append(path)
    _tables[path] = table
    return spark.table(table)


def _delete(spark: SparkSession, path: str) -> None:
    if path in _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(path)}")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def forget(table: DataFrame) -> None:
    """Deletes a table that ``written`` gave and no plan reads any more."""
    for file in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        own = [p for p in _written if file.endswith(p.split("://")[-1].removeprefix("file:").lstrip("/"))]
        for path in own:
            _delete(table.sparkSession, path)
            _written.remove(path)


def forget_written(spark: SparkSession) -> None:
    """Deletes all tables that ``written`` gave in this process; results that still read them must be saved before."""
    while _written:
        _delete(spark, _written.pop())
