"""Stage tables: intermediate results written to the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Stage folders and tables of this process that are not dropped yet, with the session that wrote them.
_open: dict[str, SparkSession] = {}
_tables: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor see: ``spark.checkpoint.dir`` if the cluster names one, else a folder
    in the session's warehouse, which is shared as well."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages").rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, dropped with ``drop_path`` or when the process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _open[path] = spark
    return path


def stage(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return it read back (cuts the lineage)."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._stage_path = path
    return made


def stage_buckets(df: DataFrame, name: str, column: str, parts: int, compression: str = "none") -> DataFrame:
    """Write ``df`` as a table in the warehouse, in ``parts`` buckets of ``column``, so that joins on it need not move it again.

    The table is dropped when the process ends.
    """
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    _tables[table] = spark
    df.repartition(parts, column).write.bucketBy(parts, column).option("compression", compression).saveAsTable(table)
    return spark.table(table)


def drop_path(path: str) -> None:
    """Remove a stage folder, through Hadoop's file system, so that it may be in any store."""
    spark = _open.pop(path, None)
    if spark is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def drop_stage(*stages: DataFrame) -> None:
    """Remove the files of tables that ``stage`` returned and that no later result reads.

    The driver's JVM is asked to collect as well: only then does Spark's cleaner see that the plans that wrote them are
    done, and remove their shuffle files from the executors' disks.
    """
    for df in stages:
        drop_path(df._stage_path)
    stages[0].sparkSession._jvm.System.gc()


@atexit.register
def _drop_open() -> None:
    """What results still read goes when the process ends, if its session is still there; else the cluster's own clearing has it."""
    for name, spark in [*_open.items(), *_tables.items()]:
        try:
            if spark.sparkContext._jsc is None:
                continue
            if name in _tables:
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            else:
                drop_path(name)
        except Exception:
            continue
