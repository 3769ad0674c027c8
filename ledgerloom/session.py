"""Sessions and the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build(app: str = "ledgerloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators expect; keyword names have `__` for `.`."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    wanted = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in wanted.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder if all runs on this machine, and an error on a cluster."""
    if found := spark.sparkContext.getConf().get("spark.checkpoint.dir", ""):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    if not getattr(spark.sparkContext, "_ledger_dir", None):
        spark.sparkContext._ledger_dir = "file://" + tempfile.mkdtemp(prefix="ledger-")
    return spark.sparkContext._ledger_dir


_WRITTEN: list[tuple[SparkSession, str]] = []


def forget(spark: SparkSession, path: str) -> None:
    """Delete a written table."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _forget_all() -> None:
    for spark, path in _WRITTEN:
        try:
            forget(spark, path)
        except Exception:  # the JVM may have gone first
            return


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that goes when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: this cuts the lineage and survives lost executors. Tables
    go when the driver's Python ends."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    """As many tasks as shuffles have."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """As `written`, for rows that lie in tasks(spark) tasks by the hash of the keys, as repartition deals them: files say
    so as buckets, and what goes by these keys is read without a shuffle. The catalog is used for that alone; it keeps
    no table."""
    spark = df.sparkSession
    path, table = new_path(spark, name), f"spark_catalog.default.{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(tasks(spark), *keys).option("path", path).saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return found


def spread(df: DataFrame, rows: int) -> DataFrame:
    """df dealt to tasks of about so many rows: a small file is one task's, whatever is made of its rows."""
    n = -(-df.count() // rows)
    return df.repartition(n) if n > 1 else df


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with these columns, which are computed once a row: as a generator makes them, a filter or a column that uses them
    later is not written out in their terms."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*(x.alias(name) for name, x in columns.items())))))
