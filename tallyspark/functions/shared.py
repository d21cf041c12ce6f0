"""The folder that driver and executors share, and tables written into it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders written by this process that haven't been deleted.
_written: set[str] = set()
#: Names of the tables among them, by folder.
_tables: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset a local session (as in tests) gets a temporary folder, set for the
    session; on a cluster, whose machines share none, this fails."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, which release deletes."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.add(at)
    return at


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df once into the shared folder and returns the written table: later steps don't
    compute it again, and its lineage is cut. discard deletes it, release all that are left."""
    at = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(at)
    table = df.sparkSession.read.schema(df.schema).parquet(at)
    table.saved_at = at
    return table


def clustered(df: DataFrame, name: str, *keys: str, parted: bool = False) -> DataFrame:
    """As saved, as a table that Spark knows to be bucketed by keys: what is grouped or ranked by the keys, or by them and more, or joined by
    them alone, isn't shuffled again; nor is what is joined by them and more, where the other side is bucketed or parted so too. parted: df is, and isn't shuffled for it."""
    spark, at = df.sparkSession, new_folder(df.sparkSession, name)
    _tables[at] = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    n = parts(spark)
    (df if parted else df.repartition(n, *keys)).write.bucketBy(n, *keys).sortBy(*keys).option("path", at).option("compression", "zstd").saveAsTable(_tables[at], format="parquet")
    table = spark.table(_tables[at])
    table.saved_at = at
    return table


def parts(spark: SparkSession) -> int:
    """As many partitions as a clustered table has buckets."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _delete(spark: SparkSession, at: str) -> None:
    if at in _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(at)}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _written.discard(at)


def discard(*tables: DataFrame) -> None:
    """Deletes saved tables that nothing will read again: all that was made of them is written."""
    for t in tables:
        _delete(t.sparkSession, t.saved_at)


def release(spark: SparkSession) -> None:
    """Deletes all that is left. For the end of a job: results that read it must have been written."""
    for at in list(_written):
        _delete(spark, at)
