"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder under spark.checkpoint.dir for this application's intermediate tables.

    The setting is read from the session; a folder of our own is used only where it is
    unset (local tests). The folder is removed when the Python driver ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="causalspark-")
        _ROOTS[app] = f"{base.rstrip('/')}/tables-{uuid.uuid4().hex[:12]}"
        atexit.register(_remove, spark, _ROOTS[app])
    return _ROOTS[app]


def _remove(spark: SparkSession, root: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM may have ended first; the folder's owner then removes it
        pass


#: Up to so many rows of a few numbers each (some 20 bytes) are broadcast; beyond, joins shuffle.
BROADCAST_IDS = 1_000_000


def hinted(small: DataFrame) -> DataFrame:
    """A materialized table of ids, to be broadcast if its counted rows are few enough."""
    return F.broadcast(small) if small.count() <= BROADCAST_IDS else small


def release(table: DataFrame) -> None:
    """Delete a table that `materialize` wrote and nothing will read again."""
    _remove(table.sparkSession, table._written_to)


def materialize(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder, in so many files at most, and read it back.

    Cuts the lineage in a way that survives lost executors; zstd keeps the disk use low.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    (df.coalesce(files) if files else df).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def fresh(df: DataFrame, name: str) -> str:
    """A column name like this one that df does not have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text):
    """Column: A-Z to a-z and nothing else; lower() is the quick way where all is ASCII."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(
        F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )
