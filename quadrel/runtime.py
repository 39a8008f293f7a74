"""Session-wide helpers: tables, cluster-safe staging, size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A side of a join is broadcast only if it was counted and holds at most this many rows and bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; on one machine (master local) a temporary one, set once.

    Without that setting a cluster has no folder that all executors see, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quadrel-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor loses none of them.

    They live as long as the session, because lazy results may read them; what is dropped earlier is dropped by hand.
    """

    _folders: ClassVar[list[tuple[SparkSession, str]]] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/quadrel-{uuid.uuid4().hex}"
        self.schemas: dict[str, StructType] = {}
        Scratch._folders.append((spark, self.base))

    def write(self, df: DataFrame) -> str:
        path = f"{self.base}/{len(self.schemas)}"
        self.schemas[path] = df.schema
        df.write.parquet(path)
        return path

    def read(self, *paths: str) -> DataFrame:
        """Tables of one schema; it is known, so no job looks for it."""
        return self.spark.read.schema(self.schemas[paths[0]]).parquet(*paths)

    def stage(self, df: DataFrame) -> DataFrame:
        return self.read(self.write(df))

    def size(self, path: str) -> int:
        """Bytes of a table."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()

    def drop(self, path: str) -> None:
        _delete(self.spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _sweep() -> None:
    """Deletes what this process wrote, if its session still runs when it ends."""
    for spark, base in Scratch._folders:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, base)
        except Exception:  # the session is gone: a cluster cleans its own folder
            return


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether df holds at most so many rows and, measured by its texts and arrays, about so many bytes."""
    width = F.lit(8 * len(df.columns)).cast("long")
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    got = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return got["n"] <= rows and got["b"] <= size


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows and bytes are within the bounds, else df as it is (a shuffle join follows)."""
    return F.broadcast(df) if fits(df, rows) else df
