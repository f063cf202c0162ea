"""Ends of lineage for iterative operators: tables written to the folder that all executors share, and deleted when they are done with."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which the small side of a step is broadcast; counted, not guessed.
FEW = 100_000
#: The same for rows of one number.
FEW_NUMBERS = 1_000_000


def folder(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``; only a local session without one gets a folder of its own. It goes when the application ends."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillon-")
        sc.setCheckpointDir(root)
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/quillon-{uuid.uuid4().hex}")
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once and read back: what follows starts from the table, whatever executor is lost."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def sized(df: DataFrame, few: int = FEW) -> tuple[DataFrame, int]:
    """``df`` settled, as one to broadcast if it has few rows, and its number of rows."""
    out = settled(df)
    n = out.count()
    hinted = F.broadcast(out) if n <= few else out
    hinted._settled = out._settled
    return hinted, n


def released(*tables: DataFrame) -> None:
    """Deletes the tables of ``settled`` and ``sized``, once nothing that is still to be computed reads them; other frames are left alone."""
    for df in tables:
        if path := getattr(df, "_settled", None):
            at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
