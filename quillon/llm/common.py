"""What the operators share: reading tables, cutting lineage, Arrow batches of bounded size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

#: Texts are handed to Python code in slices of about so many characters.
SLICE_CHARS = 1_500_000


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named columns of a table in Parquet; only Spark opens the path."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def shared_dir(spark: SparkSession) -> str:
    """A new folder's URI below the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names that folder; only where it is unset (a local test) one is made on this machine.
    The folder goes when the application ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/quillon-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return fs.makeQualified(hadoop).toString()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to a table in the shared folder and read back: lineage ends there, lost executors lose nothing."""
    spark = df.sparkSession
    path = shared_dir(spark) + "/t"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` wrote, once nothing is to be computed from them any more; others are left alone."""
    for df in tables:
        if path := getattr(df, "_written", None):
            hadoop = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
            hadoop.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def map_texts(docs: DataFrame, work: Callable[[], Callable[[list], list]], schema: str, key: str | list[str] = "doc_id", text: str = "text", into: str | None = None) -> DataFrame:
    """One output row per input row, by a function from a list of texts to a list of tuples, without a shuffle.

    ``work()`` is called once per task and returns that function; ``schema`` names what it adds to the ``key`` columns,
    which are carried along as they are. ``into`` packs the additions into one struct, which clashes with no other name.
    Null texts are handed on as None. Slices are bounded by SLICE_CHARS, so memory doesn't follow the row count.
    """
    keys = [key] if isinstance(key, str) else list(key)
    added = StructType.fromDDL(schema)
    carried = docs.select(*[F.col(f"`{c}`") for c in keys])
    full = StructType([*carried.schema.fields, *([StructField(into, added)] if into else added.fields)])
    names, width = full.names, len(keys)
    types = [to_arrow_type(f.dataType) for f in added.fields]
    fields = [pa.field(f.name, t) for f, t in zip(added.fields, types, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = work()
        for batch in batches:
            texts = batch.column(width)
            for start, stop in slices(pc.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False), SLICE_CHARS):
                rows = f(texts.slice(start, stop - start).to_pylist())
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                if into:
                    cols = [pa.StructArray.from_arrays(cols, fields=fields)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(start, stop - start) for i in range(width)), *cols], names)

    return carried.withColumn("__text", F.col(f"`{text}`")).mapInArrow(run, full) if text in keys else docs.select(*[F.col(f"`{c}`") for c in [*keys, text]]).mapInArrow(run, full)


def slices(sizes, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of about ``most`` in sum; at least one row each."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist() if hasattr(sizes, "tolist") else sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


_clear: dict[str, Callable[[], object]] = {}


def remembers(name: str, clear: Callable[[], object]) -> None:
    """Says how what a worker remembers for the operator ``name`` is let go."""
    _clear[name] = clear


def works(name: str) -> None:
    """Called where an operator works: a worker process outlives a stage, and keeps what one operator remembers at a time.

    What the others let go is given back to the system, where the C library can do that.
    """
    global _at_work
    if _at_work != name:
        for other, clear in _clear.items():
            if other != name:
                clear()
        if _at_work:
            import ctypes
            import gc

            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)
        _at_work = name


_at_work = ""
