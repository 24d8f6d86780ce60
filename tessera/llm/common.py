"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space; ``bytes.split()`` cuts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of one Arrow batch; a text longer than that is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table of ``sf_dir``; extra columns, whatever their names, are left out."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes that are handed to Python at a time; the setting holds for the session, as plans read it when they run."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory of this process to the system, so that an idle Python worker stays small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


#: What empties the caches that operators keep in Python workers, by name.
CACHES: dict[str, Callable[[], None]] = {}


def drop_caches(kept: str) -> None:
    """Empty the caches of this process but for ``kept``.  A function of the module, so that workers look at their own caches."""
    for name, empty in CACHES.items():
        if name != kept:
            empty()


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, cache: str = "") -> DataFrame:
    """``df.mapInArrow`` in bounded batches, by workers that don't hold on to memory between tasks nor to caches other than ``cache``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches(cache)
        yield from run(batches)
        give_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(task, schema)


def ensure_checkpoints(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``; a temporary one only where none is set and there is no cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """A copy of ``df`` in the shared checkpoint folder: lineage ends there and lost executors cost nothing."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def fold_of(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id's text modulo ``folds``; -1 for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % F.lit(folds), F.lit(-1))


def labelled_ids(docs: DataFrame, labels: DataFrame, key: str, label: str, highest: bool, sample: int, salt: int) -> DataFrame:
    """__id, __y and __o (their order) of the ``sample`` labelled ids with the lowest hash, of those that stand in just one row of ``docs``.

    Only ids are moved.  So the rows of ``docs`` with these ids are ``sample`` at most, whatever is repeated, and labels without a document take no place.
    """
    best = F.max if highest else F.min
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("__id")).agg(best(label).alias("__y"))
    single = docs.groupBy(F.col(f"`{key}`").alias("__id")).agg(F.count(F.lit(1)).alias("__n")).where("__n = 1").select("__id")
    return known.join(single, "__id").withColumn("__o", F.xxhash64("__id", F.lit(salt))).orderBy("__o", "__id").limit(sample)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared checkpoint folder and read again; for wide rows, as it compresses."""
    ensure_checkpoints(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store and all in it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(df: DataFrame) -> None:
    """Delete what ``stored`` wrote for ``df``, once nothing that is still to run reads it."""
    delete(df.sparkSession, df._stored_at)
